from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from figtrace.session import build_session  # noqa: E402
from figtrace.sources.concepts import bind_store  # noqa: E402
from figtrace.sources.tables import with_data_class  # noqa: E402

SEALED = "/Shared/Vault/Tenders/Under Seal"
FIELDS = (
    "point_id string, project_id string, value_num double, value_text string, unit string, currency string, "
    "value_scale string, metric string, metric_code string, scenario string, entity string, entity_id string, "
    "entity_type string, year int, vantage_year int, temporality string, source_file string, location string, "
    "context string, source_type_flag string, review_status string"
)
LEDGER, STAFF = "/Shared/Vault/Rail/Northgate/Ledger.xlsx", "/Shared/Vault/Rail/Millbrook/Staff.csv"
ROWS = [
    ("d01", "T7", 31.4, "31.4", "EUR", "EUR", "million", "running cost", "opex_total", "plan", "Northgate", "NGT", "depot",
     2016, 2017, "actual", LEDGER, "Costs!F7", "Total operating cost 31.4", "own", "accepted"),
    ("d02", "T7", 28.9, "28.9", "EUR", "EUR", "million", "running cost", "opex_total", "plan", "Northgate", "NGT", "depot",
     2018, 2017, "forecast", LEDGER, "Costs!H7", "Operating cost, outlook 28.9", "third_party", "auto"),
    ("d03", "T8", 12.75, "12.75", "USD", "USD", "million", "running cost", "opex_total", "plan", "Millbrook", "MIL", "depot",
     2014, 2015, "actual", STAFF, "R3", "Costs 12.75", "own", "accepted"),
    ("d04", "T7", 640.5, "640.5", "kWh", "", "unit", "energy", "energy_use", "plan", "Northgate", "NGT", "depot",
     2016, 2017, "actual", LEDGER, "Power!C2", "Energy used 640.5", "own", "auto"),
    ("d05", "T7", 2.2, "2.2", "EUR", "EUR", "million", "sundry", "opex_total", "plan", "Northgate", "NGT", "depot",
     None, None, "", LEDGER, "Costs!Z1", "sundry 2.2", "own", "queued"),
    ("d06", "T8", 0.8, "0.8", "EUR", "EUR", "unit", "cost a seat", "opex_unit", "low", "Millbrook", "MIL", "depot",
     2015, 2015, "actual", STAFF, "R4", "per seat 0.8", "own", "accepted"),
    ("d07", "T8", 57.0, "57", "", "", "unit", "people", "headcount", "low", "Millbrook", "MIL", "depot",
     2015, 2015, "actual", STAFF, "R5", "people 57", "own", "accepted"),
    ("s01", "T9", 44.0, "44", "EUR", "EUR", "million", "running cost", "opex_total", "plan", "Northgate", "NGT", "depot",
     2016, 2017, "actual", SEALED + "/Offer.xlsx", "Bid!D3", "sealed offer", "own", "accepted"),
]
_NORTHGATE = "/Shared/Vault/Rail/Northgate"
MANIFEST = [
    (STAFF, "done"), (_NORTHGATE + "/Plan.vsd", "skipped"), (LEDGER, "done"), (_NORTHGATE + "/Photo.png", "skipped"),
    (_NORTHGATE + "/Crash.xlsb", "failed"), (_NORTHGATE + "/Timetable.csv", "done"), (_NORTHGATE + "/Notes.docx", "skipped"),
    (_NORTHGATE + " East/Map.pdf", "failed"),
]


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    session = build_session("tests", "local[8]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def store(spark):
    core = spark.createDataFrame(ROWS, FIELDS)
    tables = {
        "core_points": core,
        "ask_points": with_data_class(core),
        "harvest_manifest": spark.createDataFrame(MANIFEST, "path string, status string"),
    }
    return bind_store(tables, store="fixture", sealed=[SEALED])


def ids(df, column="record_id"):
    return sorted(r[column] for r in df.select(column).collect())
