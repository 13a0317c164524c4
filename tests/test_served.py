"""Search, summary, sources and comparison over the pinned rows."""

from __future__ import annotations

import pytest
from conftest import SEALED, ids

from figtrace.errors import SealedSourceError
from figtrace.functions.text import year_number
from figtrace.operators import compare as C
from figtrace.operators import evidence as E
from figtrace.operators import search as S
from figtrace.operators.filters import EvidenceFilter, apply_filter
from figtrace.sources.concepts import bind
from pyspark.sql import functions as F


def test_filters_apply_and_are_echoed(store):
    found = S.search(store, EvidenceFilter(metric="opex", entity="NGT", year_from=2016, year_to=2018))
    rows = {r["record_id"]: r for r in found.records.collect()}
    assert sorted(rows) == ["d01", "d02"]
    assert "opex_total=31.4 EUR" in rows["d01"]["citation"] and "fixture" in rows["d01"]["provenance"]
    assert rows["d01"]["data_class"] == "fact" and rows["d02"]["data_class"] == "forecast"
    assert found.echo.understood_as == {"metric_code": "opex", "entity": "NGT", "year_from": 2016, "year_to": 2018}
    assert found.echo.not_applicable == [] and found.echo.deduplication == "unavailable"


def test_name_and_code_find_the_same(store):
    by_code = ids(S.search(store, EvidenceFilter(entity="NGT")).records)
    assert by_code == ids(S.search(store, EvidenceFilter(entity="Northgate")).records) == ["d01", "d02", "d04", "d05"]


def test_sealed_sources_are_never_returned(store):
    found = S.search(store, EvidenceFilter(metric="opex", entity="NGT"))
    assert "s01" not in ids(found.records) and found.echo.quarantine == "excluded in query"


@pytest.mark.parametrize(
    ("path", "sealed"),
    [
        (SEALED + "/a.xlsx", True), (SEALED.upper().replace("/", "\\") + "\\a", True), (SEALED, True),
        (SEALED + " Two/a.xlsx", False), ("", False), (None, False),
    ],
)
def test_the_seal_ends_at_a_folder(spark, path, sealed):
    df = spark.createDataFrame([(1.0, 2000, "m", "E", "u", path, "r")], "value double, year int, metric string, entity string, unit string, source string, id string")
    kept, _ = apply_filter(bind(df, sealed=[SEALED]), EvidenceFilter())
    assert kept.count() == (0 if sealed else 1)


def test_filters_on_absent_concepts_are_reported(spark):
    thin = spark.createDataFrame(
        [("x1", 7.0, 2016, "opex_total", "NGT", "EUR", "/Shared/a.xlsx"), ("x2", 8.0, 2016, "energy_use", "NGT", "EUR", "/Shared/a.xlsx")],
        "point_id string, value_num double, year int, metric_code string, entity_id string, unit string, source_file string",
    )
    found = S.search(bind(thin), EvidenceFilter(metric="opex", data_class="fact", status="accepted"))
    assert ids(found.records) == ["x1"]
    assert found.echo.not_applicable == ["data_class", "verification_status"]
    assert "unfiltered" in found.page()["warning"]


def test_canonical_only_removes_copies(spark, store):
    canonical = spark.createDataFrame([(store.frame.first()["source"], False)], "source_file string, is_canonical boolean")
    from dataclasses import replace

    found = S.search(replace(store, canonical=canonical), EvidenceFilter(entity="NGT"))
    assert found.echo.deduplication == "applied" and ids(found.records) == []
    every = S.search(replace(store, canonical=canonical), EvidenceFilter(entity="NGT", canonical_only=False))
    assert len(ids(every.records)) == 4 and every.echo.deduplication.startswith("off")


def test_the_page_says_whether_more_is_held(store):
    assert S.search(store, EvidenceFilter(entity="NGT"), limit=4).page()["truncated"] is False
    page = S.search(store, EvidenceFilter(entity="NGT"), limit=3).page()
    assert page["truncated"] is True and page["returned"] == 3
    assert "no evidence" in S.search(store, EvidenceFilter(metric="nothing")).page()["note"]


@pytest.mark.parametrize(("part", "n"), [("a\\b", 0), ("op%total", 4), ("opex_tot", 4), ("OPEX", 5)])
def test_wildcards_and_backslashes_in_a_part(store, part, n):
    assert apply_filter(store, EvidenceFilter(metric=part))[0].count() == n


def test_years_kept_as_text(spark):
    df = spark.createDataFrame([("2009",), ("2009.7",), ("n/a",), (None,)], "y string")
    assert [r[0] for r in df.select(year_number(F.col("y"), "string")).collect()] == [2009, 2010, None, None]


def test_a_summary_counts_what_a_search_finds(store):
    wanted = EvidenceFilter(entity="NGT")
    rows, echo = S.summarise(store, wanted)
    by = {(r.facet, r.key): r.n for r in rows.collect()}
    assert by["_total", "all"] == apply_filter(store, wanted)[0].count() == 4
    assert by["year", "(blank)"] == 1 and by["temporality", "(blank)"] == 1
    assert by["source_folder", "/Shared/Vault/Rail/Northgate"] == 4
    for facet in (*S.FACETS, "source_folder"):
        assert sum(n for (f, _), n in by.items() if f == facet) == 4
    nothing = S.summarise(store, EvidenceFilter(metric="nothing"))[0].collect()
    assert sorted(tuple(r) for r in nothing) == [("_total", "all", 0), ("_untagged", "metric_code", 0)]


def test_a_summary_needs_a_filter(store):
    rows, echo = S.summarise(store, EvidenceFilter())
    assert rows.count() == 0 and "at least one filter" in echo.note


def test_the_source_of_a_record(store):
    row = E.get_one_source(store, "d01")
    assert row["outcome"] == "ok" and row["cell"] == "Costs!F7" and row["locator_path"].endswith("Ledger.xlsx")
    assert row["verbatim"].startswith("Total operating") and (row["value"], row["year"], row["data_class"]) == (31.4, 2016, "fact")
    assert (row["in_scope"], row["done"], row["not_done"]) == (6, 2, 4)
    assert row["citation"].startswith("opex_total=31.4 EUR (Northgate 2016) [class=fact, status=accepted] source: /Shared")
    assert E.get_one_source(store, "d01", "/Shared/Vault")["in_scope"] == 8
    assert E.get_one_source(store, "d01", "")["in_scope"] == 8
    assert E.get_one_source(store, "unknown")["outcome"] == "no_evidence"


def test_a_sealed_record_is_refused(spark, store):
    with pytest.raises(SealedSourceError):
        E.get_one_source(store, "s01")
    row = E.get_source(store, spark.createDataFrame([("s01",)], "record_id string")).first()
    assert row["outcome"] == "refused_quarantine"
    assert all(row[c] is None for c in ("verbatim", "locator_path", "cell", "citation", "in_scope"))


def test_skip_disclosure_by_scope(spark, store):
    asked = spark.createDataFrame(
        [("/Shared/Vault/Rail/Northgate",), ("/shared/vault/rail/NORTHGATE/",), ("/nowhere",), ("",)], "scope string"
    )
    rows = {r.scope: (r.in_scope, r.done, r.not_done) for r in E.skip_disclosure(store, asked).collect()}
    assert rows["/Shared/Vault/Rail/Northgate"] == rows["/shared/vault/rail/NORTHGATE/"] == (6, 2, 4)
    assert rows["/nowhere"] == (0, 0, 0) and rows[""] == (8, 3, 5)
    one = asked.where("scope = '/Shared/Vault/Rail/Northgate'")
    by = {r.status: r.n for r in E.skip_by_status(store, one).collect()}
    assert by == {"done": 2, "skipped": 3, "failed": 1}


def test_an_absent_manifest_is_not_zero_skips(spark, store):
    from dataclasses import replace

    asked = spark.createDataFrame([("/a",)], "scope string")
    row = E.skip_disclosure(replace(store, manifest=None), asked).first()
    assert row["manifest"] == "ABSENT" and row["in_scope"] is None


def _compare(spark, store, *record_ids):
    pairs = spark.createDataFrame([("c", r) for r in record_ids], "comparison_id string, record_id string")
    flags = {(r.axis, r.value): r for r in C.compare_flags(store, pairs).collect()}
    return C.compare_evidence(store, pairs).first(), flags, pairs


def test_one_definition_gives_a_spread(spark, store):
    row, flags, pairs = _compare(spark, store, "d01", "d02", "d01")
    assert (row["verdict"], row["n"], row["v_min"], row["v_median"], row["v_max"]) == ("comparable", 2, 28.9, 30.15, 31.4)
    assert "mean" not in " ".join(row.asDict())
    assert flags["temporality", "actual"]["severity"] == "soft" and "mixed" in flags["temporality", "actual"]["message"]
    assert {r.axis: r.value for r in C.aligned_on(store, pairs).collect()}["unit"] == "EUR"


@pytest.mark.parametrize(("other", "axis"), [("d03", "currency"), ("d04", "metric_code")])
def test_different_definitions_do_not_combine(spark, store, other, axis):
    row, flags, pairs = _compare(spark, store, "d01", other)
    assert row["verdict"] == "not_comparable" and row["v_median"] is None
    assert axis in {a for a, _ in flags} and C.components(store, pairs).where("held").count() == 2


def test_one_held_record_is_insufficient(spark, store):
    row, flags, pairs = _compare(spark, store, "d01", "missing")
    assert (row["verdict"], row["n_held"], row["n_missing"]) == ("insufficient", 1, 1)
    assert ids(C.components(store, pairs).where("not held")) == ["missing"]


def test_real_and_nominal_do_not_combine(spark):
    fields = "id string, value double, year int, metric string, entity string, unit string, source string, basis string"
    rows = [("a", 1.0, 2000, "m", "E", "u", "s", "real"), ("b", 2.0, None, "m", "E", "u", "s", "nominal")]
    row, flags, _ = _compare(spark, bind(spark.createDataFrame(rows, fields)), "a", "b")
    assert row["verdict"] == "not_comparable" and ("basis", "real") in flags and ("year", "(blank)") in flags


def test_a_spread_needs_every_value_to_be_a_number(spark):
    fields = "id string, value string, year int, metric string, entity string, unit string, source string"
    rows = [("a", "1", 2000, "m", "E", "u", "s"), ("b", "n/a", 2000, "m", "E", "u", "s")]
    row, _, _ = _compare(spark, bind(spark.createDataFrame(rows, fields)), "a", "b")
    assert row["verdict"] == "comparable" and row["n"] is None
