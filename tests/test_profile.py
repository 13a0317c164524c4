from __future__ import annotations

from figtrace.operators import profile as P
from figtrace.sources.concepts import bind


def test_fill_rate_counts_blanks_and_skips_absent_concepts(spark):
    df = spark.createDataFrame(
        [(1.0, 2000, "m", "E", "u", "s"), (1.0, 2000, "", None, "u", "s")],
        "value double, year int, metric string, entity string, unit string, source string",
    )
    rows = {r.concept: (r.filled, r.total, r.pct) for r in P.with_fill_pct(P.fill_rate(bind(df))).collect()}
    assert rows == {"metric_code": (1, 2, 50.0), "entity": (1, 2, 50.0)}
    empty = P.with_fill_pct(P.fill_rate(bind(df.limit(0)))).first()
    assert (empty.filled, empty.total, empty.pct) == (0, 0, None)


def test_contract_shows_empty_and_absent_columns(spark):
    df = spark.createDataFrame([("", 1)], "metric_code string, year int")
    rows = {r.column_name: (r.present, r.n_filled) for r in P.contract_check(df).collect()}
    assert rows["metric_code"] == (True, 0) and rows["year"] == (True, 1) and rows["unit"] == (False, 0)
    assert P.looks_like_points(df) and not P.looks_like_points(spark.range(1))


def test_profile_skips_nested_columns(spark):
    df = spark.createDataFrame([(1, [1.0], "x"), (2, None, "")], "id int, v array<double>, t string")
    rows = {r.column_name: (r.data_type, r.n_nonblank, r.n_rows) for r in P.table_profile(df, "t").collect()}
    assert rows == {"id": ("int", 2, 2), "t": ("string", 1, 2)}


def test_label_profile_of_a_cue_and_odd_spaces(spark):
    rows = [("[000s] Total  || x", " GBP ", 1.0), ("[000s] Total || y", "GBP", -2.0), (None, " ", None)]
    df = spark.createDataFrame(rows, "context string, unit string, value_num double")
    got = {r.label: r for r in P.label_profile(df).collect()}
    total = got["Total"]
    assert (total.cue, total.unit, total.n, total.n_distinct, total.n_negative, total.v_median) == ("000s", "GBP", 2, 2, 1, -0.5)
    assert got[None].unit == "(blank)" and got[None].v_median is None


def test_value_band_is_open(spark):
    df = spark.createDataFrame([("L", "u", v) for v in (0.0, 1.0, 50.0)], "context string, unit string, value_num double")
    assert P.value_band(df).first().n == 1
