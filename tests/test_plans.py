"""Medians and lookups are exact, and plans have the intended shape."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from checks.queries import QUERIES, SCOPES
from figtrace.operators import compare as C
from figtrace.operators import filters as FL
from figtrace.operators import repetition as RP
from figtrace.operators import search as S
from figtrace.operators import tagging as T
from figtrace.plans import figures
from figtrace.plans.figures import grouped_figures
from figtrace.plans.skew import lookup_join

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 5])
def test_medians_are_exact(spark, parts):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), float(rng.randint(0, 3)), rng.gauss(0, 1e9), None])) for _ in range(4000)]
    rows += [("rare", 2.5), ("pair", 1.0), ("pair", 2.0), ("empty", None), ("huge", 1e300), ("huge", -1e300), ("tiny", 5e-324), ("tiny", 0.0)]
    nan, inf = float("nan"), float("inf")
    rows += [("nan", 1.0)] * 50 + [("nan", nan)] * 60 + [("some", 1.0)] * 60 + [("some", nan)] * 50 + [("inf", -inf), ("inf", inf), ("inf", inf)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    found = grouped_figures(df, ["k"], "v")
    groups = defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    got = {r.k: r for r in found.collect()}
    assert set(got) == set(groups)
    for k, held in groups.items():
        numbers = sorted((v for v in held if v is not None), key=lambda v: (v != v, v))
        distinct = {"nan" if v != v else v for v in numbers}
        assert (got[k].n, got[k].n_values, got[k].n_distinct) == (len(held), len(numbers), len(distinct))
        assert got[k].n_negative == sum(v < 0 for v in numbers)
        ends = (numbers[0], numbers[-1]) if numbers else (None, None)
        assert (got[k].v_min, got[k].v_max) == (pytest.approx(ends, nan_ok=True) if numbers else ends)
        middle = (numbers[(len(numbers) - 1) // 2] * 0.5 + numbers[len(numbers) // 2] * 0.5) if numbers else None
        assert got[k].v_median == (pytest.approx(middle, nan_ok=True) if numbers else None), k


def test_a_median_over_many_values(spark):
    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7).alias("v"))
    assert grouped_figures(df, ["k"], "v").first()["v_median"] == df.agg(F.median("v")).first()[0]


def test_tiny_values_beside_a_larger_one(spark):
    """A million values below 1e-9 and one of 9e-4: each step still narrows them down."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("k").alias("k"), ((F.pmod(F.xxhash64("id"), F.lit(10**9)) + 1) * 1e-18).alias("v"))
    df = df.unionByName(spark.createDataFrame([("k", 9e-4)], "k string, v double"))
    got = grouped_figures(df, ["k"], "v").first()
    assert (got.n, got.v_max) == (n + 1, 9e-4) and got.v_median == df.agg(F.median("v")).first()[0]
    counted = df.groupBy("k", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", figures._coarse(F.col("_v")))
    assert counted.groupBy("_b").count().agg(F.max("count")).first()[0] < n / 500


def test_groups_by_details_and_no_keys(spark):
    rows = [("a", 1.0, True), ("a", 1.0, False), ("a", 4.0, True), ("a", None, True), ("b", None, False)]
    df = spark.createDataFrame(rows, "k string, v double, f boolean")
    also = {"n_f": (F.sum(F.when(F.col("f"), F.col("_c")).otherwise(0)), F.sum), "all_f": (F.min("f"), F.min)}
    got = {r.k: (r.n, r.n_values, r.v_median, r.n_f, r.all_f) for r in grouped_figures(df, ["k"], "v", details=["f"], also=also).collect()}
    assert got == {"a": (4, 3, 1.0, 3, False), "b": (1, 0, None, 0, False)}
    assert grouped_figures(df, [], "v").first()["v_median"] == 1.0


ONE_SCAN = (
    "label_profile", "context_profile", "value_band", "untagged_reclaim", "value_spread", "tag_claims", "gold_by_year", "tag_before_after",
    "compare_evidence",
)


@pytest.mark.parametrize("name", ONE_SCAN)
def test_figures_read_the_points_once(spark, name):
    """As run, after adaptive execution: every other use of the counted table reads its shuffle again."""
    df = QUERIES[name](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    seen = final.count("orders.parquet")
    # Comparisons read the points once more, to say which records are compared.
    assert seen == (2 if name == "compare_evidence" else 1)


def test_lookup_join_is_a_left_join(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([None] * 9 + ["a"] * 9 + ["b", "c", "x"] + ["y"] * 5)], "i int, k string")
    lookup = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("z", 4)], "k string, v int")
    found = lookup_join(rows, lookup, ["k"])
    assert found.columns == ["i", "k", "v"]
    want = {"a": 1, "b": 2, None: 3}
    assert {(r.i, r.k): r.v for r in found.collect()} == {(r.i, r.k): want.get(r.k) for r in rows.collect()}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_canonical_points_is_a_semi_join(spark):
    p = I.points(spark, SF)
    assert "LeftSemi" in _plan(FL.keep_canonical(p, I.canonical(spark, SF)))


def test_a_search_reads_only_its_columns_and_pushes_filters(spark, tmp_path):
    from figtrace.sources.concepts import bind

    path = str(tmp_path / "p")
    I.points(spark, SF).write.parquet(path)
    bound = bind(spark.read.parquet(path))
    found, _ = FL.apply_filter(bound, FL.EvidenceFilter(metric="aero", status="accepted", year_from=1996))
    plan = found.select("record_id")._jdf.queryExecution().executedPlan().treeString()
    plan = found.select("record_id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(review_status,accepted)" in plan and "GreaterThanOrEqual(year,1996)" in plan
    (schema,) = {line for line in plan.splitlines() if line.startswith("ReadSchema")}
    assert "context" not in schema and "location" not in schema


def test_a_summary_scans_points_once(spark):
    bound = I.bound(spark, SF, with_canonical=False)
    plan = _plan(S.summarise(bound, FL.EvidenceFilter(entity=I.ENTITY))[0])
    assert plan.count("orders.parquet") == 1


def test_tagging_does_not_shuffle_or_call_python(spark, tmp_path):
    path = str(tmp_path / "p")
    I.points(spark, SF).write.parquet(path)
    plan = _plan(T.tag_points(spark.read.parquet(path)))
    assert "Exchange" not in plan and "Python" not in plan
    filtered = T.tag_points(spark.read.parquet(path)).where("year = 1998 and metric_code_v2 is not null")
    assert "PushedFilters: [IsNotNull(year), EqualTo(year,1998)]" in _plan(filtered)


def test_scope_counts_shuffle_each_figure_once(spark):
    """Four distinct counts of five scopes: one scan, no copies of rows per count, and no more shuffled than for one count."""
    p = I.points(spark, SF)
    df = RP.repetition_scope(p, SCOPES)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString().split("== Initial Plan ==")[0]
    assert "Expand" not in text and text.count("orders.parquet") == 1
    rows = RP.in_scopes(p, SCOPES).select("metric", "scope_entity", RP._key("value_num").alias("k"), "source_file")
    files = rows.select("source_file").distinct().count()
    one_count = rows.select("metric", "scope_entity", "k").distinct().count()
    figures = rows.select("k").distinct().count()
    assert figures + files <= one_count + files


@pytest.mark.parametrize("together", [24, 2])
def test_scopes_in_several_passes(spark, monkeypatch, together):
    monkeypatch.setattr(RP, "TOGETHER", together)
    rows = [("m", "A", "E1", 2000, 1.0, "u", "/a/b/c/d/e/f1"), ("m", "A", "E1", 2000, 1.0, "u", "/a/b/c/d/e/f2"), ("m", "a b", "E2", 2001, 1.0, "u", None),
            ("q", "A", "E1", 2000, 1.0, "u", "/z/f1"), (None, "A", "E1", 2000, 1.0, "u", "/z/f1")]
    df = spark.createDataFrame(rows, "metric_code string, entity string, entity_id string, year int, value_num double, unit string, source_file string")
    got = {(r.metric, r.entity): (r.n_rows, r.n_distinct, r.n_files, r.n_folders) for r in RP.repetition_scope(df, [("m", "A"), ("m", "e2"), ("q", "A"), ("none", "A")]).collect()}
    assert got == {("m", "A"): (3, 2, 2, 2), ("m", "e2"): (1, 1, 0, 1), ("q", "A"): (1, 1, 1, 1), ("none", "A"): (0, 0, 0, 0)}


def test_flags_move_each_record_once(spark):
    """Axes are unfolded where a comparison was gathered: above that nothing is shuffled."""
    df = QUERIES["compare_flags"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" not in final.split("Generate explode")[0] and "Exchange" in final


def test_large_comparisons_give_the_same_flags(spark, monkeypatch):
    bound, pairs = I.bound(spark, SF, with_canonical=False), I.comparisons(spark, SF).where("comparison_id < 'b2'")
    usual = C.compare_flags(bound, pairs).collect()
    monkeypatch.setattr(C, "LARGE", 40)
    monkeypatch.setattr(C, "ONE_IN", 2)
    _, large = C._by_size(pairs)
    some = large.select("comparison_id").distinct().count()
    assert 0 < some < pairs.select("comparison_id").distinct().count()
    assert usual and sorted(C.compare_flags(bound, pairs).collect(), key=str) == sorted(usual, key=str)


def test_large_comparisons_give_the_same_verdicts(spark, monkeypatch):
    bound, pairs = I.bound(spark, SF, with_canonical=False), I.comparisons(spark, SF).where("comparison_id < 'b2'")
    usual = C.compare_evidence(bound, pairs.unionAll(pairs)).collect()
    monkeypatch.setattr(C, "LARGE", 40)
    monkeypatch.setattr(C, "ONE_IN", 2)
    assert usual and sorted(C.compare_evidence(bound, pairs).collect(), key=str) == sorted(usual, key=str)


def test_verdicts_move_each_record_once(spark):
    """To its points and to its comparison, where all figures are taken: two shuffles of pairs, one of points."""
    df = QUERIES["compare_evidence"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above = final.split("Join")[0]
    assert above.count(" Exchange ") == 1 and "REPARTITION_BY_COL" in above
