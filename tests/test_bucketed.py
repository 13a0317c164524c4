"""The bucketed tag join gives what the shuffled one gives, spreads hot contexts, and exchanges nothing."""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import functions as F

from checks import inputs as I
from figtrace.operators import tagging as T
from figtrace.sources import bucketed as B

SF = "/root/testdata/sf0.001"
SHOWN = ("point_id", "metric_code_v2", "metric_code_v2_raw", "magnitude_check", "rule_id", "currency_v2", "price_basis")


def tagged(spark, points, path, buckets=8):
    name = f"b{uuid.uuid4().hex}"
    held = T.bucket_points(points, name, str(path), buckets=buckets)
    return held, T.tag_bucketed_points(held, T.context_tags(points), f"tags_{name}")


def test_as_the_shuffled_join(spark, tmp_path):
    points = I.points(spark, SF)
    _, got = tagged(spark, points, tmp_path)
    want = T.tag_points_by_lookup(points, T.context_tags(points))
    assert got.columns == want.columns
    assert Counter(map(tuple, got.select(*SHOWN).collect())) == Counter(map(tuple, want.select(*SHOWN).collect()))


def test_nothing_is_exchanged(spark, tmp_path):
    _, got = tagged(spark, I.points(spark, SF), tmp_path)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_hot_context_is_spread(spark, tmp_path):
    rows = spark.range(9_000).select(
        F.col("id").cast("string").alias("point_id"), F.lit("GBP").alias("unit"), F.lit("sheet=Ticket Income!C1").alias("location"),
        F.when(F.col("id") % 3 == 0, F.lit("Average fare || x")).when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("Seats "), F.col("id").cast("string"), F.lit(" ||"))).alias("context"),
        F.col("id").cast("double").alias("value_num"),
    )
    held, got = tagged(spark, rows, tmp_path, buckets=16)
    sizes = Counter(r["b"] for r in held.frame().select(F.expr("pmod(hash(_k1, _k2, _salt), 16)").alias("b")).collect())
    assert held.salts().count() == 1 and max(sizes.values()) < 3_000 / 2
    want = T.tag_points_by_lookup(rows, T.context_tags(rows))
    assert Counter(map(tuple, got.select(*SHOWN).collect())) == Counter(map(tuple, want.select(*SHOWN).collect()))
    assert got.where("context IS NULL AND magnitude_check <> 'untagged'").count() == 0


def test_equal_keys_of_different_texts_do_not_meet(spark, tmp_path, monkeypatch):
    """If every text had one key, texts would still decide."""
    monkeypatch.setattr(B, "_hashed", lambda keys: {"_k1": F.lit(1).cast("long"), "_k2": F.lit(2).cast("long")})
    points = I.points(spark, SF).limit(300)
    points = points.persist()
    _, got = tagged(spark, points, tmp_path)
    want = T.tag_points_by_lookup(points, T.context_tags(points))
    assert Counter(map(tuple, got.select(*SHOWN).collect())) == Counter(map(tuple, want.select(*SHOWN).collect()))
    points.unpersist()
