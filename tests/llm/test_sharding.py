"""The shuffle into shards: exact sizes, every row once, and chances as a uniform permutation has them."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import product
from math import comb, prod

import pytest
from pyspark.sql import functions as F

from figtrace.llm import sharding
from figtrace.llm.queries import QUERIES
from tests.llm.conftest import SF, rows


def off(seen: Counter, chances: dict) -> float:
    """Chi-square in deviations from what draws with these chances give; 6 is far off."""
    n = sum(seen.values())
    assert set(seen) <= {k for k, p in chances.items() if p > 0}
    free = sum(p > 0 for p in chances.values()) - 1
    return (sum((seen[k] - n * p) ** 2 / (n * p) for k, p in chances.items() if p > 0) - free) / (2 * max(1, free)) ** 0.5


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (10, 3, 12), (3, 10, 0), (0, 3, 2), (1, 0, 1), (400, 9000, 1000), (0, 0, 0)])
def test_hypergeometric_chances(spark, good, bad, draws):
    g, b, n = (F.lit(x).cast("long") + F.col("id") * 0 for x in (good, bad, draws))
    drawn = spark.range(20_000).select(sharding.hypergeometric(g, b, n, lambda k: F.xxhash64("id", k)).alias("x"))
    seen = Counter({r["x"]: r["count"] for r in drawn.groupBy("x").count().collect()})
    every = range(max(0, draws - bad), min(good, draws) + 1)
    chances = {k: comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in every}
    likely = {k: p for k, p in chances.items() if p * 20_000 > 5}
    assert sum(seen[k] for k in likely) >= 19_900 * min(1, sum(likely.values()))
    if len(likely) > 1:
        total = sum(likely.values())
        assert off(Counter({k: seen[k] for k in likely}), {k: p / total for k, p in likely.items()}) < 6


def test_halves_get_what_a_permutation_gives_them(spark):
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(n).cast("long").alias("n")) for i, n in enumerate((3, 2))])
    counts = [2, 2, 1]
    nodes = spark.range(1, 20_001).select(F.col("id").alias("node"), parts.alias("parts"), F.array(*map(F.lit, counts)).cast("array<long>").alias("counts"))
    got = sharding._halved(nodes, 0).collect()
    first = Counter(tuple(r["counts"]) for r in got if r["node"] % 2 == 0)
    chances = {x: prod(map(comb, counts, x)) / comb(5, 3) for x in product(*[range(c + 1) for c in counts]) if sum(x) == 3}
    assert sum(first.values()) == 20_000 and off(first, chances) < 6
    whole = {r["node"]: r["counts"] for r in got}
    assert all([a + b for a, b in zip(whole[2 * i], whole[2 * i + 1])] == counts for i in range(1, 20_001))


@pytest.mark.parametrize("sizes,shards", [([7], 3), ([5, 1, 9, 2, 2], 4), ([1] * 40, 24), ([100_000, 3, 70_001], 5), ([2, 1], 7)])
def test_matrix_has_the_sizes_of_both_sides(spark, sizes, shards):
    df = spark.createDataFrame([(10 * i, n) for i, n in enumerate(sizes)], "part long, n long")
    for together in (sharding.TOGETHER, 2):
        sharding.TOGETHER, before = together, sharding.TOGETHER
        try:
            got = {r["part"]: r["counts"] for r in sharding.communication_matrix(df, "part", "n", shards, seed=2).collect()}
        finally:
            sharding.TOGETHER = before
        assert {p: sum(c) for p, c in got.items()} == {10 * i: n for i, n in enumerate(sizes)}
        total = sum(sizes)
        assert [sum(c) for c in zip(*got.values())] == [total // shards + (j < total % shards) for j in range(shards)]
        assert all(x >= 0 for c in got.values() for x in c)


def test_rows_go_anywhere(spark):
    """Over many rows, neither the partition nor the place a row comes from tells its shard or slot."""
    docs = spark.range(0, 40_000, 1, 8).withColumnRenamed("id", "doc_id")
    got = sharding.shuffled(docs, 4, seed=11, chunk=3_000).collect()
    assert {r["doc_id"] for r in got} == set(range(40_000))
    even = dict.fromkeys(product(range(8), range(4)), 1 / 32)
    assert off(Counter((r["doc_id"] // 5_000, r["shard"]) for r in got), even) < 6
    assert off(Counter((r["doc_id"] // 5_000, r["slot"] // 2_500) for r in got), dict.fromkeys(product(range(8), range(4)), 1 / 32)) < 6
    neighbours = sorted(got, key=lambda r: r["doc_id"])
    apart = Counter((a["shard"], b["shard"]) for a, b in zip(neighbours[::2], neighbours[1::2]))
    assert off(apart, dict.fromkeys(product(range(4), repeat=2), 1 / 16)) < 6
    other = {r["doc_id"]: r["shard"] for r in sharding.shuffled(docs, 4, seed=12).collect()}
    assert sum(other[r["doc_id"]] == r["shard"] for r in got) < 0.3 * len(got)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(docs, 4, seed=11, chunk=3_000).collect()}
    assert all(again[r["doc_id"]] == (r["shard"], r["slot"]) for r in got)


def gapless(got, shards):
    n = len(got)
    for j in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == j)
        assert slots == list(range(n // shards + (j < n % shards)))


def test_odd_rows_stay_whole(odd, none):
    clash = odd.withColumn("slot", odd["lang"]).withColumn("a.b`c", odd["lang"])
    got = sharding.shuffled(clash, 5, chunk=2)
    held = rows(got)
    gapless(held, 5)
    assert got.columns == [c for c in clash.columns if c != "slot"] + ["shard", "slot"] and dict(got.dtypes)["slot"] == "bigint"
    as_text = lambda rs: Counter(str([r[c] for c in odd.columns if c != "slot"]) for r in rs)
    assert as_text(held) == as_text(rows(odd))
    assert sharding.shuffled(none, 3).count() == 0
    few = rows(sharding.shuffled(odd.limit(2), 24, keep=["doc_id"]))
    assert sorted(r["shard"] for r in few) == [0, 1]


def test_query(spark, docs):
    got = rows(QUERIES["op12_sharding"](spark, SF))
    gapless(got, 24)
    want = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert Counter(r["doc_id"] for r in got) == Counter(want.keys())
    for r in got:
        t = want[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "rows", None)


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op12_sharding"](spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_written_shards(spark, tmp_path):
    got = sharding.shuffled(spark.range(1_000), 3, chunk=100)
    sharding.write_shards(got, str(tmp_path / "out"), rows_a_file=200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in back.collect()) == list(range(1_000))
    gapless(rows(back), 3)
    for f in (tmp_path / "out" / "shard=1").glob("*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots))) and len(slots) <= 200
