"""Keyed stores, scope trees and replaced tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from figtrace.errors import SourceError
from figtrace.operators import evidence as E
from figtrace.sources import scopes as SC
from figtrace.sources import tables as TB
from figtrace.sources.concepts import bind
from figtrace.sources.keyed import same_id, typed_ids, with_ids, write_keyed

KINDS = ["string", "int", "long", "decimal(12,0)"]


def scan(df) -> tuple[str, int]:
    """The scan's description after a run, and how many rows it let out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    while "Scan" not in leaf.nodeName():
        leaf = (leaf.executedPlan() if "Adaptive" in leaf.nodeName() else leaf.plan()).collectLeaves().head()
    return leaf.toString(), leaf.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def keyed(spark, tmp_path_factory):
    n = 200_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.rand(3).alias("value"))
    held = {}
    for kind in KINDS:
        path = str(tmp_path_factory.mktemp("keyed") / "t")
        held[kind] = write_keyed(rows.withColumn("id", F.col("id").cast(kind)), path, "id", row_group_bytes=64 << 10)
    return held


@pytest.mark.parametrize("kind", KINDS)
def test_few_ids_read_few_row_groups(keyed, kind):
    asked = ["5", 77_777, "199999", "00005", "x", "-3", None, "200000", "99999999999999999999999"]
    found = with_ids(keyed[kind], "id", asked)
    described, n_read = scan(found)
    assert sorted(int(r["id"]) for r in found.collect()) == [5, 77_777, 199_999]
    if kind.startswith("decimal"):  # compared as text: nothing to push
        return
    assert "PushedFilters: []" not in described and "id" in described.split("PushedFilters")[1]
    assert 3 <= n_read < 100_000
    many = with_ids(keyed[kind], "id", range(0, 200_000, 5_000))
    assert many.count() == 40 and "In(id" in scan(many)[0]


def test_typed_ids_are_those_that_read_the_same(spark):
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], "s string, b byte, l long, d double").schema}
    asked = [1, "1", "01", " 1", "+1", "1.0", "-0", "-5", "128", None, ""]
    assert typed_ids(asked, kinds["s"]) == ["1", "01", " 1", "+1", "1.0", "-0", "-5", "128", ""]
    assert typed_ids(asked, kinds["b"]) == [1, -5] and typed_ids(asked, kinds["l"]) == [1, -5, 128]
    assert typed_ids(asked, kinds["d"]) is None
    assert with_ids(spark.range(3), "id", []).count() == with_ids(spark.range(3), "id", ["x"]).count() == 0
    for kind in ("string", "int", "double"):
        keys = spark.createDataFrame([("1",), ("12",)], "k string").select(F.col("k").cast(kind).alias("k"))
        text = {"double": ["1.0", "12", "01"]}.get(kind, ["1", "01", "x", "99999999999"])
        asked = spark.createDataFrame([(t,) for t in text], "a string")
        assert asked.join(keys, same_id(F.col("a"), F.col("k"), keys.schema["k"].dataType)).count() == 1


@pytest.mark.parametrize("kind", ["string", "long"])
def test_sources_of_a_few_ids(spark, kind):
    fields = f"id {kind}, value double, year int, metric string, entity string, unit string, source string"
    rows = [(i if kind == "long" else str(i), float(i), 2000, "m", "E", "u", f"/a/B{i % 3}/f{i}") for i in range(30)]
    manifest = spark.createDataFrame([(f"/a/b{i % 3}/f{i}", "done" if i % 2 else "skipped") for i in range(30)], "path string, status string")
    bound = bind(spark.createDataFrame(rows, fields), manifest=manifest, sealed=["/A/b2"])
    treed = E.with_scope_tree(bound)
    got = {r.record_id: r for r in E.get_sources(treed, [4, "7", "7", "07", "5", None]).collect()}
    assert {i: r.outcome for i, r in got.items()} == {"4": "ok", "7": "ok", "07": "no_evidence", "5": "refused_quarantine"}
    assert (got["4"].in_scope, got["4"].done, got["4"].not_done) == (10, 5, 5)
    assert [tuple(s) for s in got["4"].by_status] == [("done", 5), ("skipped", 5)] and got["5"].by_status is None
    asked = spark.createDataFrame([(i,) for i in ("4", "7", "07", "5")], "record_id string")
    assert {r.record_id: r for r in E.get_source(treed, asked).collect()} == got
    assert E.get_sources(bound, ["4"], "/a").first().in_scope == 30
    with pytest.raises(SourceError):
        E.get_sources(bound, range(2000))


def plainly(rows):
    """Counts of every folder and file, by unfolding every path."""
    held = {}
    for path, status in rows:
        held.setdefault("", Counter())[status] += 1
        if path is not None:
            parts = path.replace("\\", "/").lower().split("/")
            for i in range(1, len(parts) + 1):
                if scope := "/".join(parts[:i]):
                    held.setdefault(scope, Counter())[status] += 1
    return {s: sorted(c.items(), key=lambda x: (-x[1], x[0] or "")) for s, c in held.items()}


@pytest.mark.parametrize("levels", [64, 2, 1])
def test_the_tree_is_what_unfolding_gives(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(SC, "LEVELS", levels)
    rows = [("/a/b/c.txt", "done"), ("/a/b/c.txt", "failed"), ("/A\\b/d.txt", "done"), ("/a/bc/e", "skipped"), ("x", "done"), ("", "done"), (None, "failed"),
            ("/a/b/f/g/h/i.txt", "done"), ("rel/q/", "done"), ("//two", "done"), ("/", "skipped")]
    manifest = spark.createDataFrame(rows, "path string, status string")
    tree = SC.build_scope_tree(manifest, str(tmp_path / "tree"))
    got = {r.scope: [tuple(s) for s in r.by_status] for r in tree.collect()}
    assert got == plainly(rows)
    assert all(r.in_scope == sum(s.n for s in r.by_status) for r in tree.collect())
    few = {r.scope for r in SC.nodes_of(tree, ["/a/b", "", "/a/b/f/g", "nowhere"]).collect()}
    assert few == {"/a/b", "", "/a/b/f/g"}


def test_an_empty_manifest_has_a_tree(spark, tmp_path):
    tree = SC.build_scope_tree(spark.createDataFrame([], "path string, status string"), str(tmp_path / "t"))
    assert tree.collect() == []


def test_one_folder_is_read_for_one_id(spark, tmp_path):
    manifest = spark.range(50_000).select(
        F.concat(F.lit("/s/"), (F.col("id") % 500).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("path"), F.lit("done").alias("status")
    )
    tree = SC.build_scope_tree(manifest, str(tmp_path / "t"))
    described, n_read = scan(SC.nodes_of(tree, ["/s/77"]))
    assert n_read <= 500 and "PartitionFilters" in described and "scope" in described.split("PushedFilters")[1]
    assert "Generate" not in SC.nodes_of(tree, ["/s/77"])._jdf.queryExecution().toString()


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    first = TB.replace_table(spark.range(100).withColumn("day", F.lit("01")), path, ["day"])
    TB.create_table_view(spark, path, "kept")
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"), F.lit("02").alias("day"))
    with pytest.raises(PySparkException):
        TB.replace_table(bad, path, ["day"])
    assert TB.read_table(spark, path).count() == spark.table("kept").count() == 100
    assert TB.read_table(spark, path).first()["day"] == "01", "a partition column keeps its type"

    second = TB.replace_table(TB.read_table(spark, path).where("id < 10"), path, ["day"])
    assert second.count() == 10 and first.count() == spark.table("kept").count() == 100, "readers of the old version go on"
    assert TB.create_table_view(spark, path, "kept").count() == 10
    assert TB.read_points(spark, path).count() == TB.read_store(spark, str(tmp_path))["t"].count() == 10
    gone = TB.expire_versions(spark, path)
    assert gone and TB.read_table(spark, path).count() == 10 and TB.expire_versions(spark, path) == []


def test_an_empty_table_can_replace_one(spark, tmp_path):
    path = str(tmp_path / "t")
    TB.replace_table(spark.range(5).withColumn("k", F.lit("a")), path, ["k"])
    empty = TB.replace_table(spark.range(0).withColumn("k", F.lit("a")), path, ["k"])
    assert empty.count() == 0 and sorted(empty.columns) == ["id", "k"]
    assert TB.expire_versions(spark, path, keep=2) == [] and len(TB.expire_versions(spark, path)) == 1


def test_staged_intermediates_can_be_released(spark):
    held = TB.stage(spark.range(4), "x")
    assert held.count() == 4
    TB.release(held)
    with pytest.raises(PySparkException):
        spark.read.parquet(held._staged).count()


def test_staging_leaves_the_session_as_it_is(spark):
    from figtrace.session import staging_path

    before = spark.sparkContext.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)
    a, b = staging_path(spark, "x"), staging_path(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    assert (spark.sparkContext.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)) == before
    if all(x is None for x in before):
        assert "figtrace-" in a
