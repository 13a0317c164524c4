"""A scope's reports come from one pass over the store, and nothing staged is left."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks import inputs as I
from figtrace.operators import profile as P
from figtrace.operators import scope_run as SR
from figtrace.operators import tag_reports as TR
from figtrace.operators import tagging as T
from figtrace.sources.tables import read_tsv

SF = "/root/testdata/sf0.001"
WANTED = SR.Wanted(years=(1990, 2005), year=1998)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Points and their canonical documents."""
    points, canonical = I.points(spark, SF), I.canonical(spark, SF)
    path = str(tmp_path_factory.mktemp("store"))
    points.write.parquet(path + "/points")
    canonical.write.parquet(path + "/canonical")
    return spark.read.parquet(path + "/points"), spark.read.parquet(path + "/canonical")


def test_reports_equal_those_over_the_store(spark, store):
    points, canonical = store
    scope = SR.stage_scope(points, entity="N7", canonical=canonical)
    kept = T.in_scope(points, "N7", canonical)
    assert scope.n_points == kept.count() == scope.points.count() > 0
    got = SR.context_reports(scope, WANTED) | SR.tag_reports(scope, WANTED)
    coded, tagged = kept.where("metric_code = 'rev_aero'"), T.tag_points(kept)
    want = {
        "scope_shape": P.tag_shape(kept, "rev_aero"), "context_shape": P.context_shape(coded), "context_by_label": P.label_profile(coded),
        "context_band": P.value_band(coded), "context_untagged": P.untagged_reclaim(kept), "tag_claims": TR.tag_claims(tagged),
        "gold_by_year": TR.gold_by_year(tagged, years=WANTED.years), "veto_audit": TR.veto_audit(tagged),
        "before_after": TR.tag_before_after(tagged, WANTED.year), "tag_money": TR.tag_money(tagged),
    }
    for name, df in want.items():
        assert sorted(map(str, got[name].collect())) == sorted(map(str, df.collect())), name
    assert got["tag_money"].where("currency = '' OR price_basis = ''").count() == 0
    for name, df in got.items():
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "Relation" in plan and "location" not in df.columns, name
        assert set(df.inputFiles()) <= set(scope.points.inputFiles()), f"{name} reads more than the staged scope"
    scope.release()


def test_a_scope_classifies_repeated_contexts_once(spark, store, monkeypatch):
    """Rules ran on each point of a scope before; what is written for it goes with the staging."""
    points, canonical = store
    often = points.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9))))
    seen, tags = [], []
    monkeypatch.setattr(SR, "stage", lambda df, name, keep=SR.stage: seen.append(df) or keep(df, name))
    monkeypatch.setattr(T, "stage", lambda df, name, keep=T.stage: tags.append(keep(df, name)) or tags[-1])
    scope = SR.stage_scope(often, entity="N7", canonical=canonical)
    assert "penetration" not in seen[0]._jdf.queryExecution().executedPlan().toString() and len(tags) == 1
    kept = T.tag_points(T.in_scope(often, "N7", canonical), tags=SR.REPORT_TAGS).select(scope.points.columns)
    assert scope.n_points == kept.count() > 0 and scope.points.exceptAll(kept).count() == kept.exceptAll(scope.points).count() == 0
    scope.release()
    with pytest.raises(PySparkException):
        spark.read.parquet(tags[0]._staged).count()


def test_a_run_writes_reports_and_leaves_nothing(spark, store, tmp_path, monkeypatch):
    points, canonical = store
    staged = []
    monkeypatch.setattr(SR, "stage", lambda df, name, keep=SR.stage: staged.append(keep(df, name)) or staged[-1])
    told = SR.run_scope(points, str(tmp_path / "out"), entity="N7", canonical=canonical, wanted=WANTED)
    assert told["n_points"] == T.in_scope(points, "N7", canonical).count() and len(told["reports"]) == 15
    back = read_tsv(spark, str(tmp_path / "out" / "scope_shape.tsv")).first()
    assert int(back["n_rows"]) == told["n_points"]
    labels = read_tsv(spark, str(tmp_path / "out" / "context_by_label.tsv"))
    assert labels.columns[:3] == ["label", "cue", "unit"] and labels.count() == P.label_profile(T.in_scope(points, "N7", canonical).where("metric_code = 'rev_aero'")).count()
    assert len(staged) == 1
    with pytest.raises(PySparkException):
        spark.read.parquet(staged[0]._staged).count()


def test_a_failing_report_leaves_nothing(spark, store, tmp_path, monkeypatch):
    staged = []
    monkeypatch.setattr(SR, "stage", lambda df, name, keep=SR.stage: staged.append(keep(df, name)) or staged[-1])
    bad = {"bad": lambda scope, wanted: {"bad": scope.points.select(F.raise_error(F.lit("no")).alias("x"))}}
    with pytest.raises(PySparkException):
        SR.run_scope(store[0], str(tmp_path / "out"), kinds=bad)
    with pytest.raises(PySparkException):
        spark.read.parquet(staged[0]._staged).count()
