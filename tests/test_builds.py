from __future__ import annotations

from checks import inputs as I
from figtrace.operators import builds as B
from figtrace.operators.builds import CANONICAL, STATE, build_document_tables, update_document_tables
from figtrace.operators.dedup import fingerprint_state
from figtrace.operators import tagging as T
from figtrace.sources.tables import read_table, replace_table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_document_tables(spark, tmp_path):
    p = I.points(spark, SF)
    fingerprints, canonical = B.build_document_tables(p, str(tmp_path))
    groups = fingerprints.select("n_points", "h_sum", "h_xor").distinct().count()
    assert fingerprints.count() == canonical.count() == 268
    assert canonical.where("is_canonical").count() == groups == 199


def test_tag_table_and_view(spark, tmp_path):
    p = I.points(spark, SF)
    tags, view = B.build_tag_table(p, str(tmp_path))
    assert spark.table("ask_points_v2").count() == view.count() == p.count()
    assert view.exceptAll(T.tag_points(p)).count() == 0
    assert tags.count() == T.context_tags(p).count()


def test_tagging_one_entity_without_copies(spark, tmp_path):
    p, canonical = I.points(spark, SF), I.canonical(spark, SF)
    _, view = B.build_tag_table(p, str(tmp_path), entity="N7", canonical=canonical, view="one_entity")
    tagged = view.where("magnitude_check <> 'untagged'")
    assert view.count() == p.count() and 0 < tagged.count() < p.count() / 10
    preview = B.preview_tags(p, entity="N7", canonical=canonical)
    assert preview.count() == T.in_scope(p, "N7", canonical).count() == preview.select("point_id").distinct().count()
    assert preview.agg(F.count_if(F.col("entity_id") != "N7")).first()[0] == 0


def _figures(*rows):
    return [(path, f"S!{i}", v) for path, values in rows for i, v in enumerate(values)]


def test_updated_document_tables_equal_built_ones(spark, tmp_path):
    """Documents that grow, shrink, vanish, appear, and leave or join groups of copies."""
    fields = "source_file string, location string, value_num double"
    make = lambda rows: spark.createDataFrame(rows, fields)
    held = _figures(("/a/x", [1.0, 2.0]), ("/b/x", [1.0, 2.0]), ("/c/x", [1.0]), ("/d/y", [5.0]), ("/e/y", [5.0]), ("/f/z", [9.0]), ("", [1.0]), ("/g/alone", [4.0]))
    added = [("/c/x", "S!1", 2.0), ("/h/y", "S!0", 5.0), ("/new", "S!0", 7.0), (None, "S!0", 1.0)]
    removed = [("/a/x", "S!1", 2.0), ("/f/z", "S!0", 9.0)]
    after = [r for r in held if r not in removed] + added
    folder, want = str(tmp_path / "t"), str(tmp_path / "want")
    build_document_tables(make(held), folder)
    got = update_document_tables(folder, make(added), make(removed))
    for a, b in zip(got, build_document_tables(make(after), want)):
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))
    again = update_document_tables(folder, removed=make(added))[1]
    assert {r.source_file for r in again.collect()} == {r[0] for r in held if r not in removed and r[0]}
    only = update_document_tables(folder, added=make([("/g/alone", "S!1", 1.0)]))[1]
    assert {r.source_file: r.n_points for r in only.collect()}["/g/alone"] == 2
    state = read_table(spark, f"{folder}/{STATE}")
    whole = fingerprint_state(make([r for r in held if r not in removed] + [("/g/alone", "S!1", 1.0)]))
    assert sorted(map(str, state.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_untouched_groups_are_not_nominated_again(spark, tmp_path):
    fields = "source_file string, location string, value_num double"
    folder = str(tmp_path / "t")
    _, canonical = build_document_tables(spark.createDataFrame(_figures(("/a/x", [1.0]), ("/b/x", [1.0]), ("/c", [2.0])), fields), folder)
    marked = canonical.withColumn("copies", F.when(F.col("source_file") != "/c", 99).otherwise(F.col("copies")).cast("long"))
    replace_table(marked, f"{folder}/{CANONICAL}")
    got = {r.source_file: r.copies for r in update_document_tables(folder, spark.createDataFrame([("/c", "S!1", 3.0)], fields))[1].collect()}
    assert got == {"/a/x": 99, "/b/x": 99, "/c": 1}
