from __future__ import annotations

import pytest

from figtrace.errors import SchemaContractError, SourceError
from figtrace.session import staging_path
from figtrace.sources.concepts import bind, bind_store, load_aliases, map_columns
from figtrace.sources.manifest import find_manifest, manifest_columns
from figtrace.sources.tables import read_points, read_store, replace_table, stage, write_tsv


def test_the_preferred_table_and_the_manifest_are_bound(store):
    assert store.table == "ask_points"
    assert store.has("data_class")
    assert store.manifest_name == "harvest_manifest"


def test_aliases_bind_in_listed_order_in_any_case():
    m = map_columns(["Amount", "VALUE_NUM", "yr", "Code", "IATA", "uom", "File"])
    assert m["value"] == "VALUE_NUM"
    assert m["entity"] == m["entity_id"] == "IATA"
    assert "Amount" not in m.values() and "currency" not in m


def test_a_concept_the_table_lacks_is_named(spark):
    thin = spark.createDataFrame([(1.0, 2016, "m", "E", "u", "/s")], "value double, year int, metric string, entity string, unit string, source string")
    asked = spark.createDataFrame([("1",)], "record_id string")
    from figtrace.operators import compare as C
    from figtrace.operators import evidence as E

    for question in (lambda: E.get_source(bind(thin), asked), lambda: E.cite(bind(thin)), lambda: C.compare_evidence(bind(thin), asked.withColumn("comparison_id", asked["record_id"]))):
        with pytest.raises(SourceError, match="record_id"):
            question()


def test_ids_are_compared_as_text(spark):
    from figtrace.operators import compare as C
    from figtrace.operators import evidence as E

    fields = "id long, value double, year int, metric string, entity string, unit string, source string"
    bound = bind(spark.createDataFrame([(7, 12345678.0, 2016, "m", "E", "u", "/a/s"), (8, 1e-4, 2016, "m", "E", "u", "/a/s")], fields))
    asked = spark.createDataFrame([("c", "7"), ("c", "u9"), ("c", "8")], "comparison_id string, record_id string")
    found = {r.record_id: r for r in E.get_source(bound, asked.drop("comparison_id")).collect()}
    assert found["u9"].outcome == "no_evidence" and found["7"].citation.startswith("m=12345678.0 u") and found["8"].citation.startswith("m=0.0001 u")
    row = C.compare_evidence(bound, asked).first()
    assert (row.n_held, row.n_missing) == (2, 1)
    for manifest in (None, spark.createDataFrame([("/a/s",)], "path string")):
        from dataclasses import replace

        rows = E.skip_by_status(replace(bound, manifest=manifest, manifest_name="m"), spark.createDataFrame([("/a",)], "scope string")).collect()
        assert [(r.scope, r.status, r.n) for r in rows] == [("/a", "ABSENT", None)]


def test_a_missing_required_concept_is_named():
    with pytest.raises(SchemaContractError) as e:
        map_columns(["value", "year", "metric_code", "unit"], table="t", store="s")
    assert "t of s" in str(e.value) and "nothing holds entity, source among" in str(e.value)


def test_scale_and_basis_bind():
    names = {c.name for c in load_aliases()}
    assert {"value_scale", "basis", "locator_path"} <= names


@pytest.mark.parametrize("text", ["# only a comment\n", "value\tyes\n"])
def test_bad_alias_tables_are_refused(tmp_path, text):
    path = tmp_path / "aliases.tsv"
    path.write_text(text)
    with pytest.raises(SourceError):
        load_aliases(path)
    with pytest.raises(SourceError):
        load_aliases(tmp_path / "absent.tsv")


def test_a_store_without_points_is_refused(spark):
    with pytest.raises(SourceError):
        bind_store({"other": spark.range(1)})


def test_one_column_serves_several_concepts(spark):
    df = spark.createDataFrame(
        [(1.0, 2000, "m", "E", "u", "f", "text")],
        "value double, year int, metric string, iata string, unit string, source string, context string",
    )
    row = bind(df).frame.first()
    assert row["qualifiers"] == row["extract_text"] == "text"
    assert row["entity"] == row["entity_id"] == "E"


def test_manifest_columns_are_found_by_name():
    assert find_manifest(["points", "files_skipped"]) == "files_skipped"
    assert manifest_columns(["file", "the_status"]) == ("file", "the_status")
    assert manifest_columns(["id", "full_path"]) == ("full_path", None)


def test_tables_are_replaced_and_read_in_many_parts(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    replace_table(spark.range(10).repartition(3), path)
    assert replace_table(spark.range(4).repartition(2), path).count() == 4
    assert read_points(spark, path).count() == 4
    assert read_store(spark, str(tmp_path))["t"].count() == 4


def test_staging_uses_the_shared_folder(spark):
    path = staging_path(spark, "x")
    set_for_the_session = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert path.startswith(set_for_the_session) and path != staging_path(spark, "x")
    assert stage(spark.range(3), "y").count() == 3


def test_a_cluster_without_a_shared_folder_is_refused():
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(SourceError):
        staging_path(Cluster, "x")


def test_tsv_has_a_header_no_nulls_and_no_tabs_in_values(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", None, '"q"'), ("", 1, "x")], "t string, n int, q string").coalesce(1)
    write_tsv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_text(encoding="utf-8") == 't\tn\tq\na b\t\t"q"\n\t1\tx\n'
