from __future__ import annotations

from figtrace.functions.rules import COPY_MARKERS
from figtrace.operators import dedup as D
from figtrace.operators import repetition as RP

FIELDS = "source_file string, location string, value_num double"


def _points(spark, docs):
    return spark.createDataFrame([(path, c, v) for path, cells in docs.items() for c, v in cells], FIELDS)


CELLS = [("A1", 1.0), ("A2", 2.0), ("A3", None)]
DOCS = {
    "/x/Old Project Files/b.xlsx": CELLS,
    "/x/deep/er/b.xlsx": list(reversed(CELLS)),
    "/x/longer name.xlsx": CELLS,
    "/x/b.xlsx": CELLS,
    "/x/a.xlsx": CELLS,
    "/x/other.xlsx": [("A1", 1.0), ("A2", 2.0)],
    "": CELLS,
}


def test_one_path_per_content(spark):
    found = {r.source_file: r for r in D.canonical_map(_points(spark, DOCS)).collect()}
    assert "" not in found and len(found) == 6
    assert {r.canonical_source_file for r in found.values() if r.copies == 5} == {"/x/a.xlsx"}
    assert [p for p, r in found.items() if r.is_canonical] and sum(r.is_canonical for r in found.values()) == 2
    assert found["/x/Old Project Files/b.xlsx"].copy_penalty == 1 and found["/x/deep/er/b.xlsx"].depth == 4


def test_every_text_is_answered(spark):
    docs = [(1, "a\nb", "/x"), (2, "a\nb", "/x"), (3, None, "/y"), (4, "", None), (5, "b\na", None), (6, None, None), (7, "a\nb", "/old/x")]
    found = {r.doc_id: r for r in D.text_dedup(spark.createDataFrame(docs, "doc_id long, text string, path string")).collect()}
    assert {i: (r.canonical_doc_id, r.copies) for i, r in found.items()} == {
        1: (1, 3), 2: (1, 3), 7: (1, 3), 3: (4, 3), 4: (4, 3), 6: (4, 3), 5: (5, 1)
    }
    assert [i for i, r in found.items() if r.is_canonical and i not in (1, 4, 5)] == []


def test_the_fingerprint_tells_pairs_apart(spark):
    docs = {"/a": [("k|", 1.0), ("m", 1.0), ("m", 1.0)], "/b": [("k|", 1.0), ("n", 1.0), ("n", 1.0)], "/c": [("k", 1.0), ("m", 1.0), ("m", 1.0)]}
    found = D.canonical_map(_points(spark, docs)).collect()
    assert all(r.is_canonical and r.copies == 1 for r in found)


def test_the_hash_sum_is_the_plain_sum(spark):
    from pyspark.sql import functions as F

    p = _points(spark, DOCS).where("source_file <> ''")
    h = F.xxhash64(F.coalesce("location", F.lit("")), F.coalesce(F.col("value_num").cast("string"), F.lit("")))
    plain = {r[0]: [x % 2**64 for x in r[1]] for r in p.groupBy("source_file").agg(F.collect_list(h)).collect()}
    found = {r.source_file: r for r in D.fingerprint(p).collect()}
    for path, hashes in plain.items():
        assert int(found[path].h_sum) == sum(hashes)


def test_markers_are_a_parameter(spark):
    found = D.canonical_map(_points(spark, DOCS), markers=[*COPY_MARKERS, "%/x/a%"]).collect()
    assert {r.canonical_source_file for r in found if r.copies == 5} == {"/x/b.xlsx"}


def test_report(spark):
    row = D.with_reduction(D.dedup_report(D.canonical_map(_points(spark, DOCS)))).first()
    assert (row.docs, row.canonical_docs, row.duplicate_docs) == (6, 2, 4)
    assert (row.points, row.canonical_points, row.copied_points, row.copied_pct, row.reduction) == (17, 5, 12, 70.6, 3.4)


def test_repetition_ratio_of_nothing_is_zero(spark):
    fields = "metric_code string, entity string, entity_id string, year int, value_num double, unit string, source_file string"
    p = spark.createDataFrame([("m", "E", "e", 2000, 1.0, "u", "/a")] * 3, fields)
    rows = {r.metric: r for r in RP.with_ratio(RP.repetition_scope(p, [("m", "E"), ("none", "E")])).collect()}
    assert (rows["m"].n_rows, rows["m"].n_distinct, rows["m"].repetition) == (3, 1, 3.0)
    assert (rows["none"].n_rows, rows["none"].repetition) == (0, 0.0)
