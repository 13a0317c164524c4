from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from figtrace.functions.redact import REDACTED, redact
from figtrace.streaming import audit
from figtrace.streaming.audit import ENTRY, AuditContext, append_audit, compact_audit, expire_audit, read_audit, stream_audit

CONTEXT = AuditContext("explicit", "/store", "1", "host", 7)
FIELDS = "ts timestamp, user string, tool string, filters map<string,string>, record_ids array<string>"
CALLS = [
    (datetime(2024, 1, 1, 23, 59, 59, 5000), "ann", "search", {"metric": "aero", "API_Key": "k"}, ["p1", "p2"]),
    (datetime(2024, 1, 2), "", "get_source", None, None),
]


def _calls(spark):
    return spark.createDataFrame(CALLS, FIELDS)


def test_secrets_are_replaced_at_any_depth(spark):
    inner = T.StructType([T.StructField("name", T.StringType()), T.StructField("PassWord", T.StringType())])
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("auth", T.StructType([T.StructField("x", T.LongType())])),
            T.StructField("rows", T.ArrayType(T.ArrayType(inner))),
            T.StructField("m", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
            T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
        ]
    )
    row = (1, (5,), [[("n", "s"), None]], {"a": {"my_token": "t", "k": "v"}}, {"keys": 3, "n": 4})
    got = redact(spark.createDataFrame([row], schema)).first()
    assert got.id == 1 and got.auth == REDACTED
    assert got.rows[0][0].asDict() == {"name": "n", "PassWord": REDACTED} and got.rows[0][1] is None
    assert got.m == {"a": {"my_token": REDACTED, "k": "v"}} and got.counts == {"keys": None, "n": 4}


def test_entries_are_appended_by_day(spark, tmp_path):
    folder = str(tmp_path / "log")
    append_audit(_calls(spark), CONTEXT, folder)
    append_audit(_calls(spark).limit(1), CONTEXT, folder)
    rows = read_audit(spark, folder)
    assert {str(r.day): r.n for r in rows.groupBy("day").agg(F.count("*").alias("n")).collect()} == {"2024-01-01": 2, "2024-01-02": 1}
    first = rows.where("day = '2024-01-01'").first()
    assert first.ts == "2024-01-01T23:59:59.005+00:00" and first.record_ids == ["p1", "p2"] and first.record_count == 2
    assert first.filters == {"metric": "aero", "API_Key": REDACTED}
    line = next((tmp_path / "log" / "day=2024-01-02").glob("batch=*/*.json")).read_text().splitlines()[0]
    entry = json.loads(line)
    assert list(entry) == [
        "ts", "user", "tool", "filters", "record_ids", "record_count", "outcome", "detail", "skipped", "store_kind",
        "store_path", "service_version", "hostname", "pid",
    ]
    assert entry["user"] == "unknown" and entry["record_ids"] == [] and entry["outcome"] == "ok"


def test_a_stream_writes_the_same_entries(spark, tmp_path):
    source = str(tmp_path / "in")
    _calls(spark).write.parquet(source)
    stream = spark.readStream.schema(_calls(spark).schema).parquet(source)
    folder = str(tmp_path / "log")
    for _ in range(2):  # a restart appends nothing twice
        query = stream_audit(stream, CONTEXT, folder, str(tmp_path / "ck"))
        query.awaitTermination(60)
    batch = str(tmp_path / "batch")
    append_audit(_calls(spark), CONTEXT, batch)
    a, b = (sorted(map(str, read_audit(spark, f).collect())) for f in (folder, batch))
    assert a == b and len(a) == 2


def test_a_batch_written_again_counts_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    for _ in range(2):
        append_audit(_calls(spark), CONTEXT, folder, "b1")
    append_audit(_calls(spark), CONTEXT, folder, "b2")
    assert read_audit(spark, folder).count() == 2 * _calls(spark).count()
    assert read_audit(spark, str(tmp_path / "nothing")).collect() == []


def test_compacted_days_read_the_same(spark, tmp_path):
    folder = str(tmp_path / "log")
    for i in range(3):
        append_audit(_calls(spark), CONTEXT, folder, f"b{i}")
    before = read_audit(spark, folder)
    want = sorted(map(str, before.collect()))
    assert compact_audit(spark, folder, before="2024-01-02") == ["2024-01-01"]
    assert sorted(map(str, read_audit(spark, folder).collect())) == sorted(map(str, before.collect())) == want
    append_audit(_calls(spark), CONTEXT, folder, "b1")  # run again after it was compacted
    assert sorted(map(str, read_audit(spark, folder).collect())) == want
    append_audit(_calls(spark), CONTEXT, folder, "b3")
    assert sorted(compact_audit(spark, folder)) == ["2024-01-01", "2024-01-02"] and compact_audit(spark, folder) == []
    now = sorted(map(str, read_audit(spark, folder).collect()))
    assert len(now) == len(want) // 3 * 4
    assert expire_audit(spark, folder) == 9 and expire_audit(spark, folder) == 0
    assert sorted(map(str, read_audit(spark, folder).collect())) == now
    assert read_audit(spark, folder).schema == ENTRY
    for day in (tmp_path / "log").glob("day=*"):
        assert len(list(day.glob("batch=*/*.json"))) == 1


def test_two_streams_do_not_replace_each_other(spark, tmp_path):
    source = str(tmp_path / "in")
    _calls(spark).write.parquet(source)
    stream = spark.readStream.schema(_calls(spark).schema).parquet(source)
    folder = str(tmp_path / "log")
    for checkpoint in ("one", "two"):
        stream_audit(stream, CONTEXT, folder, str(tmp_path / checkpoint)).awaitTermination(60)
    assert read_audit(spark, folder).count() == 2 * _calls(spark).count()


def test_a_compacted_batch_is_not_written_again(spark, tmp_path):
    folder = str(tmp_path / "log")
    for name in ("b0", "b1"):
        append_audit(_calls(spark), CONTEXT, folder, name)
    want = sorted(map(str, read_audit(spark, folder).collect()))
    compact_audit(spark, folder, before="2024-01-02")
    expire_audit(spark, folder)
    append_audit(_calls(spark), CONTEXT, folder, "b1")
    assert sorted(map(str, read_audit(spark, folder).collect())) == want
    assert [d.name for d in (tmp_path / "log").glob("day=*/batch=b1")] == ["batch=b1"]  # of the day that was not compacted


def test_large_days_are_compressed_when_compacted(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "log")
    more = _calls(spark).unionAll(_calls(spark).limit(1).withColumn("user", F.lit("x" * 5000)))
    for name in ("b0", "b1"):
        append_audit(more, CONTEXT, folder, name)
    want = sorted(map(str, read_audit(spark, folder).collect()))
    monkeypatch.setattr(audit, "LARGE_DAY", 5000)
    assert sorted(compact_audit(spark, folder)) == ["2024-01-01", "2024-01-02"]
    expire_audit(spark, folder)
    assert sorted(map(str, read_audit(spark, folder).collect())) == want
    kinds = {f.parent.parent.name: f.name.split(".", 2)[2] for f in (tmp_path / "log").glob("day=*/batch=*/part-*")}
    assert kinds == {"day=2024-01-01": "json.gz", "day=2024-01-02": "json"}
