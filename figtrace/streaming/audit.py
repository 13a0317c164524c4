"""The audit trail: who asked what, which records were returned, from which store.

Entries are shaped row by row, so the same functions serve a batch and a stream. The trail keeps
record ids and filters, never what a record said.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from figtrace.errors import SourceError
from figtrace.functions.redact import redacted
from figtrace.sources.tables import delete_path, file_system, read_text, write_text

# How folders of compacted batches begin, and the file in them that lists what they replace; Spark passes over it.
COMPACTED, COVERS = "batch=compacted-", "_covers"
# A day that holds more bytes than this is compressed when it is compacted.
LARGE_DAY = 64 << 20

FILTERS = T.MapType(T.StringType(), T.StringType())
ENTRY = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("filters", FILTERS),
        T.StructField("record_ids", T.ArrayType(T.StringType())),
        T.StructField("record_count", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("skipped", FILTERS),
        T.StructField("store_kind", T.StringType()),
        T.StructField("store_path", T.StringType()),
        T.StructField("service_version", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("pid", T.IntegerType()),
        T.StructField("day", T.DateType()),
    ]
)


@dataclass(frozen=True)
class AuditContext:
    """What answered; stamped on every entry."""

    store_kind: str
    store_path: str
    service_version: str
    hostname: str = ""
    pid: int = 0


def audit_entries(calls: DataFrame, context: AuditContext) -> DataFrame:
    """Shape calls into entries of ``ENTRY``.

    ``calls`` has ``ts`` (timestamp) and ``tool``, and may have user, filters, record_ids, outcome,
    detail and skipped. Values under secret-named keys are replaced; the day is the UTC one.
    """
    held = dict(zip(calls.columns, calls.schema.fields))

    def column(name: str, kind: T.DataType, default: Column) -> Column:
        if name not in held:
            return default.cast(kind)
        return F.coalesce(redacted(F.col(name), held[name].dataType).cast(kind), default.cast(kind))

    text, ids = T.StringType(), T.ArrayType(T.StringType())
    none = F.create_map().cast(FILTERS)
    record_ids = column("record_ids", ids, F.array().cast(ids))
    # A timestamp without a zone is taken as UTC; one with a zone is shown in UTC.
    zoneless = isinstance(calls.schema["ts"].dataType, T.TimestampNTZType)
    utc = F.col("ts") if zoneless else F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz"))
    return calls.select(
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'").alias("ts"),
        F.coalesce(F.nullif(column("user", text, F.lit("unknown")), F.lit("")), F.lit("unknown")).alias("user"),
        F.col("tool").cast("string").alias("tool"),
        column("filters", FILTERS, none).alias("filters"),
        record_ids.alias("record_ids"),
        F.size(record_ids).alias("record_count"),
        column("outcome", text, F.lit("ok")).alias("outcome"),
        column("detail", text, F.lit("")).alias("detail"),
        column("skipped", FILTERS, none).alias("skipped"),
        F.lit(context.store_kind).alias("store_kind"),
        F.lit(context.store_path).alias("store_path"),
        F.lit(context.service_version).alias("service_version"),
        F.lit(context.hostname).alias("hostname"),
        F.lit(context.pid).alias("pid"),
        F.to_date(utc).alias("day"),
    )


def append_audit(calls: DataFrame, context: AuditContext, folder: str, batch: str | None = None) -> None:
    """Append a batch of calls to the trail, as JSON lines in one folder per UTC day and batch.

    A batch that is written again under its name replaces what it wrote, so it counts once; days on which it was
    compacted are left out, as readers pass over it there. A day's entries are gathered into few files first; a day that
    holds most of them is still written by many tasks.
    """
    entries = audit_entries(calls, context)
    if batch:
        covered = _covered(entries.sparkSession, folder)
        done = [day.removeprefix("day=") for day, names in covered.items() if f"batch={batch}" in names and "__" not in day]
        entries = entries.where(F.coalesce(~F.col("day").cast("string").isin(done), F.lit(True))) if done else entries
    _write(entries, folder, batch or uuid.uuid4().hex)


def _write(entries: DataFrame, folder: str, batch: str) -> None:
    named = entries.withColumn("batch", F.lit(batch)).hint("rebalance", "day")
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch")
    writer.option("ignoreNullFields", "false").json(folder)


def stream_audit(calls: DataFrame, context: AuditContext, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep appending a stream of calls to the trail.

    Each micro-batch is gathered by day like a batch. It is named by the query's id, which the checkpoint keeps, and
    its number, so one that is run again after a failure counts once. Nothing is held between rows: no state or
    watermark is needed.
    """

    def append(entries: DataFrame, number: int) -> None:
        query = entries.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        _write(entries, folder, f"{query}-{number}")

    writer = audit_entries(calls, context).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The trail as it is now; a filter on ``day`` reads only those days.

    Batches that were compacted are read from the compacted one. What is listed are folders, one for each day and
    batch, of which ``compact_audit`` leaves one a day.
    """
    paths = [f"{folder}/{day}/{batch}" for day, held in _batches(spark, folder).items() for batch in held]
    if not paths:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("basePath", folder).json(paths).drop("batch")


def compact_audit(spark: SparkSession, folder: str, before: str | None = None) -> list[str]:
    """Rewrite each day (before a day, ``YYYY-MM-DD``) that has several batches as one, in few files; the days done.

    Days of more than ``LARGE_DAY`` bytes become gzip files of the same lines.
    The new batch names those it replaces and appears by one rename; from then on readers pass over them, and over a
    replay of one of them. ``expire_audit`` deletes them once no reader is left.
    """
    fs, _ = file_system(spark, folder)
    at = spark._jvm.org.apache.hadoop.fs.Path
    todo = {d: held for d, held in _batches(spark, folder).items() if len(held) > 1 and (before is None or d < f"day={before}")}
    if not todo:
        return []
    name = f"{COMPACTED}{uuid.uuid4().hex}"
    aside = f"{folder}/_aside/{name}"
    large = {d for d, held in todo.items() if sum(fs.getContentSummary(at(f"{folder}/{d}/{b}")).getLength() for b in held) > LARGE_DAY}
    for days, codec in ((todo.keys() - large, "none"), (large, "gzip")):
        paths = [f"{folder}/{d}/{b}" for d in sorted(days) for b in todo[d]]
        if paths:
            entries = spark.read.schema(ENTRY).option("basePath", folder).json(paths).drop("batch")
            writer = entries.hint("rebalance", "day").write.mode("append").partitionBy("day").option("ignoreNullFields", "false")
            writer.option("compression", codec).json(aside)
    for day, held in todo.items():
        fs.mkdirs(at(f"{aside}/{day}"))  # a day without entries has no folder yet
        write_text(spark, f"{aside}/{day}/{COVERS}", json.dumps(held))
        if not fs.rename(at(f"{aside}/{day}"), at(f"{folder}/{day}/{name}")):
            raise SourceError(f"the compacted entries of {day} could not be put in place")
    delete_path(spark, aside)
    return [d.removeprefix("day=") for d in todo]


def expire_audit(spark: SparkSession, folder: str) -> int:
    """Delete the batches that a compacted one replaces; how many. Readers that listed them before must be done."""
    gone = 0
    for day, held in _batches(spark, folder).items():
        for batch in _folders(spark, f"{folder}/{day}"):
            if batch not in held:
                delete_path(spark, f"{folder}/{day}/{batch}")
                gone += 1
    return gone


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
    return sorted(n for n in names if "=" in n)


def _covered(spark: SparkSession, folder: str) -> dict[str, set[str]]:
    """The batches of every day that a compacted one covers."""
    covered = {}
    for day in _folders(spark, folder):
        covers = (read_text(spark, f"{folder}/{day}/{b}/{COVERS}") for b in _folders(spark, f"{folder}/{day}") if b.startswith(COMPACTED))
        covered[day] = {b for text in covers if text for b in json.loads(text)}
    return covered


def _batches(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The folders of every day that count: all but those a compacted one covers."""
    return {day: [b for b in _folders(spark, f"{folder}/{day}") if b not in names] for day, names in _covered(spark, folder).items()}
