"""Reading and writing the tables of a store."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from figtrace.errors import SourceError
from figtrace.session import staging_path

# Where a replaced table has its versions, and which of them is the table; Spark passes over both names.
VERSIONS, CURRENT = "_versions", "_current"


def read_points(spark: SparkSession, *paths: str) -> DataFrame:
    """A Parquet store, in one part or many; only the columns and rows a question needs are read."""
    if not paths:
        raise SourceError("no path to read points from")
    if len(paths) == 1:
        return read_table(spark, paths[0])
    versions = [(p, current_version(spark, p)) for p in paths]
    return spark.read.parquet(*[f"{p}/{VERSIONS}/{v}" if v else p for p, v in versions])


def read_store(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every ``<name>.parquet`` (file or folder) below a folder, as name to DataFrame."""
    if names is None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        listing = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)
        names = sorted(Path(s.getPath().getName()).stem for s in listing if s.getPath().getName().endswith(".parquet"))
    return {name: read_table(spark, f"{folder}/{name}.parquet") for name in names}


def with_data_class(points: DataFrame, temporality: str = "temporality", scenario: str = "scenario") -> DataFrame:
    """Add ``data_class``: forecast, fact, assumption or unclassified."""
    when, case = F.lower(temporality), F.lower(scenario)
    return points.withColumn(
        "data_class",
        F.when(when == "forecast", "forecast")
        .when(when == "actual", "fact")
        .when(case.isin("high", "low"), "assumption")
        .otherwise("unclassified"),
    )


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table in place of what the path held, and read it back.

    A new version is written beside the old one, and becomes the table by the rename of one small file. A write that
    fails leaves the old table as it was; frames and views over the old version stay valid until
    ``expire_versions``, and the source may be the table itself. Rows of one partition folder are gathered into few files, while a folder
    holding a large share of the rows is still written by many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    spark, version = df.sparkSession, f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("error").partitionBy(*partition_by).parquet(f"{path}/{VERSIONS}/{version}")
    _point(spark, path, {"version": version, "schema": df.schema.jsonValue()})
    return read_table(spark, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of a path: its current version where ``replace_table`` wrote it, else the files of the path itself."""
    held = _current(spark, path)
    if held is None:
        return spark.read.parquet(path)
    schema = StructType.fromJson(held["schema"])
    return spark.read.schema(schema).parquet(f"{path}/{VERSIONS}/{held['version']}")


def current_version(spark: SparkSession, path: str) -> str | None:
    held = _current(spark, path)
    return held and held["version"]


def _current(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, f"{path}/{CURRENT}")
    return text and json.loads(text)


def expire_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete versions older than the current one but the ``keep`` - 1 last of them; what was deleted.

    Versions a write has left unfinished go with them, those newer than the current one stay.
    """
    current = current_version(spark, path)
    if current is None:
        return []
    fs, folder = file_system(spark, f"{path}/{VERSIONS}")
    older = sorted(v for v in (s.getPath().getName() for s in fs.listStatus(folder)) if v < current)
    gone = older[: max(0, len(older) - (keep - 1))]
    for version in gone:
        delete_path(spark, f"{path}/{VERSIONS}/{version}")
    return gone


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, whatever it is, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is no such file."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = file_system(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, held: dict) -> None:
    """Make a version the current one: the pointer is written aside and renamed over the old one, which is atomic."""
    written = f"{path}/{CURRENT}.{held['version']}"
    write_text(spark, written, json.dumps(held))
    jvm, (_, pointer), (_, aside) = spark._jvm, file_system(spark, f"{path}/{CURRENT}"), file_system(spark, written)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, pointer, options)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once so that several questions share it, and read it back.

    It goes to the shared folder, so losing executors does not lose it, and it has no lineage left.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._staged = path
    return held


def release(*frames: DataFrame) -> None:
    """Delete staged intermediates that nothing reads any more."""
    for df in frames:
        delete_path(df.sparkSession, df._staged)


def create_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def create_table_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A view over the current version of a table; call it again to follow a replaced one."""
    return create_view(read_table(spark, path), name)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A report as text columns; an empty cell is NULL."""
    return spark.read.csv(path, sep="\t", header=True, quote="", encoding="UTF-8")


def write_tsv(df: DataFrame, path: str) -> None:
    """A tab-separated report with a header: NULL is empty and tabs inside values become spaces."""
    cells = [
        F.coalesce(F.translate(F.col(f"`{c}`").cast("string"), "\t", " "), F.lit("")).alias(c) for c in df.columns
    ]
    df.select(cells).write.mode("overwrite").csv(
        path, sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="", encoding="UTF-8"
    )
