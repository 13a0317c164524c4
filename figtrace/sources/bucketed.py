"""Two tables bucketed alike on a 128-bit key of wide columns, joined bucket by bucket without an exchange.

The key stands for the columns in shuffles, buckets and sorts; equality is confirmed on the columns themselves. Keys
that hold more than a bucket's share of the rows get several salts: their rows are spread over that many buckets, and
the other side has them once for each salt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("_k1", "_k2", "_salt")
_SECOND = 0x2545F491


@dataclass(frozen=True)
class BucketedTable:
    """A bucketed table of rows by the text columns ``keys`` (new ones, from expressions), and its keys of many salts."""

    spark: SparkSession
    name: str
    path: str
    keys: tuple[str, ...]
    buckets: int

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def salts(self) -> DataFrame:
        """(_k1, _k2, _salts): keys of more rows than a bucket's share, so at most as many as there are buckets."""
        return self.spark.read.schema("_k1 long, _k2 long, _salts int").parquet(f"{self.path}/salts")


def _hashed(keys: Sequence[str]) -> dict[str, Column]:
    columns = [F.col(k) for k in keys]
    return {"_k1": F.xxhash64(*columns), "_k2": F.xxhash64(F.lit(_SECOND), *columns[::-1])}


def _write(df: DataFrame, name: str, path: str, buckets: int) -> None:
    # The shuffle deals rows out as buckets do, so each bucket is one file.
    dealt = df.repartition(buckets, *KEY).sortWithinPartitions(*KEY)
    dealt.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", f"{path}/{name}").saveAsTable(name)


def write_bucketed(rows: DataFrame, keys: Mapping[str, Column], name: str, path: str, *, buckets: int = 64) -> BucketedTable:
    """Write rows bucketed by the key of some expressions, which become columns of those names.

    Rows are spread over a hot key's salts by a hash of all their columns.
    """
    spark = rows.sparkSession
    keyed = rows.withColumns(dict(keys)).withColumns(_hashed(list(keys)))
    counts = keyed.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.ceil(F.lit(rows.count()) / buckets), F.lit(1))
    hot = counts.where(F.col("_n") > share).select("_k1", "_k2", F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    hot.write.parquet(f"{path}/salts")
    table = BucketedTable(spark, name, path, tuple(keys), buckets)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if not _is_map(rows, c)])
    # At most one key for every bucket: small enough to send.
    salted = keyed.join(F.broadcast(table.salts()), ["_k1", "_k2"], "left")
    salt = F.coalesce(F.pmod(spread, F.col("_salts")), F.lit(0)).cast("int")
    _write(salted.select(*rows.columns, *keys, "_k1", "_k2", salt.alias("_salt")), name, path, buckets)
    return table


def _is_map(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString().startswith("map")


def write_lookup(lookup: DataFrame, of: BucketedTable, keys: Mapping[str, str], name: str) -> DataFrame:
    """Write a lookup (one row per key) bucketed like a table, its rows repeated for each salt of their key.

    ``keys`` names the lookup's column for each of the table's; its rows are found by them.
    """
    renamed = lookup.withColumns({f"_of_{k}": F.col(c) for k, c in keys.items()})
    hashed = _hashed([f"_of_{k}" for k in of.keys])
    keyed = renamed.withColumns(hashed).join(F.broadcast(of.salts()), ["_k1", "_k2"], "left")
    salt = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)).alias("_salt")
    _write(keyed.select(*lookup.columns, *[f"_of_{k}" for k in of.keys], "_k1", "_k2", salt), name, of.path, of.buckets)
    return of.spark.table(name)


def join_lookup(table: BucketedTable, lookup: DataFrame, values: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The table's columns ``names`` and the lookup's ``values``; rows without a partner, or with NULL in a key, have none."""
    left = table.frame()
    right = lookup.select(*[F.col(c).alias(f"_right{c}") for c in KEY], *[f"_of_{k}" for k in table.keys], *values)
    same_key = [F.col(c) == F.col(f"_right{c}") for c in KEY]
    # Equal columns, in a form that is checked on the pairs and does not become a join key.
    same_text = [F.col(k).between(F.col(f"_of_{k}"), F.col(f"_of_{k}")) for k in table.keys]
    return left.join(right.hint("merge"), reduce(and_, [*same_key, *same_text]), "left").select(*names, *values)
