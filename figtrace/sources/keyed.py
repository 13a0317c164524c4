"""Points tables laid out by their key, and lookups that read little of them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The most values of one pushed IN that are looked up one by one in statistics, dictionaries and bloom filters.
PUSHED = 10
# Requests of up to so many ids go to the scan as values; larger ones are joined.
SMALL = 1000
_WHOLE = re.compile(r"0|-?[1-9][0-9]*")
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def write_keyed(points: DataFrame, path: str, key: str, *, row_group_bytes: int = 16 << 20) -> DataFrame:
    """Write points in ranges of their key, sorted, with a bloom filter on it in every row group; read them back.

    Ranges split between values only: rows of one value stay together, which a key has few of.
    """
    ordered = points.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    options = {
        f"parquet.bloom.filter.enabled#{key}": "true",
        "parquet.bloom.filter.adaptive.enabled": "true",
        "parquet.block.size": str(row_group_bytes),
    }
    ordered.write.mode("error").options(**options).parquet(path)
    return points.sparkSession.read.parquet(path)


def typed_ids(ids: Sequence[Any], kind: T.DataType) -> list[Any] | None:
    """The ids as values of the key's type, without those no key can equal; None where only text compares.

    Ids are equal if their texts are: 7 is asked for by ``7``, not by ``007``.
    """
    texts = dict.fromkeys(str(i) for i in ids if i is not None)
    if isinstance(kind, T.StringType):
        return list(texts)
    if bits := _BITS.get(type(kind)):
        numbers = [int(t) for t in texts if len(t) <= 20 and _WHOLE.fullmatch(t)]
        return [n for n in numbers if -(1 << bits - 1) <= n < 1 << bits - 1]
    return None


def with_ids(points: DataFrame, key: str, ids: Sequence[Any]) -> DataFrame:
    """The points with one of the ids, as a filter that the scan gets in the key's own type."""
    values = typed_ids(ids, points.schema[key].dataType)
    if values is None:
        return points.where(F.col(key).cast("string").isin([str(i) for i in ids if i is not None]))
    if not values:
        return points.where(F.lit(False))
    parts = [F.col(key).isin(values[i : i + PUSHED]) for i in range(0, len(values), PUSHED)]
    return points.where(reduce(or_, parts))


def same_id(asked: Column, key: Column, kind: T.DataType) -> Column:
    """Whether an asked id (text) is the key's text, with nothing to compute on the key where its type allows."""
    if isinstance(kind, T.StringType):
        return asked == key
    if type(kind) in _BITS:
        number = asked.try_cast(kind)
        return (number == key) & (number.cast("string") == asked)
    return asked == key.cast("string")
