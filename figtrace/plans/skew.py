"""Joining many rows to one row per key, when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Key equality that also pairs NULL with NULL."""
    return reduce(and_, [a.eqNullSafe(b) for a, b in zip(left, right)])


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join ``rows`` to ``lookup`` (one row per key); NULL keys meet NULL keys.

    A join of two shuffles and nothing above it that needs the rows of a key together, so adaptive
    execution can split the partition of a key that holds many rows, or broadcast a lookup that it has
    measured to be small. No hint says otherwise.
    """
    values = [c for c in lookup.columns if c not in keys]
    named = lookup.select([F.col(k).alias(f"_k_{k}") for k in keys] + [F.col(v) for v in values])
    joined = rows.join(named, same([F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys]), "left")
    return joined.select(*rows.columns, *values)
