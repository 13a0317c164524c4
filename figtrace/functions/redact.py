"""Redacting the values of secret-named keys, at any depth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name fragments that mark a secret, and what replaces its value.
SECRET_PARTS = ("token", "auth", "secret", "password", "key", "credential")
REDACTED = "[redacted]"


def is_secret(name: str, parts: Sequence[str] = SECRET_PARTS) -> bool:
    return any(p in name.casefold() for p in parts)


def _secret_key(key: Column, parts: Sequence[str]) -> Column:
    folded = F.lower(key.cast("string"))
    return reduce(or_, [F.contains(folded, F.lit(p)) for p in parts])


def _holds_names(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_names(kind.elementType)
    return isinstance(kind, (T.StructType, T.MapType))


def redacted(c: Column, kind: T.DataType, parts: Sequence[str] = SECRET_PARTS) -> Column:
    """A value with every secret-named field or map entry replaced, following its type.

    A secret field becomes text. Map values share one type, so where that is not text a secret
    entry becomes NULL.
    """
    if not _holds_names(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redacted(x, kind.elementType, parts))
    if isinstance(kind, T.MapType):
        hidden = F.lit(REDACTED) if isinstance(kind.valueType, T.StringType) else F.lit(None).cast(kind.valueType)
        return F.transform_values(
            c, lambda k, v: F.when(_secret_key(k, parts), hidden).otherwise(redacted(v, kind.valueType, parts))
        )
    fields = [
        (F.lit(REDACTED) if is_secret(f.name, parts) else redacted(c[f.name], f.dataType, parts)).alias(f.name)
        for f in kind.fields
    ]
    return F.when(c.isNotNull(), F.struct(*fields))


def redact(df: DataFrame, *columns: str, parts: Sequence[str] = SECRET_PARTS) -> DataFrame:
    """A frame with the named columns (all by default) redacted inside; a secret column itself too."""
    wanted = columns or tuple(df.columns)
    out = {
        f.name: F.lit(REDACTED) if is_secret(f.name, parts) else redacted(F.col(f"`{f.name}`"), f.dataType, parts)
        for f in df.schema.fields
        if f.name in wanted
    }
    return df.withColumns(out)
