"""How a figure is cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrace.functions.text import plain_number


def citation(frame: DataFrame) -> Column:
    """A figure with what it measures, where and when it holds, its standing and its source.

    Floating-point values are shown in plain decimals, without an exponent.
    """
    kinds = dict(frame.dtypes)

    def part(concept: str, default: str) -> Column:
        if concept not in kinds:
            return F.lit(default)
        shown = plain_number(F.col(concept)) if kinds[concept] in ("double", "float") else F.col(concept).cast("string")
        return F.coalesce(shown, F.lit(default))

    return F.concat(
        part("metric_code", "?"), F.lit("="), part("value", "?"), F.lit(" "), part("unit", ""),
        F.lit(" ("), part("entity", "?"), F.lit(" "), part("year", "?"),
        F.lit(") [class="), part("data_class", "unclassified"),
        F.lit(", status="), part("verification_status", "unverified"),
        F.lit("] source: "), part("source", "UNSOURCED"),
    )
