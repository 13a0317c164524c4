"""Grouped figures of one value column, all from one table of counted values, by one route for groups of any size.

Rows are counted by key and value once; counts, distinct values, extremes and the exact median follow from that
table, so what lies below it is read once. The median's ranks are narrowed down twice by sums per bucket. The first
scale is relative to the value, and the second cuts one of its buckets evenly: a bucket of the first is a thousandth
of its values wide, a part of the second about as fine as doubles are, so that each step handles at most about three
million rows of a group whatever the group holds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figtrace.plans.skew import same

# Buckets of the first scale for each factor e of magnitude, and parts one of them is cut into.
COARSE, FINE = 1024, 1 << 21
# Where the buckets of zero, infinities, NaN and missing values lie; those of numbers are within 2 * SHIFT.
SHIFT, INFINITE, NAN, MISSING = 1 << 20, 1 << 40, 1 << 41, -(1 << 42)


def grouped_figures(
    df: DataFrame, keys: Sequence[str], value: str, *, details: Sequence[str] = (), also: Mapping[str, tuple[Column, Callable[[Column], Column]]] | None = None
) -> DataFrame:
    """One row per group: the keys, n, n_values, n_distinct, n_negative, v_min, v_max, v_median, and ``also``.

    ``n`` counts rows, all others pass over NULL values. NaN counts as one value, greater than every number. The median
    of an even number of values is the middle of two. Values are also counted by the columns ``details``, of which
    few occur with one value; n_distinct is then NULL. ``also`` are aggregates over these and the number of rows
    ``_c``, each with the function that merges such aggregates.
    """
    also = dict(also or {})
    counted = df.groupBy(*keys, F.col(value).cast("double").alias("_v"), *details).agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.withColumn("_b", _coarse(F.col("_v")))
    first = _targets(counted, keys, bool(details), also)
    inside = counted.join(first, _paired(keys) & (F.col("_b") == F.col("_tb"))).select(
        *keys, "_which", "_r", "_v", "_c", "_lo", "_hi", "_figures"
    )
    step = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (FINE - 1)).cast("long")
    inside = inside.withColumn("_f", F.coalesce(F.when(F.col("_lo") < F.col("_hi"), step), F.lit(0)))

    parts = inside.groupBy(*keys, "_which", "_f").agg(F.sum("_c").alias("_c"), F.max("_r").alias("_r"))
    second = _reached(parts, [*keys, "_which"], "_f").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_which").alias("_w"), F.col("_f").alias("_tf"), (F.col("_r") - F.col("_before")).alias("_q")
    )
    last = inside.drop("_r").join(second, _paired(keys) & (F.col("_which") == F.col("_w")) & (F.col("_f") == F.col("_tf")))
    found = _reached(last.withColumnRenamed("_q", "_r"), [*keys, "_which"], "_v")
    median = F.min("_v") * 0.5 + F.max("_v") * 0.5
    return found.groupBy(*keys).agg(median.alias("v_median"), F.any_value("_figures").alias("_g")).select(
        *keys, *[F.col("_g").getField(c).alias(c) for c in ("n", "n_values", "n_distinct", "n_negative", "v_min", "v_max")],
        "v_median", *[F.col("_g").getField(c).alias(c) for c in also],
    )


def rounded(figures: DataFrame, decimals: int | None, *names: str) -> DataFrame:
    """The named figures rounded; all of least, median and greatest by default."""
    if decimals is None:
        return figures
    return figures.withColumns({c: F.round(c, decimals) for c in names or ("v_min", "v_median", "v_max")})


def _coarse(v: Column) -> Column:
    scaled = F.floor(F.ln(F.abs(v)) * COARSE).cast("long") + SHIFT
    infinite = F.abs(v) == float("inf")
    bucket = F.when(F.isnan(v), NAN).when(infinite, F.signum(v).cast("long") * INFINITE).when(v == 0, 0)
    return F.coalesce(F.when(v.isNotNull(), bucket.when(v > 0, scaled).otherwise(-scaled)), F.lit(MISSING)).cast("long").alias("_b")


def _targets(counted: DataFrame, keys: Sequence[str], detailed: bool, also: Mapping[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """The one or two middle ranks of each group, with their bucket, their rank inside it and the group's figures.

    A group without values has its one bucket of missing values instead.
    """
    c, held = F.col("_c"), F.col("_b") != MISSING
    buckets = counted.groupBy(*keys, "_b").agg(
        F.sum(c).alias("_c"), F.count(F.lit(1)).alias("_d"), F.sum(F.when(F.col("_v") < 0, c).otherwise(0)).alias("_neg"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *[a.alias(f"_also_{name}") for name, (a, _) in also.items()],
    )
    values = F.sum(F.when(held, c).otherwise(0))
    figures = {
        "n": F.sum(c), "n_values": values, "n_distinct": F.sum(F.when(held, F.col("_d")).otherwise(0)), "n_negative": F.sum("_neg"),
        "v_min": F.min("_lo"), "v_max": F.max("_hi"),
    }
    if detailed:
        figures["n_distinct"] = F.lit(None).cast("long")
    figures |= {name: merge(F.col(f"_also_{name}")) for name, (_, merge) in also.items()}
    every = Window.partitionBy(*keys)
    ranked = buckets.withColumns({"_n": values.over(every)} | {f"_g_{x}": f.over(every) if x != "n_distinct" or not detailed else f for x, f in figures.items()})
    counts = F.when(held | (F.col("_n") == 0), c).otherwise(0)
    up_to = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_w", counts).withColumn("_cum", F.sum("_w").over(up_to))
    n = F.when(F.col("_n") == 0, F.col("_g_n")).otherwise(F.col("_n"))
    middle = [F.floor((n + 1) / 2), F.floor((n + 2) / 2)]
    before = F.col("_cum") - F.col("_w")
    target = [F.when((r <= F.col("_cum")) & (r > before), F.struct(F.lit(i).alias("_which"), (r - before).alias("_r"))) for i, r in enumerate(middle)]
    packed = F.struct(*[F.col(f"_g_{x}").alias(x) for x in figures]).alias("_figures")
    unfolded = ranked.select(*keys, "_b", "_lo", "_hi", packed, F.explode(F.array_compact(F.array(*target))).alias("_t"))
    return unfolded.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_tb"), "_lo", "_hi", "_figures", "_t.*")


def _reached(counts: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """The row of every group in whose count the rank ``_r`` falls, with the count before it."""
    up_to = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_cum", F.sum("_c").over(up_to)).withColumn("_before", F.col("_cum") - F.col("_c"))
    return summed.where("_r <= _cum AND _r > _before")


def _paired(keys: Sequence[str]) -> Column:
    return same([F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys]) if keys else F.lit(True)
