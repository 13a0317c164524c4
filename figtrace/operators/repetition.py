"""How much of a store is the same figure stated again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figtrace.functions.text import figure_key, leading_folders, or_blank
from figtrace.operators.filters import keep_canonical
from figtrace.operators.profile import entity_matches
from figtrace.operators.search import FOLDER_DEPTH

Scope = tuple[str, str]
# Scopes counted by one pass over the points.
TOGETHER = 24


def _key(value: str) -> Column:
    return figure_key(F.col("year"), F.col(value), F.col("unit"))


def _scope_rows(spark: SparkSession, scopes: Sequence[Scope]) -> DataFrame:
    return spark.createDataFrame([(m, e, f"%{e}%".replace("\\", "\\\\")) for m, e in scopes], "metric string, scope_entity string, _like string")


def in_scopes(points: DataFrame, scopes: Sequence[Scope]) -> DataFrame:
    """Points joined to each (metric, entity) scope they belong to.

    The scopes are the caller's own list, so they are broadcast; the metric is an equality key and
    the entity, by name or code, is checked on the rows it pairs.
    """
    asked = F.broadcast(_scope_rows(points.sparkSession, scopes))
    entity = F.expr("entity ilike _like or entity_id ilike _like")
    return points.join(asked, (F.col("metric_code") == F.col("metric")) & entity, "inner")


def _all_scopes(points: DataFrame, scopes: Sequence[Scope], measured: DataFrame, counts: Sequence[str]) -> DataFrame:
    """A row for every scope, zeros where nothing is in it."""
    asked = _scope_rows(points.sparkSession, scopes).select(F.col("metric").alias("_m"), F.col("scope_entity").alias("_e"))
    on = (F.col("_m") == F.col("metric")) & (F.col("_e") == F.col("scope_entity"))
    joined = asked.join(measured, on, "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts]
    return joined.select(F.col("_m").alias("metric"), F.col("_e").alias("entity"), *zero)


def repetition_scope(points: DataFrame, scopes: Sequence[Scope], value: str = "value_num") -> DataFrame:
    """(metric, entity, n_rows, n_distinct, n_files, n_folders): one scan and one shuffle for up to ``TOGETHER`` scopes.

    What is shuffled are the distinct figures and documents of all scopes, each once with its count in every scope; how
    many a scope has of them, and of the folders, follows from these counts.
    """
    parts = [_scope_counts(points, scopes[i : i + TOGETHER], value) for i in range(0, len(scopes), TOGETHER)]
    return reduce(DataFrame.unionByName, parts)


def _scope_counts(points: DataFrame, scopes: Sequence[Scope], value: str) -> DataFrame:
    inside = [(F.col("metric_code") == m) & entity_matches(e) for m, e in scopes]
    columns = [f"_in{i}" for i in range(len(scopes))]
    rows = points.where(reduce(or_, inside)).select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), v.alias("value")) for f, v in ((True, _key(value)), (False, F.col("source_file")))])).alias("_x"),
        *[c.alias(name) for c, name in zip(inside, columns)],
    )
    figure, x = F.col("figure"), F.col("value")
    counted = rows.groupBy("_x.figure", "_x.value").agg(*[F.count_if(c).alias(c) for c in columns])
    # Figures come together in one row per task, documents in one per folder.
    folder = F.when(~figure, leading_folders(x, FOLDER_DEPTH)).alias("_folder")
    per_folder = counted.groupBy("figure", folder).agg(
        *[F.sum(c).alias(c) for c in columns],
        *[F.count_if((F.col(c) > 0) & x.isNotNull()).alias(f"{c}_n") for c in columns],
    )
    zero = F.lit(0).cast("long")
    totals = per_folder.agg(
        *[f.alias(f"{c}_{name}") for c in columns for name, f in {
            "n_rows": F.coalesce(F.sum(F.when(figure, F.col(c))), zero), "n_distinct": F.coalesce(F.sum(F.when(figure, F.col(f"{c}_n"))), zero),
            "n_files": F.coalesce(F.sum(F.when(~figure, F.col(f"{c}_n"))), zero), "n_folders": F.count_if(~figure & (F.col(c) > 0)),
        }.items()]
    )
    counts = ("n_rows", "n_distinct", "n_files", "n_folders")
    told = [
        F.struct(F.lit(m).alias("metric"), F.lit(e).alias("entity"), *[F.col(f"{c}_{n}").alias(n) for n in counts])
        for (m, e), c in zip(scopes, columns)
    ]
    return totals.select(F.explode(F.array(*told)).alias("_s")).select("_s.*")


def with_ratio(df: DataFrame, rows: str = "n_rows", distinct: str = "n_distinct", name: str = "repetition") -> DataFrame:
    """Add rows per distinct figure, 0 where there is none."""
    return df.withColumn(name, F.coalesce(F.col(rows) / F.nullif(F.col(distinct), F.lit(0)), F.lit(0.0)))


def repetition_by_doc(points: DataFrame, metric: str, entity: str, top: int = 10, value: str = "value_num") -> DataFrame:
    """(source_file, n_rows, n_distinct): the documents with most rows of one scope."""
    rows = points.where((F.col("metric_code") == metric) & entity_matches(entity)).select(
        "source_file", _key(value).alias("_key")
    )
    counts = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_key").alias("n_distinct")
    )
    return counts.orderBy(F.desc("n_rows"), F.col("source_file").asc_nulls_last()).limit(top)


def repetition_after(
    points: DataFrame, canonical: DataFrame, scopes: Sequence[Scope], value: str = "value_num"
) -> DataFrame:
    """(metric, entity, n_rows, canon_rows, n_distinct, canon_distinct): what de-duplication changes.

    A point whose source the canonical map does not know counts as canonical here. Rows are first
    counted per scope, figure and source, so the join sees each of those once.
    """
    rows = (
        in_scopes(points, scopes)
        .groupBy("metric", "scope_entity", _key(value).alias("_key"), "source_file")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    known = canonical.select(F.col("source_file").alias("_known"), "is_canonical")
    joined = rows.join(known, F.col("source_file") == F.col("_known"), "left")
    kept = F.coalesce(F.col("is_canonical"), F.lit(True))
    per_figure = joined.groupBy("metric", "scope_entity", "_key").agg(
        F.sum("_n").alias("_rows"), F.sum(F.when(kept, F.col("_n")).otherwise(F.lit(0))).alias("_kept")
    )
    measured = per_figure.groupBy("metric", "scope_entity").agg(
        F.sum("_rows").alias("n_rows"),
        F.sum("_kept").alias("canon_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.count_if(F.col("_kept") > 0).alias("canon_distinct"),
    )
    return _all_scopes(points, scopes, measured, ["n_rows", "canon_rows", "n_distinct", "canon_distinct"])


def restated_figures(
    points: DataFrame, canonical: DataFrame, metric: str, entity: str, top: int = 10, value: str = "value_num"
) -> DataFrame:
    """(year, value, unit, points, documents): the figures most documents state.

    Counted per figure and document before the join to canonical documents, which makes documents a
    plain count afterwards.
    """
    per_document = (
        points.where((F.col("metric_code") == metric) & entity_matches(entity))
        .groupBy("year", F.col(value).alias("value"), or_blank(F.col("unit")).alias("unit"), "source_file")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    stated = keep_canonical(per_document, canonical)
    figures = stated.groupBy("year", "value", "unit").agg(
        F.sum("_n").alias("points"), F.count(F.lit(1)).alias("documents")
    )
    ties = [F.col(c).asc_nulls_last() for c in ("year", "value", "unit")]
    return figures.orderBy(F.desc("documents"), F.desc("points"), *ties).limit(top)
