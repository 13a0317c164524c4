"""Search for points, or summarise what is held."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figtrace.functions.text import BLANK, leading_folders, or_blank
from figtrace.operators.citation import citation
from figtrace.operators.filters import Echo, EvidenceFilter, apply_filter
from figtrace.sources.concepts import BoundPoints

# The concepts a record is returned with, the page size, and the summary's facets.
RETURN_CONCEPTS = (
    "record_id", "metric_code", "entity", "entity_id", "year", "value", "unit", "currency", "value_scale",
    "data_class", "verification_status", "source", "source_type_flag", "temporality", "project_id",
)
DEFAULT_LIMIT = 25
FACETS = ("metric_code", "unit", "data_class", "temporality", "year")
FOLDER_DEPTH = 5
TOP = 15


def returned(bound: BoundPoints, *extra: str) -> list[str]:
    return [c for c in (*RETURN_CONCEPTS, *extra) if bound.has(c)]


@dataclass(frozen=True)
class SearchResult:
    records: DataFrame
    echo: Echo
    matching: DataFrame
    bound: BoundPoints
    limit: int

    def page(self) -> dict[str, Any]:
        """The page as rows, saying whether more is held. Reads at most ``limit + 1`` rows."""
        rows = page_of(self.bound, self.matching, self.limit + 1).collect()
        page = {**self.echo.as_dict(), "records": rows[: self.limit], "returned": min(len(rows), self.limit)}
        page["truncated"] = len(rows) > self.limit
        if not rows:
            page["note"] = NOTHING
        if self.echo.warning():
            page["warning"] = self.echo.warning()
        return page


NOTHING, UNFILTERED = "no evidence held for these filters", "a summary needs at least one filter"


def page_notes(result: SearchResult) -> DataFrame:
    """(returned, truncated, note, warning, understood_as, deduplication): what a page says besides its records.

    At most ``limit + 1`` points are looked at.
    """
    seen = result.matching.select(F.lit(1)).limit(result.limit + 1).agg(F.count(F.lit(1)).alias("_n"))
    return seen.select(
        F.least("_n", F.lit(result.limit)).cast("int").alias("returned"),
        (F.col("_n") > result.limit).alias("truncated"),
        F.when(F.col("_n") == 0, NOTHING).alias("note"),
        F.lit(result.echo.warning()).cast("string").alias("warning"),
        *_understood(result.echo),
    )


def _understood(echo: Echo) -> list[Column]:
    said = ", ".join(f"{k}={v}" for k, v in echo.understood_as.items())
    return [F.lit(said).alias("understood_as"), F.lit(echo.deduplication).alias("deduplication")]


def summary_notes(bound: BoundPoints, wanted: EvidenceFilter) -> DataFrame:
    """(matching, untagged, untagged_pct, caveat, note, warning, understood_as, deduplication): the state of a summary's scope.

    The caveat says how many points don't state what they measure. Without a filter there is nothing but the note.
    """
    df, echo = apply_filter(bound, wanted)
    told = [F.lit(echo.warning()).cast("string").alias("warning"), *_understood(echo)]
    if not echo.understood_as:
        nothing = [F.lit(None).cast(k).alias(c) for c, k in (("matching", "long"), ("untagged", "long"), ("untagged_pct", "decimal(4,1)"), ("caveat", "string"))]
        return df.sparkSession.range(1).select(*nothing, F.lit(UNFILTERED).alias("note"), *told)
    if not bound.has("metric_code"):
        counts = df.agg(F.count(F.lit(1)).alias("n_total")).select("n_total", F.lit(None).cast("long").alias("n_blank"), F.lit(None).cast("decimal(4,1)").alias("blank_pct"))
    else:
        counts = untagged_share(bound, wanted)[0]
    caveat = F.format_string("%d of %d points (%s%%) state no metric code, so what they measure is not known", "n_blank", "n_total", F.col("blank_pct").cast("string"))
    return counts.select(
        F.col("n_total").alias("matching"), F.col("n_blank").alias("untagged"), F.col("blank_pct").alias("untagged_pct"),
        F.when(F.col("n_blank") > 0, caveat).alias("caveat"), F.when(F.col("n_total") == 0, NOTHING).alias("note"), *told,
    )


def ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """By record id, so that a page is the same page every time."""
    order = ["record_id"] if "record_id" in df.columns else columns
    return df.select(*columns).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def page_of(bound: BoundPoints, matching: DataFrame, limit: int) -> DataFrame:
    """The first points, each with its citation and the store it came from."""
    rows = ordered(matching, returned(bound)).limit(limit)
    return rows.withColumns({"citation": citation(rows), "provenance": bound.provenance_column()})


def search(bound: BoundPoints, wanted: EvidenceFilter = EvidenceFilter(), limit: int = DEFAULT_LIMIT) -> SearchResult:
    """The first ``limit`` points a filter selects, each with its citation and provenance."""
    df, echo = apply_filter(bound, wanted)
    echo.limit = int(limit)
    return SearchResult(page_of(bound, df, int(limit)), echo, df, bound, int(limit))


def summarise(bound: BoundPoints, wanted: EvidenceFilter, top: int = TOP) -> tuple[DataFrame, Echo]:
    """(facet, key, n): exact counts per facet value, the ``top`` of each, ``_total`` and ``_untagged``.

    ``_untagged`` counts the points that do not say what they measure; no metric code answers for them.

    Rows are first counted by all facets together, so what is unfolded into one row per facet is the
    few combinations that occur, and it happens in one pass over the points.
    """
    df, echo = apply_filter(bound, wanted)
    empty = "facet string, key string, n bigint"
    if not echo.understood_as:
        echo.note = UNFILTERED
        return df.sparkSession.createDataFrame([], empty), echo

    columns = {c: or_blank(F.col(c)) for c in FACETS if bound.has(c)}
    if bound.has("source"):
        columns["source_folder"] = or_blank(leading_folders(F.col("source"), FOLDER_DEPTH))
    if not columns:
        echo.note = f"the table has none of the concepts a summary groups by: {list(FACETS)} or source"
        return df.sparkSession.createDataFrame([], empty), echo

    combined = df.select(*[c.alias(name) for name, c in columns.items()]).groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = [F.struct(F.lit("_total").alias("facet"), F.lit("all").alias("key"))]
    pairs += [F.struct(F.lit(name).alias("facet"), F.col(name).alias("key")) for name in columns]
    always = [pairs[0]]
    if "metric_code" in columns:
        untagged = F.struct(F.lit("_untagged").alias("facet"), F.lit("metric_code").alias("key"))
        always.append(untagged)
        pairs.append(F.when(F.col("metric_code") == BLANK, untagged))
    unfolded = combined.select(F.explode(F.array_compact(F.array(*pairs))).alias("p"), "n").select("p.facet", "p.key", "n")
    # Both are reported even where nothing matches.
    zero = df.sparkSession.range(1).select(F.explode(F.array(*always)).alias("p"), F.lit(0).cast("long").alias("n"))
    zero = zero.select("p.facet", "p.key", "n")
    counts = unfolded.unionByName(zero).groupBy("facet", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.asc("key")))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= int(top)).drop("_rank"), echo


def untagged_share(bound: BoundPoints, wanted: EvidenceFilter) -> tuple[DataFrame, Echo]:
    """(n_total, n_blank, blank_pct): how much of a scope does not say what it measures."""
    df, echo = apply_filter(bound, wanted)
    blank = F.count_if(or_blank(F.col("metric_code")) == BLANK)
    counts = df.agg(F.count(F.lit(1)).alias("n_total"), blank.alias("n_blank"))
    share = F.col("n_blank").cast("decimal(20,0)") * 100 / F.nullif(F.col("n_total"), F.lit(0)).cast("decimal(20,0)")
    return counts.withColumn("blank_pct", F.round(share, 1).cast("decimal(4,1)")), echo
