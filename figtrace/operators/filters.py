"""One set of filters for every question, with an account of what was applied.

Search and summary build on the same filtered frame, so they cannot count different populations.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrace.functions.text import ilike_any_part, nonblank, under_any_folder, year_number
from figtrace.sources.concepts import BoundPoints


@dataclass(frozen=True)
class EvidenceFilter:
    metric: str | None = None
    entity: str | None = None
    geography: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    data_class: str | None = None
    status: str | None = None
    require_metric_code: bool = False
    canonical_only: bool = True


@dataclass
class Echo:
    """What a question was understood as, and what could not be applied."""

    understood_as: dict[str, Any] = field(default_factory=dict)
    not_applicable: list[str] = field(default_factory=list)
    deduplication: str = "unavailable"
    quarantine: str | None = None
    limit: int | None = None
    note: str | None = None

    def as_dict(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if v is not None}

    def warning(self) -> str | None:
        if not self.not_applicable:
            return None
        return f"not applied, because the table has no such concept: {self.not_applicable}; results are unfiltered on them"


def _given(value: Any) -> bool:
    return value is not None and value != ""


def canonical_sources(canonical: DataFrame) -> DataFrame:
    """The paths to keep when each document counts once."""
    return canonical.where("is_canonical").select(F.col("source_file").alias("_canonical_source"))


def keep_canonical(points: DataFrame, canonical: DataFrame, source: str = "source_file") -> DataFrame:
    """Points of canonical documents only, as a left-semi join on the path.

    There is no broadcast hint: the map grows with the corpus, so Spark broadcasts it only under its
    size threshold, and otherwise shuffles both sides, where a source holding many points is a skewed
    left partition that adaptive execution splits.
    """
    kept = canonical_sources(canonical)
    return points.join(kept, F.col(source) == F.col("_canonical_source"), "left_semi")


def apply_filter(bound: BoundPoints, wanted: EvidenceFilter) -> tuple[DataFrame, Echo]:
    """The points a filter selects. A filter on an absent concept is reported, never dropped silently."""
    df, echo = bound.frame, Echo()
    ignored: set[str] = set()

    def need(concept: str, reported_as: str | None = None) -> bool:
        if not bound.has(concept):
            ignored.add(reported_as or concept)
        return bound.has(concept)

    if _given(wanted.metric) and need("metric_code"):
        df = df.where(ilike_any_part(F.col("metric_code"), wanted.metric))
        echo.understood_as["metric_code"] = wanted.metric

    if _given(wanted.entity):
        held = [ilike_any_part(F.col(c), wanted.entity) for c in ("entity", "entity_id") if bound.has(c)]
        if held:
            df = df.where(held[0] | held[1] if len(held) == 2 else held[0])
            echo.understood_as["entity"] = wanted.entity
        else:
            ignored.add("entity")

    if _given(wanted.geography) and need("entity", "geography"):
        df = df.where(ilike_any_part(F.col("entity"), wanted.geography))
        echo.understood_as["geography(via entity)"] = wanted.geography

    for name, value in (("year_from", wanted.year_from), ("year_to", wanted.year_to)):
        if value is not None and need("year", name):
            year = year_number(F.col("year"), bound.dtype("year"))
            df = df.where(year >= int(value) if name == "year_from" else year <= int(value))
            echo.understood_as[name] = int(value)

    for concept, value in (("data_class", wanted.data_class), ("verification_status", wanted.status)):
        if _given(value) and need(concept):
            df = df.where(F.col(concept) == value)
            echo.understood_as[concept] = value

    if wanted.require_metric_code and need("metric_code", "require_metric_code"):
        df = df.where(nonblank(F.col("metric_code")))
        echo.understood_as["require_metric_code"] = True

    if bound.has("source"):
        if bound.sealed:
            df = df.where(~under_any_folder(F.col("source"), bound.sealed))
        echo.quarantine = "excluded in query"

    if not wanted.canonical_only:
        echo.deduplication = "off (every copy asked for)"
    elif bound.canonical is not None and bound.has("source"):
        df = keep_canonical(df, bound.canonical, "source")
        echo.deduplication = "applied"

    echo.not_applicable = sorted(ignored)
    return df, echo


def unmapped_points(bound: BoundPoints) -> DataFrame:
    """(n_all, n_canonical, n_unmatched): how many points canonical-only keeps, and how many have a
    source the canonical map does not know, which canonical-only drops."""
    known = bound.canonical.select(F.col("source_file").alias("_known"), "is_canonical")
    per_source = bound.frame.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    joined = per_source.join(known, F.col("source") == F.col("_known"), "left")

    def points(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n")).otherwise(0)), F.lit(0))

    return joined.agg(
        points(F.lit(True)).alias("n_all"), points(F.col("is_canonical")).alias("n_canonical"), points(F.col("_known").isNull()).alias("n_unmatched")
    )
