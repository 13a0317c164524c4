"""All reports on one scope of a store, from one pass over its figures.

A scope is one entity's points, or the whole store's, with or without the copies of documents. It is pruned to what
the reports read, tagged and written once; every report reads what was written, and it is deleted afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from figtrace.operators import profile as P
from figtrace.operators import tag_reports as TR
from figtrace.operators.builds import TAG_TABLE, TAGGED_VIEW
from figtrace.operators.tagging import context_tags, in_scope, tag_points_by_lookup, tag_repeated_points
from figtrace.sources.tables import create_view, release, replace_table, stage, write_tsv

# What the reports read of a point, and which of its tags.
COLUMNS = ("value_num", "unit", "metric_code", "context", "location", "year")
REPORT_TAGS = (
    "measure_noun", "measure_kind", "label_source", "metric_code_v2", "metric_code_v2_raw", "magnitude_check", "currency_v2", "price_basis",
)


@dataclass(frozen=True)
class Scope:
    """A staged scope: its tagged points, how many there are, and what it was asked for."""

    points: DataFrame
    n_points: int
    entity: str | None
    canonical: bool

    def told(self) -> dict[str, object]:
        return {"entity": self.entity, "canonical": self.canonical, "n_points": self.n_points}

    def release(self) -> None:
        release(self.points)


def stage_scope(points: DataFrame, *, entity: str | None = None, canonical: DataFrame | None = None) -> Scope:
    """Tag and write a scope in one pass over the store, which also counts it; before, its contexts are read, and
    classified if points repeat them, whether or not they are those of copies."""
    seen = Observation()
    kept = in_scope(points, entity, canonical).select(*[c for c in COLUMNS if c in points.columns])
    tagged = tag_repeated_points(kept, tags=REPORT_TAGS, among=in_scope(points, entity))
    try:
        held = stage(tagged.observe(seen, F.count(F.lit(1)).alias("n")), "scope")
    finally:
        if hasattr(tagged, "_staged"):
            release(tagged)
    return Scope(held, seen.get["n"], entity, canonical is not None)


@dataclass(frozen=True)
class Wanted:
    """What the reports of a scope are about."""

    metric: str = "rev_aero"
    keyword: str = "aero"
    rate: str = "rev_aero_per_pax"
    band: tuple[float, float] = (0, 50)
    years: tuple[int, int] = (2005, 2015)
    year: int = 2009
    top: int = 400
    decimals: int = 3
    rate_decimals: int = 2


def context_reports(scope: Scope, wanted: Wanted = Wanted()) -> dict[str, DataFrame]:
    """What the contexts of one metric look like, and what points without a code could be."""
    every, top, decimals = scope.points, wanted.top, wanted.decimals
    coded = every.where(F.col("metric_code") == wanted.metric)
    return {
        "scope_shape": P.tag_shape(every, wanted.metric),
        "context_shape": P.context_shape(coded),
        "context_by_label": P.label_profile(coded, top, decimals=decimals),
        "context_verbatim": P.context_profile(coded, top, decimals=decimals),
        "context_band": P.value_band(coded, *wanted.band, decimals=decimals),
        "context_untagged": P.untagged_reclaim(every, wanted.keyword, decimals=decimals),
    }


def tag_reports(scope: Scope, wanted: Wanted = Wanted()) -> dict[str, DataFrame]:
    """What the rules claim in a scope, and whether their answers hold."""
    points = scope.points
    return {
        "tag_claims": TR.tag_claims(points, decimals=wanted.decimals),
        "tag_migration": TR.tag_migration(points, wanted.metric),
        "tag_promotions": TR.tag_promotions(points),
        "tag_conflicts": TR.tag_conflicts(points),
        "tag_coverage": TR.tag_coverage(points),
        "tag_money": TR.tag_money(points),
        "gold_by_year": TR.gold_by_year(points, wanted.rate, wanted.years, decimals=wanted.rate_decimals),
        "veto_audit": TR.veto_audit(points),
        "before_after": TR.tag_before_after(points, wanted.year, wanted.metric, wanted.rate, decimals=wanted.rate_decimals),
    }


Kinds = Mapping[str, Callable[[Scope, Wanted], dict[str, DataFrame]]]


def run_scope(
    points: DataFrame, folder: str, *, entity: str | None = None, canonical: DataFrame | None = None, wanted: Wanted = Wanted(),
    kinds: Kinds | None = None,
) -> dict[str, object]:
    """Write every report of a scope as TSV below a folder, and say what was run: the scope, its size, the reports.

    Figures are read of the store once, and nothing staged is left, also where a report fails.
    """
    scope = stage_scope(points, entity=entity, canonical=canonical)
    try:
        return scope.told() | {"reports": write_reports(scope, folder, wanted, kinds)}
    finally:
        scope.release()


def write_reports(scope: Scope, folder: str, wanted: Wanted = Wanted(), kinds: Kinds | None = None) -> list[str]:
    """Write the reports of a staged scope as TSV; their names."""
    reports: dict[str, DataFrame] = {}
    for make in (kinds or {"contexts": context_reports, "tags": tag_reports}).values():
        reports |= make(scope, wanted)
    for name, report in reports.items():
        write_tsv(report.coalesce(1), f"{folder}/{name}.tsv")
    return sorted(reports)


def tag_run(
    points: DataFrame, folder: str, *, entity: str | None = None, canonical: DataFrame | None = None, build: bool = False,
    report: bool | None = None, wanted: Wanted = Wanted(), view: str = TAGGED_VIEW,
) -> dict[str, object]:
    """Classify the contexts of a scope, and say what was run: the scope, its size, its distinct contexts, the reports.

    A run without ``build`` writes reports only. With it, the tag table replaces the one in ``folder`` and the tagged view is
    defined over all points, where those outside the scope are untagged. Reports come with a run unless it builds the
    whole store, or as asked. Figures are read of the store once for table and reports together.
    """
    scope = stage_scope(points, entity=entity, canonical=canonical)
    try:
        tags = context_tags(scope.points)
        if build:
            tags = replace_table(tags, f"{folder}/{TAG_TABLE}")
            create_view(tag_points_by_lookup(points, tags), view)
        wants = report if report is not None else not (build and entity is None)
        names = write_reports(scope, f"{folder}/reports", wanted, {"tags": tag_reports}) if wants else []
        return scope.told() | {"built": build, "n_contexts": tags.count(), "reports": names}
    finally:
        scope.release()
