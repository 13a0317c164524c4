"""The two batch builds: tables written next to a store, changing nothing that exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from figtrace.functions.rules import COPY_MARKERS
from figtrace.operators.dedup import canonicalise, changed_state, fingerprint_state, finished, renominated
from figtrace.operators.tagging import context_tags, in_scope, tag_points, tag_points_by_lookup
from figtrace.sources.tables import create_view, read_table, release, replace_table, stage

TAGGED_VIEW, TAG_TABLE = "ask_points_v2", "context_tag.parquet"
STATE, FINGERPRINTS, CANONICAL = "doc_state.parquet", "doc_fingerprint.parquet", "doc_canonical.parquet"


def build_document_tables(
    points: DataFrame, folder: str, markers: Sequence[str] = COPY_MARKERS
) -> tuple[DataFrame, DataFrame]:
    """Write ``doc_state``, ``doc_fingerprint`` and ``doc_canonical``. The points are scanned once; each table is
    built from the one before as written."""
    state = replace_table(fingerprint_state(points), f"{folder}/{STATE}")
    fingerprints = replace_table(finished(state), f"{folder}/{FINGERPRINTS}")
    return fingerprints, replace_table(canonicalise(fingerprints, markers), f"{folder}/{CANONICAL}")


def update_document_tables(
    folder: str, added: DataFrame | None = None, removed: DataFrame | None = None, markers: Sequence[str] = COPY_MARKERS
) -> tuple[DataFrame, DataFrame]:
    """The tables of ``build_document_tables`` after points were added to the store or removed from it.

    Only those points are read, and one row per document of the tables. Groups of copies that no changed document
    left or joined keep their nominations. The state is replaced last: a run that fails before that can be run again.
    """
    given = [p for p in (added, removed) if p is not None]
    spark = given[0].sparkSession
    state, canonical = (read_table(spark, f"{folder}/{t}") for t in (STATE, CANONICAL))
    changed = stage(changed_state(state, *[p if p is None else fingerprint_state(p) for p in (added, removed)]), "changed_documents")
    kept = state.join(changed.select("source_file"), "source_file", "left_anti")
    whole = stage(kept.unionByName(changed.where("n_points > 0")), "document_states")
    after = finished(whole)
    nominated = replace_table(renominated(canonical, finished(state), after, changed, markers), f"{folder}/{CANONICAL}")
    fingerprints = replace_table(after, f"{folder}/{FINGERPRINTS}")
    replace_table(whole, f"{folder}/{STATE}")
    release(changed, whole)
    return fingerprints, nominated


def build_tag_table(
    points: DataFrame,
    folder: str,
    *,
    entity: str | None = None,
    canonical: DataFrame | None = None,
    view: str = TAGGED_VIEW,
) -> tuple[DataFrame, DataFrame]:
    """Write ``context_tag`` for one entity or the whole store, and define the tagged view over all points.

    Points whose context lies outside the scope are untagged in the view.
    """
    tags = replace_table(context_tags(in_scope(points, entity, canonical)), f"{folder}/{TAG_TABLE}")
    return tags, create_view(tag_points_by_lookup(points, tags), view)


def preview_tags(points: DataFrame, *, entity: str | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """The tagged points of a scope without writing anything."""
    return tag_points(in_scope(points, entity, canonical))
