"""Counting each document once: fingerprint documents by content and nominate one path per content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrace.functions.rules import COPY_MARKERS
from figtrace.functions.text import matches_count, nonblank, path_depth
from figtrace.plans.skew import lookup_join

FINGERPRINT = ("n_points", "h_sum", "h_xor")
SUMS = ("n_points", "_p0", "_p1", "_p2")
# A 64-bit hash is summed in three parts of at most 22 bits, each in a long: exact for 2^41 points
# in one document, and without decimal arithmetic per row.
_PART_BITS = 22
_PART_MASK = (1 << _PART_BITS) - 1


def fingerprint_state(
    points: DataFrame, source: str = "source_file", cell: str = "location", value: str = "value_num"
) -> DataFrame:
    """What a fingerprint is made of, one row per document with a path; states of parts of a document add up.

    The hashes aggregate over (cell, value) pairs in any order, so a document holding most of the
    points still reduces to one small row per map task. The path is not part of it.
    """

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    pairs = points.where(nonblank(F.col(source))).select(
        F.col(source).alias("source_file"), F.xxhash64(text(cell), text(value)).alias("_h")
    )
    h = F.col("_h")
    parts = {
        "_p0": h.bitwiseAND(F.lit(_PART_MASK)),
        "_p1": F.shiftrightunsigned(h, _PART_BITS).bitwiseAND(F.lit(_PART_MASK)),
        "_p2": F.shiftrightunsigned(h, 2 * _PART_BITS),
    }
    return pairs.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_points"),
        *[F.sum(c).alias(name) for name, c in parts.items()],
        F.bit_xor(h).alias("h_xor"),
    )


def fingerprint(
    points: DataFrame, source: str = "source_file", cell: str = "location", value: str = "value_num"
) -> DataFrame:
    """(source_file, n_points, h_sum, h_xor), one row per document with a path."""
    return finished(fingerprint_state(points, source, cell, value))


def finished(state: DataFrame) -> DataFrame:
    """The fingerprints of states."""

    def weighted(name: str, weight: int) -> Column:
        return F.col(name).cast("decimal(20,0)") * F.lit(weight).cast("decimal(17,0)")

    total = weighted("_p0", 1) + weighted("_p1", 1 << _PART_BITS) + weighted("_p2", 1 << 2 * _PART_BITS)
    return state.select("source_file", "n_points", total.cast("decimal(38,0)").alias("h_sum"), "h_xor")


def changed_state(state: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The new state of every document that parts were added to or removed from; without points where none are left."""
    parts = []
    if added is not None:
        parts.append(added)
    if removed is not None:
        # Sums are taken off again, and a second xor undoes the first.
        parts.append(removed.select("source_file", *[(-F.col(c)).alias(c) for c in SUMS], "h_xor"))
    change = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Rows of documents that nothing happened to are left out before anything is shuffled for sums.
    touched = state.join(change.select("source_file"), "source_file", "left_semi")
    return touched.unionByName(change).groupBy("source_file").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.bit_xor("h_xor").alias("h_xor")
    )


def renominated(canonical: DataFrame, before: DataFrame, after: DataFrame, changed: DataFrame, markers: Sequence[str] = COPY_MARKERS) -> DataFrame:
    """The canonical map after some documents changed; only groups that one left or joined are nominated again.

    ``before`` and ``after`` are the fingerprints of all documents, ``changed`` has the paths of those that changed.
    """
    paths = changed.select("source_file")
    keys = list(FINGERPRINT)
    was, now = (x.join(paths, "source_file", "left_semi").select(*keys) for x in (before, after))
    groups = was.unionByName(now).dropDuplicates()
    again = after.join(groups, keys, "left_semi")
    # A document that lost all its points is in no group any more.
    settled = canonical.join(again.select("source_file").unionByName(paths), "source_file", "left_anti")
    return settled.unionByName(canonicalise(again, markers))


def canonicalise(fingerprints: DataFrame, markers: Sequence[str] = COPY_MARKERS) -> DataFrame:
    """(source_file, canonical_source_file, is_canonical, copies, n_points, copy_penalty, depth).

    Among documents of one content the path with the fewest marks of a copy is canonical, then the
    shallowest, the shortest, the first in the alphabet. The winner of a group is an aggregate, not a
    sort of the group, and goes back to the members by a join that can split groups of very many copies.
    """
    scored = fingerprints.withColumns(
        {"copy_penalty": matches_count(F.col("source_file"), markers), "depth": path_depth(F.col("source_file"))}
    )
    keys = list(FINGERPRINT)
    path = F.col("source_file")
    rank = F.struct("copy_penalty", "depth", F.length(path).alias("length"), path.alias("path"))
    groups = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), F.min(rank)["path"].alias("canonical_source_file")
    )
    joined = lookup_join(scored, groups, keys)
    return joined.select(
        "source_file",
        "canonical_source_file",
        (F.col("source_file") == F.col("canonical_source_file")).alias("is_canonical"),
        "copies",
        "n_points",
        "copy_penalty",
        "depth",
    )


def canonical_map(
    points: DataFrame, source: str = "source_file", cell: str = "location", value: str = "value_num", **options
) -> DataFrame:
    """Fingerprint and canonicalise in one go."""
    return canonicalise(fingerprint(points, source, cell, value), **options)


def dedup_report(canonical: DataFrame) -> DataFrame:
    """One row of totals: documents, canonical ones, duplicates, and the points on each."""
    kept = F.col("is_canonical")
    totals = canonical.agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(kept).alias("canonical_docs"),
        F.count_if(~kept).alias("duplicate_docs"),
        F.coalesce(F.sum("n_points"), F.lit(0)).alias("points"),
        F.coalesce(F.sum(F.when(kept, F.col("n_points"))), F.lit(0)).alias("canonical_points"),
    )
    return totals.withColumn("copied_points", F.col("points") - F.col("canonical_points"))


def with_reduction(report: DataFrame) -> DataFrame:
    """Add the percentage of points that were copies and the factor by which the store shrinks."""
    points, kept, copied = F.col("points"), F.col("canonical_points"), F.col("copied_points")
    return report.withColumns(
        {
            "copied_pct": F.round(copied * 100.0 / F.nullif(points, F.lit(0)), 1),
            "reduction": F.round(points / F.nullif(kept, F.lit(0)), 1),
        }
    )


def most_copied(canonical: DataFrame, top: int = 10) -> DataFrame:
    """Documents held most often: (canonical_source_file, copies, n_points)."""
    return (
        canonical.where("is_canonical and copies > 1")
        .select("canonical_source_file", "copies", "n_points")
        .orderBy(F.desc("copies"), F.desc("n_points"), F.asc("canonical_source_file"))
        .limit(top)
    )


def text_dedup(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "path", markers: Sequence[str] = COPY_MARKERS
) -> DataFrame:
    """(doc_id, canonical_doc_id, is_canonical, copies): the same de-duplication over raw text.

    A document's lines are its values and their numbers the cells; they are hashed and summed within the
    row. A missing text is an empty one and a missing path an empty path. Among documents of one content
    and the same standing the lowest id wins, so every document is answered, whatever paths repeat.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    hashes = F.transform(lines, lambda line, i: F.xxhash64((i + 1).cast("string"), line))
    zero = F.lit(0).cast("long")

    def total(part) -> Column:
        return F.aggregate(F.col("_h"), zero, lambda held, h: held + part(h))

    found = documents.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(path), F.lit("")).alias("_path"), hashes.alias("_h")
    ).select(
        "doc_id", "_path", F.size("_h").alias("n_points"),
        total(lambda h: h.bitwiseAND(F.lit(_PART_MASK))).alias("_p0"),
        total(lambda h: F.shiftrightunsigned(h, _PART_BITS).bitwiseAND(F.lit(_PART_MASK))).alias("_p1"),
        total(lambda h: F.shiftrightunsigned(h, 2 * _PART_BITS)).alias("_p2"),
        F.aggregate(F.col("_h"), zero, lambda held, h: held.bitwiseXOR(h)).alias("h_xor"),
    )
    keys = ["n_points", "_p0", "_p1", "_p2", "h_xor"]
    p = F.col("_path")
    rank = F.struct(matches_count(p, markers).alias("penalty"), path_depth(p).alias("depth"), F.length(p).alias("length"), p.alias("path"), "doc_id")
    groups = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(rank)["doc_id"].alias("canonical_doc_id"))
    joined = lookup_join(found, groups, keys)
    return joined.select("doc_id", "canonical_doc_id", F.col("doc_id").eqNullSafe(F.col("canonical_doc_id")).alias("is_canonical"), "copies")
