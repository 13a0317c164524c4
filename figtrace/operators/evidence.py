"""Where a figure comes from, and how much of its folder was read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from figtrace.errors import SealedSourceError, SourceError
from figtrace.functions.text import parent_folder, under_any_folder
from figtrace.operators.citation import citation
from figtrace.operators.search import returned
from figtrace.plans.skew import lookup_join
from figtrace.session import staging_path
from figtrace.sources.concepts import BoundPoints
from figtrace.sources.keyed import SMALL, same_id, with_ids
from figtrace.sources.manifest import read_manifest
from figtrace.sources.scopes import build_scope_tree, folded_scope, nodes_of

DONE = "done"
# What the answer on a source says about the figure itself.
RECORD = ("metric_code", "value", "unit", "year", "data_class", "verification_status")
COUNTS = ("in_scope", "done", "not_done", "by_status")
BY_STATUS = "array<struct<status: string, n: long>>"


def cite(bound: BoundPoints) -> DataFrame:
    """Every point with its citation and the store it came from."""
    return bound.frame.select(
        bound.need("record_id"), citation(bound.frame).alias("citation"), bound.provenance_column().alias("provenance")
    )


def with_scope_tree(bound: BoundPoints, path: str | None = None) -> BoundPoints:
    """The store with a written scope tree of its manifest, for any number of questions.

    Without a manifest, or one that records no status, the store stays as it is.
    """
    manifest = read_manifest(bound.manifest) if bound.manifest is not None else None
    if manifest is None or bound.tree is not None:
        return bound
    return replace(bound, tree=build_scope_tree(manifest, path or staging_path(bound.frame.sparkSession, "scopes")))


def disclosure(tree: DataFrame) -> DataFrame:
    """(scope, in_scope, done, not_done, by_status) of a tree's nodes."""
    done = F.aggregate("by_status", F.lit(0).cast("long"), lambda a, s: a + F.when(s["status"] == DONE, s["n"]).otherwise(0))
    return tree.select("scope", "in_scope", done.alias("done"), (F.col("in_scope") - done).alias("not_done"), F.col("by_status").cast(BY_STATUS))


def _state(bound: BoundPoints) -> str:
    if bound.manifest is None:
        return "ABSENT"
    return bound.manifest_name if bound.tree is not None else f"{bound.manifest_name} has no status column"


def skip_disclosure(bound: BoundPoints, scopes: DataFrame) -> DataFrame:
    """(scope, manifest, in_scope, done, not_done, by_status) per asked scope; ``''`` is the whole corpus.

    Without a manifest the counts are NULL and ``manifest`` says ABSENT: unknown is not zero.
    """
    bound = with_scope_tree(bound)
    asked = scopes.select("scope").dropDuplicates().withColumn("_scope", folded_scope(F.col("scope")))
    if bound.tree is None:
        return asked.select("scope", F.lit(_state(bound)).alias("manifest"), *_unknown())
    held = disclosure(bound.tree).withColumnRenamed("scope", "_scope")
    return lookup_join(asked, held, ["_scope"]).select("scope", F.lit(_state(bound)).alias("manifest"), *_zero())


def skip_by_status(bound: BoundPoints, scopes: DataFrame) -> DataFrame:
    """(scope, status, n) per asked scope; without a usable manifest one row that says ABSENT, and no number."""
    bound = with_scope_tree(bound)
    told = skip_disclosure(bound, scopes)
    if bound.tree is None:
        return told.select("scope", F.lit("ABSENT").alias("status"), F.lit(None).cast("long").alias("n"))
    return told.select("scope", F.explode("by_status").alias("_s")).select("scope", "_s.status", "_s.n")


def _unknown() -> list[Column]:
    kinds = {c: "long" for c in COUNTS} | {"by_status": BY_STATUS}
    return [F.lit(None).cast(kinds[c]).alias(c) for c in COUNTS]


def _zero(shown: Column | None = None) -> list[Column]:
    """Counts where a scope has none are zero, and NULL where nothing is to be shown."""
    nothing = {c: F.lit(0).cast("long") for c in COUNTS} | {"by_status": F.array().cast(BY_STATUS)}
    counts = {c: F.coalesce(F.col(c), nothing[c]) for c in COUNTS}
    return [(x if shown is None else F.when(shown, x)).alias(c) for c, x in counts.items()]


def get_source(bound: BoundPoints, requests: DataFrame) -> DataFrame:
    """One row per requested ``record_id``: the record, what the document says, where, and what was skipped there.

    ``outcome`` is ok, no_evidence (not held) or refused_quarantine (sealed source; no content is
    returned). A request may carry its own ``scope``; otherwise it is the folder of the source.
    ``record_id`` is the key of the points table; ids are compared as text, whatever type either side has. Any number
    of requests is joined; ``get_sources`` takes a few ids to the scan.
    """
    own_scope = "scope" in requests.columns
    asked = requests.select(
        F.col("record_id").cast("string").alias("_asked"), *([F.col("scope").alias("_scope_asked")] if own_scope else [])
    ).dropDuplicates()
    key = bound.need("record_id")
    points = bound.frame.select(*_columns(bound))
    held = asked.join(points, same_id(F.col("_asked"), key, bound.frame.schema["record_id"].dataType), "left")
    bound = with_scope_tree(bound)
    answers = _answers(bound, held)
    if bound.tree is None:
        return answers.select("*", *_unknown())
    # Most requests can point into one folder, or have none: the join can split them.
    joined = lookup_join(answers, disclosure(bound.tree), ["scope"])
    return joined.select(*answers.columns, *_zero(F.col("outcome") == "ok"))


def get_sources(bound: BoundPoints, ids: Sequence[Any], scope: str | None = None) -> DataFrame:
    """``get_source`` for a few ids, which reach the scan as values of the key's type.

    Over a store that ``write_keyed`` laid out, and a written scope tree, only the row groups that can hold the ids are
    read, and the nodes of their folders.
    """
    if len(ids) > SMALL:
        raise SourceError(f"more than {SMALL} ids: give them as a table to get_source")
    spark = bound.frame.sparkSession
    texts = list(dict.fromkeys(str(i) for i in ids if i is not None))
    asked = spark.createDataFrame([(t, scope) for t in texts], "_asked string, _scope_asked string")
    bound.need("record_id")
    points = with_ids(bound.frame.select(*_columns(bound)), "record_id", texts)
    held = asked.join(points, F.col("_asked") == F.col("record_id").cast("string"), "left")
    bound = with_scope_tree(bound)
    answers = _answers(bound, held)
    if bound.tree is None:
        return answers.select("*", *_unknown())
    folders = [r["scope"] for r in answers.where("scope IS NOT NULL").select("scope").distinct().collect()]
    nodes = disclosure(nodes_of(bound.tree, folders)) if folders else disclosure(bound.tree.where(F.lit(False)))
    return lookup_join(answers, nodes, ["scope"]).select(*answers.columns, *_zero(F.col("outcome") == "ok"))


def get_one_source(bound: BoundPoints, record_id: str, scope: str | None = None) -> Row:
    """The answer for a single record id, raising where its source is sealed."""
    row = get_sources(bound, [record_id], scope).first()
    if row["outcome"] == "refused_quarantine":
        path = with_ids(bound.frame, "record_id", [record_id]).select("source").first()
        raise SealedSourceError(f"record {record_id} is under seal: {path['source']}")
    return row


def _columns(bound: BoundPoints) -> list[str]:
    return returned(bound, "extract_text", "cell", "locator_path")


def _answers(bound: BoundPoints, held: DataFrame) -> DataFrame:
    """What is said of each asked id, without the counts of its scope."""
    sealed = under_any_folder(F.col("source"), bound.sealed)
    outcome = F.when(F.col("record_id").isNull(), "no_evidence").when(sealed, "refused_quarantine").otherwise("ok")
    folder = parent_folder(F.col("source"))
    if "_scope_asked" in held.columns:
        folder = F.coalesce(F.col("_scope_asked"), folder)
    held = held.withColumn("outcome", outcome)

    def shown(c: Column) -> Column:
        return F.when(F.col("outcome") == "ok", c)

    def concept(name: str) -> Column:
        return F.col(name) if name in held.columns else F.lit(None).cast("string")

    return held.select(
        F.col("_asked").alias("record_id"),
        "outcome",
        shown(concept("extract_text")).alias("verbatim"),
        shown(F.nullif(F.col("source").cast("string"), F.lit(""))).alias("locator_path"),
        shown(concept("cell")).alias("cell"),
        *[shown(concept(c)).alias(c) for c in RECORD],
        shown(citation(held)).alias("citation"),
        shown(bound.provenance_column()).alias("provenance"),
        shown(folded_scope(folder)).alias("scope"),
    )
