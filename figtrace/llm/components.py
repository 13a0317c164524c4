"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrace.llm.texts import release, staged


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a long, b long): the least id it is linked with over any path.

    Rounds of two steps, each a join with least neighbours: every id hands its larger neighbours, then its
    smaller ones, to the least of them, until every component is a star around its least id. Neighbours
    are never gathered, and a round's result is written before the next one reads it.
    """
    edges = staged(_edges(links.select("a", "b")), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        wide = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("a"), F.least("u", "_m").alias("b"))
        wide = _edges(wide)
        least = wide.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        near = wide.join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("a"), F.col("_m").alias("b"))
        old, edges = edges, staged(_edges(near.union(least)), "edges")
        release(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return members.union(edges.select(F.col("v"), F.col("v")).distinct())


def _edges(pairs: DataFrame) -> DataFrame:
    a, b = pairs.columns
    return pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
