"""How many files of each status lie in every folder: a written tree, rolled up level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figtrace.session import staging_path
from figtrace.sources.keyed import with_ids
from figtrace.sources.tables import delete_path

TREE = "scope string, in_scope long, by_status array<struct<status: string, n: long>>, depth int"
WHOLE = ""
# Levels that are rolled up one by one; folders of paths deeper than that are unfolded.
LEVELS = 64


def folded_scope(scope: Column) -> Column:
    """A scope as the tree has it: one kind of slash, lower case, no slash at its end."""
    return F.regexp_replace(F.lower(F.translate(scope, "\\", "/")), r"/+\z", "")


def build_scope_tree(manifest: DataFrame, path: str) -> DataFrame:
    """Write (scope, in_scope, by_status, depth) for every file and folder of a manifest, and for all of it (scope '').

    A folder's counts are the sums of what lies directly in it: every node is shuffled once, to its parent, and each
    level is smaller than the one below. Nodes lie in one folder a level, sorted, so that reading a few scopes reads
    little. ``by_status`` has the most frequent status first; statuses are taken to be few. Files without a path count for
    the whole only.
    """
    spark = manifest.sparkSession
    folded = F.lower(F.translate(F.col("path"), "\\", "/"))
    counted = manifest.groupBy(folded.alias("scope"), "status").agg(F.count(F.lit(1)).alias("n"))
    staged = staging_path(spark, "scope_files")
    counted.withColumn("depth", _depth(F.col("scope"))).write.parquet(staged)
    files = spark.read.parquet(staged)
    _write(files.select(F.lit(WHOLE).alias("scope"), "status", "n"), f"{path}/depth=0")

    deepest = files.agg(F.max("depth")).first()[0] or 0
    above = None
    if deepest > LEVELS:
        deep = files.where(F.col("depth") > LEVELS)
        at = F.explode(F.sequence(F.lit(LEVELS + 1), F.col("depth")))
        nodes = deep.withColumn("_i", at).select(F.expr("substring_index(scope, '/', _i)").alias("scope"), "status", "n")
        _write(nodes, f"{path}/depth={LEVELS + 1}")
        above = deep.select(F.substring_index("scope", "/", LEVELS).alias("scope"), "status", "n")
    for d in range(min(deepest, LEVELS), 0, -1):
        nodes = files.where(F.col("depth") == d).select("scope", "status", "n")
        nodes = nodes if above is None else nodes.unionByName(above)
        _write(nodes.where(F.col("scope") != WHOLE), f"{path}/depth={d}")
        below = spark.read.schema(TREE).parquet(f"{path}/depth={d}").select("scope", F.explode("by_status").alias("_s"))
        above = below.select(F.substring_index("scope", "/", d - 1).alias("scope"), "_s.status", "_s.n")
    delete_path(spark, staged)
    return read_scope_tree(spark, path)


def read_scope_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE).option("basePath", path).parquet(path)


def nodes_of(tree: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """The nodes of a few folded scopes; levels and scopes are filters of the scan."""
    depths = {min(s.count("/") + 1, LEVELS + 1) if s else 0 for s in scopes}
    return with_ids(tree.where(F.col("depth").isin(sorted(depths))), "scope", sorted(scopes))


def _depth(scope: Column) -> Column:
    return F.length(scope) - F.length(F.replace(scope, F.lit("/"), F.lit(""))) + 1


def _write(nodes: DataFrame, path: str) -> None:
    """One row per scope from its counts; a scope's rows are summed before they meet."""
    held = nodes.groupBy("scope", "status").agg(F.sum("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "status")))
    rows = held.groupBy("scope").agg(F.sum("n").alias("in_scope"), ordered.alias("by_status"))
    rows = rows.withColumn("by_status", F.transform("by_status", lambda s: F.struct(s["status"].alias("status"), (-s["less"]).alias("n"))))
    rows.repartitionByRange("scope").sortWithinPartitions("scope").write.parquet(path)
