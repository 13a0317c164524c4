"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. Built-in functions only.

How many rows of each partition go to each shard is drawn first, as a uniform permutation of all rows would have
it. Then every partition permutes its rows and deals them out by these counts, the rows are exchanged, and every
shard permutes what it got.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figtrace.llm.texts import staged

# A shard is permuted in chunks of about so many rows.
CHUNK = 50_000
# Counts of this many partitions, or fewer, are drawn in one task.
TOGETHER = 256
# Counts further from the likeliest one than so many standard deviations have no chance that a double can hold.
DEVIATIONS = 10
_BITS = 33  # of a row's number within its partition, in monotonically_increasing_id


def shuffled(docs: DataFrame, shards: int, *, seed: int = 0, keep: Sequence[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (its place there, gapless from 0), in uniformly random order.

    Row counts of shards differ by one at most. Every row is dealt on its own: null, empty and long texts, ties and
    repeated rows make no difference, so copies of a row are spread like any others, and equal texts are not kept
    together. No rows give none, and fewer rows than shards fill the first shards. ``keep`` names the columns that
    stay (all by default); one called shard or slot is replaced. Rows are staged once with their random numbers, so
    lost executors don't change the result; ``seed`` repeats it for the same input partitions.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("shard", "slot")]
    row = F.struct(*[F.col(_quoted(c)).alias(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_none"))
    # Permute locally: the random numbers of a partition sort it, its row numbers are then places. Partitions
    # add their number to a seed, so the two seeds are far apart.
    drawn = docs.select(row.alias("_row"), F.rand(seed).alias("_first"), F.rand(seed + (1 << 40)).alias("_second"))
    permuted = staged(
        drawn.sortWithinPartitions("_first").select("_row", "_second", F.monotonically_increasing_id().alias("_at")), "permuted"
    )
    part, place = F.shiftright("_at", _BITS), F.col("_at").bitwiseAND((1 << _BITS) - 1)
    sizes = permuted.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    matrix = staged(communication_matrix(sizes, "_part", "_n", shards, seed=seed), "matrix")
    total = matrix.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0

    chunks = max(1, -(-total // (shards * chunk)))
    # The first shard whose counts, added up, pass the row's place.
    bounds = matrix.select(F.col("_part").alias("_p"), _running("counts").alias("_ends"))
    dealt = permuted.withColumns({"_part": part, "_place": place}).join(bounds, F.col("_part") == F.col("_p")).select(
        "_row", "_second",
        F.size(F.filter("_ends", lambda e: e <= F.col("_place"))).alias("shard"),
        F.least(F.floor(F.col("_second") * chunks), F.lit(chunks - 1)).cast("int").alias("_chunk"),
    )
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = staged(dealt.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n")), "chunks")
    starts = held.select(F.col("shard").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_second")) - 1
    placed = dealt.withColumn("_inside", inside).join(starts, (F.col("shard") == F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in kept], "shard", (F.col("_inside") + F.col("_start")).cast("long").alias("slot"))


def write_shards(shuffled_docs: DataFrame, path: str, *, rows_a_file: int = 1_000_000) -> None:
    """Shards as folders ``shard=N`` of Parquet files, each file in the order of its slots."""
    piece = F.floor(F.col("slot") / rows_a_file)
    held = shuffled_docs.withColumn("_piece", piece).repartition("shard", "_piece").sortWithinPartitions("shard", "slot")
    held.drop("_piece").write.partitionBy("shard").option("maxRecordsPerFile", rows_a_file).parquet(path)


def communication_matrix(sizes: DataFrame, part: str, n: str, shards: int, *, seed: int = 0) -> DataFrame:
    """(part, counts): how many of each partition's rows go to each shard, summing to the shards' exact sizes.

    The partitions are halved again and again; each time, how many rows of every shard come from the first half is
    a multivariate hypergeometric draw. That makes log2(partitions) steps, and from ``TOGETHER`` partitions down
    they run in a task for each group of partitions. What one task holds before that are the
    partitions' numbers and sizes, 16 bytes each. Partitions without rows may be absent.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(part).alias("part"), F.col(n).alias("n"))))
    root = sizes.agg(listed.alias("parts")).where("size(parts) > 0")
    n_parts = (sizes.agg(F.count(F.lit(1))).first() or [0])[0]
    total = _total("parts")
    even = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.floor(total / shards) + F.when(j < total % shards, 1).otherwise(0)
    )
    nodes = root.select(F.lit(1).cast("long").alias("node"), "parts", even.alias("counts"))
    width, spread = n_parts, n_parts <= TOGETHER
    while width > 1:
        if width <= TOGETHER and not spread:
            nodes, spread = nodes.repartition("node"), True
        nodes, width = _halved(nodes, seed), -(-width // 2)
    return nodes.select(F.element_at("parts", 1)["part"].alias(part), "counts")


def _halved(nodes: DataFrame, seed: int) -> DataFrame:
    """Every node of two or more partitions as two nodes, its rows of each shard dealt out to them."""
    size = F.size("parts")
    half = F.ceil(size / 2).cast("int")
    first = F.slice("parts", F.lit(1), half)
    rows = F.aggregate(first, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    child = lambda node, parts, counts: F.struct(node.alias("node"), parts.alias("parts"), counts.alias("counts"))
    # Bound as a lambda's argument, the draw is made once for both halves.
    both = F.transform(
        F.array(_multivariate(F.col("counts"), rows, F.col("node"), seed)),
        lambda drawn: F.array(
            child(F.col("node") * 2, first, drawn),
            child(F.col("node") * 2 + 1, F.slice("parts", half + 1, F.greatest(size - half, F.lit(1))), F.zip_with("counts", drawn, lambda c, d: c - d)),
        ),
    )[0]
    split = F.when(size > 1, both).otherwise(F.array(child(F.col("node") * 2, F.col("parts"), F.col("counts"))))
    return nodes.select(F.explode(split).alias("_n")).select("_n.*")


def _multivariate(counts: Column, draws: Column, node: Column, seed: int) -> Column:
    """How many of ``draws`` rows, taken without replacement, belong to each shard of ``counts`` rows."""
    nothing = F.array().cast("array<long>")
    left = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    start = F.struct(nothing.alias("drawn"), left.alias("left"), draws.alias("draws"))

    def one(acc: Column, count: Column) -> Column:
        key = lambda k: F.xxhash64(F.lit(seed), node, F.size(acc["drawn"]), k)
        # Again a lambda's argument, as the number is used three times.
        return F.transform(
            F.array(hypergeometric(count, acc["left"] - count, acc["draws"], key)),
            lambda x: F.struct(
                F.concat(acc["drawn"], F.array(x)).alias("drawn"), (acc["left"] - count).alias("left"), (acc["draws"] - x).alias("draws")
            ),
        )[0]

    return F.aggregate(counts, start, one)["drawn"]


def hypergeometric(good: Column, bad: Column, draws: Column, key) -> Column:
    """A hypergeometric number: how many of ``draws``, out of ``good + bad`` without replacement, are good.

    Each possible number is met once, going outwards from the likeliest one, with its chance relative to that one;
    it replaces the number held so far with its share of the chances met up to then. ``key`` gives a random 64-bit
    integer for a number met.
    """
    g, b, n = (c.cast("double") for c in (good, bad, draws))
    mode = F.floor((n + 1) * (g + 1) / (g + b + 2))
    spread = F.sqrt(n * g * b / F.greatest((g + b) * (g + b), F.lit(1.0)) * F.greatest(g + b - n, F.lit(0.0)) / F.greatest(g + b - 1, F.lit(1.0)))
    reach = F.ceil(spread * DEVIATIONS).cast("long") + DEVIATIONS
    low, high = F.greatest(F.lit(0).cast("long"), draws - bad), F.least(good, draws)
    mode = F.least(F.greatest(mode.cast("long"), low), high)

    def walk(m: Column) -> Column:
        top, bottom = F.least(high, m + reach), F.greatest(low, m - reach)
        down = F.when(bottom < m, F.sequence(m - 1, bottom, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
        start = F.struct(F.lit(1.0).alias("chance"), F.lit(0.0).alias("met"), m.alias("held"))

        def step(acc: Column, k: Column) -> Column:
            x = k.cast("double")
            rising = (g - x + 1) * (n - x + 1) / (x * (b - n + x))
            falling = (x + 1) * (b - n + x + 1) / ((g - x) * (n - x))
            chance = F.when(k == m, 1.0).when(k > m, acc["chance"] * rising).when(k == m - 1, falling).otherwise(acc["chance"] * falling)
            uniform = (F.shiftrightunsigned(key(k), 11).cast("double") + 0.5) / float(1 << 53)
            return F.transform(
                F.array(chance),
                lambda c: F.struct(
                    c.alias("chance"), (acc["met"] + c).alias("met"), F.when(uniform * (acc["met"] + c) < c, k).otherwise(acc["held"]).alias("held")
                ),
            )[0]

        return F.aggregate(F.concat(F.sequence(m, top), down), start, step)["held"]

    return F.transform(F.array(mode), walk)[0]


def _running(counts: str) -> Column:
    """The sums of an array up to and with each element."""
    sums = F.aggregate(
        counts, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )
    return F.slice(sums, F.lit(2), F.size(counts))


def _total(parts: str) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["n"])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
