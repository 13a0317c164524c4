"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from figtrace.llm.components import components
from figtrace.llm.texts import staged

PER_CELL = 512  # vectors a cell is meant to have
CELLS = 4096  # cells at most; beyond, cells grow and are compared in more blocks
SAMPLE = 65_536  # vectors the cells are fitted on at most: those with the least hash
STEPS = 8
SIGMAS = 4.0
OWNERS, MEMBERS = 512, 1024  # sides of a block


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1. They are scaled by a power of two first, which is exact, as squares of tiny or huge
    numbers are no doubles."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _valid(vectors: DataFrame, vector: str) -> tuple[DataFrame, type]:
    """row, dim and the raw numbers of every vector that has a direction; and the numbers' type."""
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    dtype = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, dims, raw = [], [], []
            for row, x in zip(b.column(0).to_pylist(), b.column(1)):
                values = x.values
                if not x.is_valid or values.null_count or not len(values):
                    continue
                v = np.asarray(values).astype(np.float64)
                if np.isfinite(v).all() and v.any():
                    rows.append(row)
                    dims.append(len(v))
                    raw.append(v.astype(dtype).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["row", "dim", "raw"])

    return vectors.select("row", vector).mapInArrow(run, "row long, dim int, raw binary"), dtype


def _numbers(raw: Sequence[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype(np.float64)


def spherical_cells(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of about ``n`` cells: unit vectors, refined by ``STEPS`` rounds; nearly equal ones are one."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for step in range(STEPS):
        home = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
        alike = np.triu(centres @ centres.T, 1) > 0.97
        centres = centres[~alike.any(0)]
    return centres


def _reach(threshold: float, dim: int) -> float:
    distance = np.sqrt(2 - 2 * threshold)
    return max(SIGMAS * distance / np.sqrt(dim), distance / 2)


def _cells_of(x: np.ndarray, centres: np.ndarray, between: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's home cell, and which cells (its own too) it must be compared in.

    A vector within the threshold of x that lives in another cell c is nearer to c. Seen along the line
    between both centres, the two vectors differ by a random part of their distance, with a deviation of
    distance / sqrt(dimensions); x goes to every cell whose border is within ``SIGMAS`` deviations, and within
    half the distance at least: one of both vectors is that near, in whatever direction they differ.
    """
    near = x @ centres.T
    home = near.argmax(1)
    gap = near[np.arange(len(x)), home][:, None] - near
    return home, gap <= reach * between[home] + 1e-12


def linked(vectors: DataFrame, *, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns with n_links, component_id and kept.

    Vectors of a cosine, in double precision, of at least ``threshold`` are linked. ``n_links`` counts the
    other vectors linked directly, ``component_id`` is the least id reachable over links, ``kept`` marks the
    vector that has it. Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing, nor do vectors of different dimensions. Null ids are passed over for the least id; a component of
    them alone has none and keeps all. Repeated rows are vectors of their own, linked with each other.

    Every vector is compared in its home cell and visits cells whose border is near; pairs are counted in one
    cell only, and no pair is emitted: a block gives each vector's number of links and the least vector it
    hangs together with there.
    """
    spark = vectors.sparkSession
    keep = [c for c in (vectors.columns if keep is None else keep) if c not in ("n_links", "component_id", "kept")]
    numbered = staged(
        vectors.select(F.struct(*keep).alias("carried"), F.col(vec_id).alias("id"), F.col(vector).alias("vector")).withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    valid, dtype = _valid(numbered, "vector")
    valid = staged(valid, "directions")
    dims = valid.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if dims is None:
        dims = (1, 0)
    dim, n = dims[0], dims[1]
    drawn = valid.where(F.col("dim") == dim).orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("raw").collect()
    sample = _unit(_numbers([r[0] for r in drawn], dtype)) if drawn else np.eye(1)
    centres = spherical_cells(sample, int(np.clip(n // PER_CELL, 1, CELLS)))
    reach = _reach(threshold, dim)
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        between = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                b = whole.slice(a, 2048)
                of_dim = b.column(1).to_numpy()
                home, cells = -of_dim.astype(np.int64), [[-int(d)] for d in of_dim]
                at = np.flatnonzero(of_dim == dim)
                if len(at):
                    x = _unit(_numbers(b.column(2).take(pa.array(at)).to_pylist(), dtype))
                    home[at], visits = _cells_of(x, c, between, reach)
                    for i, v in zip(at.tolist(), visits):
                        cells[i] = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(home.astype(np.int32)), pa.array(cells, pa.list_(pa.int32())), b.column(2)], ["row", "home", "cells", "raw"]
                )

    placed = staged(valid.mapInArrow(assign, "row long, home int, cells array<int>, raw binary"), "cells")
    member = placed.select("row", "home", "cells", F.explode("cells").alias("cell"))
    sizes = member.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.sum((F.col("home") == F.col("cell")).cast("int")).alias("owners"))
    sizes = sizes.select(
        F.col("cell").alias("_cell"), F.ceil(F.col("owners") / OWNERS).cast("int").alias("os"), F.ceil(F.col("members") / MEMBERS).cast("int").alias("ms")
    ).where("os > 0")
    dealt = placed.select("row", "home", "cells", "raw", F.explode("cells").alias("cell")).join(F.broadcast(sizes), F.col("cell") == F.col("_cell"))  # a row a cell
    h = F.xxhash64("row", F.lit(1))
    block = lambda o, m, owner: F.struct(o.cast("int").alias("o"), m.cast("int").alias("m"), F.lit(owner).alias("owner"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("os") - 1), lambda o: block(o, F.pmod(h, F.col("ms")), False))
    as_owner = F.transform(F.sequence(F.lit(0), F.col("ms") - 1), lambda m: block(F.pmod(F.shiftright(h, 24), F.col("os")), m, True))
    both = F.when(F.col("home") == F.col("cell"), F.concat(as_member, as_owner)).otherwise(as_member)
    blocks = dealt.select("row", "home", "cells", "raw", "cell", F.explode(both).alias("_b")).select("row", "home", "cells", "raw", "cell", "_b.*")

    def compare(table: pa.Table) -> pa.Table:
        owner = table["owner"].to_numpy(zero_copy_only=False)
        row, home = table["row"].to_numpy(), table["home"].to_numpy()
        x = _unit(_numbers(table["raw"].to_pylist(), dtype))
        cell = int(table["cell"][0].as_py())
        ours, theirs = np.flatnonzero(owner), np.flatnonzero(~owner)
        near = x[ours] @ x[theirs].T >= threshold
        near &= row[ours][:, None] != row[theirs][None, :]
        p, q = np.nonzero(near)
        if not len(p):
            return pa.table({"row": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        # A visitor's pair is met in its own home too if the owner visits there: the lower cell counts it.
        visitor = home[theirs][q] != cell
        lists = table["cells"].combine_chunks()
        seen = np.unique(ours[p[visitor]])
        visits = {int(i): set(lists[int(i)].as_py()) for i in seen}
        counted = np.ones(len(p), dtype=bool)
        for k in np.flatnonzero(visitor).tolist():
            at_home = int(home[theirs[q[k]]])
            counted[k] = cell < at_home or at_home not in visits[int(ours[p[k]])]
        p, q, visitor = p[counted], q[counted], visitor[counted]
        links = np.bincount(ours[p], minlength=len(row)) + np.bincount(theirs[q[visitor]], minlength=len(row))
        a, b, least = ours[p], theirs[q], row.copy()
        while True:
            new = least.copy()
            np.minimum.at(new, a, least[b])
            np.minimum.at(new, b, least[a])
            if (new == least).all():
                break
            least = new
        some = np.unique(np.concatenate([a, b]))
        return pa.table({"row": pa.array(row[some]), "n": pa.array(links[some].astype(np.int64)), "root": pa.array(least[some])})

    met = staged(blocks.groupBy("cell", "o", "m").applyInArrow(compare, "row long, n long, root long"), "links")
    counts = met.groupBy(F.col("row").alias("_row")).agg(F.sum("n").alias("_n"))
    roots = components(met.select(F.col("row").alias("a"), F.col("root").alias("b")))
    rooted = numbered.select("carried", F.col("id").alias("vid"), "row").join(roots, F.col("row") == F.col("id"), "left")
    rooted = rooted.withColumn("_root", F.coalesce("root", "row"))
    tops = rooted.groupBy(F.col("_root").alias("_r")).agg(F.min("vid").alias("_top"))
    named = rooted.join(tops, F.col("_root") == F.col("_r")).join(counts, F.col("row") == F.col("_row"), "left")
    return named.select(
        *[F.col("carried").getField(c).alias(c) for c in keep],
        F.coalesce("_n", F.lit(0)).alias("n_links"), F.col("_top").alias("component_id"), F.coalesce(F.col("vid") == F.col("_top"), F.col("_top").isNull()).alias("kept"),
    )
