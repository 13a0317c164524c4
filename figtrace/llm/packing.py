"""Best-fit decreasing packing of token pieces into sequences of one size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from figtrace.llm.bpe import encoder
from figtrace.llm.texts import slices, staged

# Pieces that share a length are ranked in shares of about this many.
SHARE = 20_000


def token_pieces(
    docs: DataFrame, vocabulary: str, *, size: int, end: int, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """One row per piece of a document: the kept columns, piece, start, length, ids.

    A document is its text's tokens, then ``end``. Documents of more than ``size`` tokens are cut into pieces
    of ``size``, of which the first may be shorter. ``ids`` are the piece's token ids as little-endian
    unsigned 32-bit numbers. A null or empty text is the end alone. ``vocabulary`` is a byte-level BPE file of
    the tokenizers library that every executor must be able to read; ids are those this library gives. Texts are
    encoded whole, and a task holds a slice of them at a time. Kept columns must not be called like the new ones.
    """
    out = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL("piece int, start long, length long, ids binary").fields])
    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(vocabulary), np.array([end], dtype="<u4").tobytes()
        for batch in slices(batches, n_kept):
            row, piece, start, length, ids = [], [], [], [], []
            for i, value in enumerate(batch.column(n_kept)):
                held = value.as_py()
                doc = (encode(held.decode("utf-8", "replace")).astype("<u4").tobytes() if held else b"") + last
                n = len(doc) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(doc[4 * a : 4 * b])
                if len(ids) >= 4096:
                    yield _pieces(batch, n_kept, row, piece, start, length, ids)
                    row, piece, start, length, ids = [], [], [], [], []
            if ids:
                yield _pieces(batch, n_kept, row, piece, start, length, ids)

    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, out)


def _pieces(batch, n_kept, row, piece, start, length, ids) -> pa.RecordBatch:
    kept = [batch.column(c).take(pa.array(row, pa.int64())) for c in range(n_kept)]
    new = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays([*kept, *new], [*batch.schema.names[:n_kept], "piece", "start", "length", "ids"])


class Capacities:
    """A segment tree over remaining capacities: which of them have open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = [False] * (2 * self.leaves)

    def put(self, capacity: int, some: bool) -> None:
        i = self.leaves + capacity
        self.some[i] = some
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with an open sequence."""
        i = self.leaves + least
        if self.some[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.some[2 * i])
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing for ``counts`` pieces of each length, as rows of
    (length, first rank, first sequence, pieces a sequence, offset of the first).

    Pieces of one length are alike, and so are sequences with one remaining capacity, so both are placed
    by ranges: ranks r of a row go to sequence ``first + (r - first rank) // pieces a sequence``. Every
    sequence takes the pieces it would take if they came one by one. Rows depend on the number of lengths
    and capacities, not on the number of pieces.
    """
    tree, open_at = Capacities(size), {}
    plan, sequences = [], 0

    def leave(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_at.setdefault(capacity, []).append((first, n))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, (first, n) = size, (sequences, -(-left // (size // length)))
                sequences += n
            else:
                first, n = open_at[capacity].pop()
                if not open_at[capacity]:
                    tree.put(capacity, False)
            each = capacity // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            plan.append((length, rank, first, each, size - capacity))
            whole, rest = divmod(placed, each)
            leave(capacity - each * length, first, whole)
            if rest:
                leave(capacity - rest * length, first + whole, 1)
            leave(capacity, first + used, n - used)
            rank, left = rank + placed, left - placed
    return np.array(plan, dtype=np.int64).reshape(-1, 5)


def best_fit(pieces: DataFrame, *, size: int, order: Sequence[str], length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit decreasing into sequences of ``size``.

    Lengths are from 1 to ``size``. Only the number of pieces of each length reaches the driver, at most
    ``size`` rows. ``order`` columns rank pieces of equal length and spread them over tasks; ties and
    repeated rows are placed one by one. No rows give no sequences.
    """
    spark = pieces.sparkSession
    held = staged(pieces, "pieces")
    shares = max(64, held.count() // SHARE)
    marked = held.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    per_share = staged(marked.groupBy(length, "_share").agg(F.count(F.lit(1)).alias("_n")), "piece_counts")
    counts = {r[0]: r[1] for r in per_share.groupBy(length).agg(F.sum("_n")).collect()}
    plan = best_fit_plan(counts, size)
    key = plan[:, 0] << 40 | plan[:, 1]
    by_key = np.argsort(key, kind="stable")
    sent = spark.sparkContext.broadcast((key[by_key], plan[by_key]))

    before = Window.partitionBy(length).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_share.select(F.col(length).alias("_l"), F.col("_share").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(length, "_share").orderBy(*order)) - 1
    ranked = marked.withColumn("_rank", inside.cast("long")).join(
        bases, (F.col(length) == F.col("_l")) & (F.col("_share") == F.col("_s"))
    )
    out = StructType([*held.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    n_kept = len(held.columns)
    at = held.columns.index(length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = sent.value
        for b in batches:
            lengths, rank = b.column(at).to_numpy(), b.column(n_kept).to_numpy()
            row = rows[np.searchsorted(keys, lengths << 40 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * lengths
            yield pa.RecordBatch.from_arrays([*b.columns[:n_kept], pa.array(sequence), pa.array(offset)], out.names)

    return ranked.select(*held.columns, (F.col("_rank") + F.col("_base")).alias("_rank")).mapInArrow(place, out)
