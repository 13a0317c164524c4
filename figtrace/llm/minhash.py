"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrace.llm.components import components
from figtrace.llm.texts import bit_table, from_texts, release, slices, staged, words

HASHES, ROWS = 125, 5  # 25 bands of 5: a pair of similarity 0.8 shares no band once in 20,000
BATCH = 25  # hashes compared before each decision
MISS = 1e-7  # posterior chance of reaching the threshold under which a pair is given up
STARS = 3  # rounds of comparing a bucket with one member
BLOCK = 256  # members of a bucket compared with each other in one task
BITS = 1 << 24

_MIX = np.random.default_rng(20).integers(1, 1 << 63, size=(2, HASHES), dtype=np.uint64)
_MIX[0] |= np.uint64(1)


class Shingles(dict):
    """The set of a text as sorted 64-bit hashes; remembers the hashes of words."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        w = words(text)
        if not w:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.__getitem__, w), np.uint64, len(w))
        n = min(self.size, len(h))
        mixed = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            mixed = _scramble(mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(mixed)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each hash over a set that isn't empty, as 32-bit numbers."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 256):
        np.minimum(least, (shingles[a : a + 256, None] * _MIX[0] + _MIX[1]).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    h = np.arange(HASHES // ROWS, dtype=np.uint64) + np.uint64(1)
    for part in sig.reshape(-1, ROWS).T:
        h = _scramble(h * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
    return h.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) after every batch.

    With all similarities equally likely beforehand, after m matches of n the chance that the similarity
    is at least t is that of at most m successes in n + 1 trials of chance t. Pairs for which it is below
    ``miss`` are given up.
    """
    bounds = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while (below := below + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        bounds.append((n, m))
    return bounds


def describe(docs: DataFrame, *, size: int, text: str = "text", keep: Sequence[str]) -> DataFrame:
    """The kept columns with n_shingles, and for texts with words: class_id (a hash of the whole set), the
    set's members, its signature and its band keys."""

    def make():
        shingles = Shingles(size)

        def compute(texts):
            n, ids, sets, sigs, keys = [], [], [], [], []
            for t in texts:
                s = shingles.of(t)
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    ids.append(int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True))
                    sets.append(_pack(s))
                    sigs.append(sig.tobytes())
                    keys.append(bands(sig))
                else:
                    for held in (ids, sets, sigs, keys):
                        held.append(None)
            return n, ids, sets, sigs, keys

        return compute

    fields = "n_shingles long, class_id long, members binary, signature binary, bands array<long>"
    return from_texts(docs, fields, make, text=text, keep=keep)


def _pack(shingles: np.ndarray) -> bytes:
    """Six bytes of each hash, so that a set stays small to send. Two of the shingles of a pair of documents that
    have n between them agree in these with a chance below n^2 / 2^49: 2e-9 for a thousand."""
    return np.unique(shingles >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def survivors(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature tables are not given up: batch after batch, only the rest is compared."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), 0
    for n, least in bounds:
        matches = matches + (a[alive, at:n] == b[alive, at:n]).sum(1)
        go = matches >= least
        alive, matches, at = alive[go], matches[go], n
    return alive


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _links(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar: signatures first, whole sets for those that remain."""
    bounds = least_matches(percent / 100)
    sides = [members.select(F.col("class_id").alias(f"_{s}"), F.col("signature").alias(f"s{s}")) for s in "ab"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = survivors(_table(b.column(2)), _table(b.column(3)), bounds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], ["a", "b"])

    signed = pairs.join(sides[0], F.col("a") == F.col("_a")).join(sides[1], F.col("b") == F.col("_b")).select("a", "b", "sa", "sb")
    likely = signed.mapInArrow(compare, "a long, b long")
    sides = [members.select(F.col("class_id").alias(f"_{s}"), F.col("members").alias(f"m{s}")) for s in "ab"]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            good = [similar(_unpack(x), _unpack(y), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    whole = likely.join(sides[0], F.col("a") == F.col("_a")).join(sides[1], F.col("b") == F.col("_b")).select("a", "b", "ma", "mb")
    return whole.mapInArrow(confirm, "a long, b long")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (class_id, root) after joining what ``links`` between roots join."""
    moved = components(links).select(F.col("id").alias("_id"), F.col("root").alias("_to"))
    joined = labels.join(moved, F.col("root") == F.col("_id"), "left")
    changed = staged(joined.select("class_id", F.coalesce("_to", "root").alias("root")), "labels")
    release(labels, links)
    return changed


def classes(described: DataFrame, *, percent: int) -> DataFrame:
    """(class_id, root) of the classes of ``describe`` that share a band with another: root is the same for
    classes linked over any path by similarities of at least ``percent`` in 100.

    Sharing a band makes two classes candidates. In every bucket of a band, members are compared with one of
    them first, then, where they don't all hang together yet, with others; after ``STARS`` such rounds,
    every member that is still apart from the bucket's largest part is compared with all it is apart from,
    in blocks. So each candidate pair is compared or already joined over others, and no bucket is gathered.
    """
    first = described.where("class_id IS NOT NULL").groupBy("class_id").agg(F.min("row").alias("row"))
    keys = described.select("row", "bands").join(first, "row").select("class_id", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("class_id").alias("_lo"), F.max("class_id").alias("_hi")).where("_lo < _hi")
    buckets = staged(keys.join(shared.select("band"), "band"), "buckets")
    named = staged(buckets.select("class_id").distinct().join(first, "class_id"), "candidates")
    members = staged(_rows_of(described.select("row", "signature", "members"), named), "members")
    labels = staged(named.select("class_id", F.col("class_id").alias("root")), "labels")
    release(named)

    for star in range(STARS):
        placed = buckets.join(labels, "class_id")
        order = F.xxhash64("class_id", F.lit(star)) if star else F.col("class_id")
        center = placed.groupBy("band").agg(
            F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.min(F.struct(order.alias("h"), "class_id", "root")).alias("_c")
        ).where("_lo < _hi")
        center = center.select("band", F.col("_c.class_id").alias("b"), F.col("_c.root").alias("_root"))
        pairs = placed.join(center, "band").where("root != _root").select(F.col("class_id").alias("a"), "b").distinct()
        links = staged(_links(pairs, members, percent), "links")
        if not links.isEmpty():
            labels = _relabel(labels, staged(_of_roots(links, labels), "root_links"))
        release(links)
    apart = _apart(buckets, labels)
    links = staged(_compare_blocks(apart, members, percent), "links")
    if not links.isEmpty():
        labels = _relabel(labels, links)
    release(buckets, members, links)
    return labels


def _of_roots(links: DataFrame, labels: DataFrame) -> DataFrame:
    sides = [labels.select(F.col("class_id").alias(f"_{s}"), F.col("root").alias(f"r{s}")) for s in "ab"]
    joined = links.join(sides[0], F.col("a") == F.col("_a")).join(sides[1], F.col("b") == F.col("_b"))
    return joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def _rows_of(table: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``table`` that ``named`` (class_id, row) has. A bit table of fixed size drops most of the
    others before the join, which decides."""
    spark = table.sparkSession
    spots = named.select(F.explode(F.array(*[F.pmod(F.xxhash64("row", F.lit(k)), F.lit(BITS)) for k in (0, 1)])).alias("s"))
    sent = spark.sparkContext.broadcast(bit_table(spots, BITS))
    n = len(table.columns)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for k in (n, n + 1):
                s = b.column(k).to_numpy()
                keep &= (bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:n]], b.schema.names[:n])

    spotted = table.select(*table.columns, *[F.pmod(F.xxhash64("row", F.lit(k)), F.lit(BITS)).alias(f"_s{k}") for k in (0, 1)])
    return spotted.mapInArrow(drop, table.schema).join(named, "row").drop("row")


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """What is left to compare, by block: (band, block, part, class_id, root, minor).

    In a bucket of several roots, ``minor`` members (not of the most frequent root) meet every member:
    members are dealt into blocks and minor members into parts; each block meets each part.
    """
    placed = buckets.join(labels, "class_id")
    parts = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("band").agg(
        F.sum("n").alias("_n"), F.max("n").alias("_most"), F.max(F.struct("n", "root"))["root"].alias("_main"), F.count(F.lit(1)).alias("_roots")
    ).where("_roots > 1 AND _n > 2")
    minor = F.col("root") != F.col("_main")
    dealt = placed.join(main.drop("_roots"), "band").select(
        "band", "class_id", "root", minor.alias("minor"),
        F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"), F.ceil((F.col("_n") - F.col("_most")) / BLOCK).cast("int").alias("_parts"),
        F.xxhash64("class_id", F.lit("b")).alias("_h"),
    )
    block, part = F.pmod("_h", "_blocks").cast("int"), F.pmod(F.shiftright("_h", 20), "_parts").cast("int")
    every = F.array(F.struct(block.alias("block"), F.sequence(F.lit(0), F.col("_parts") - 1).alias("parts"), F.lit(False).alias("as_minor")))
    as_minor = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda b: F.struct(b.alias("block"), F.array(part).alias("parts"), F.lit(True).alias("as_minor")),
    )
    sent = dealt.select("band", "class_id", "root", F.explode(F.when(F.col("minor"), F.concat(every, as_minor)).otherwise(every)).alias("_x"))
    return sent.select("band", "class_id", "root", F.col("_x.block").alias("block"), F.explode("_x.parts").alias("part"), F.col("_x.as_minor").alias("minor"))


def _compare_blocks(apart: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between roots, as many as join what is similar within each block and part."""
    bounds = least_matches(percent / 100)

    def compare(table: pa.Table) -> pa.Table:
        root, minor = table["root"].to_numpy(), table["minor"].to_numpy(zero_copy_only=False)
        sig = _table(table["signature"].combine_chunks())
        packed = table["members"].to_pylist()
        mine, theirs = np.flatnonzero(minor), np.flatnonzero(~minor)
        to = {int(r): int(r) for r in root}

        def top(r: int) -> int:
            while to[r] != r:
                to[r] = to[to[r]]
                r = to[r]
            return r

        sets: dict[int, np.ndarray] = {}
        a, b = [], []
        for i in mine.tolist():
            others = theirs[root[theirs] != root[i]]
            for j in others[survivors(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others], bounds)].tolist():
                x, y = top(int(root[i])), top(int(root[j]))
                if x == y:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = _unpack(packed[k])
                if similar(sets[i], sets[j], percent):
                    to[max(x, y)] = min(x, y)
                    a.append(x)
                    b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return apart.join(members, "class_id").groupBy("band", "block", "part").applyInArrow(compare, "a long, b long").distinct()


def groups(
    docs: DataFrame, *, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """The kept columns of ``docs`` with n_shingles, component_id, kept and chosen.

    A document's set holds its distinct ``size``-word shingles, of lower-cased words; with fewer words, the
    whole sequence. Documents with equal sets, or ones that share at least ``percent`` in 100 of their union,
    are linked. ``component_id`` is the least id reachable over links; ``kept`` marks the document that has
    it. A text that is null or without words has no shingles and is linked with nothing. Null ids are passed
    over for the least id; a group of them alone has none and keeps all. Repeated rows stay as they are. ``chosen``
    marks one row of every group, also among repeated rows and without ids.
    """
    keep = docs.columns if keep is None else list(keep)
    carried = [c for c in keep if c not in ("n_shingles", "component_id", "kept", "chosen")]
    numbered = docs.select(F.struct(*carried).alias("carried"), F.col(doc_id).alias("id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("row"))
    held = staged(describe(numbered, size=size, text="_text", keep=["carried", "id", "row"]), "described")
    labels = classes(held, percent=percent)
    described, held = held, staged(held.select("carried", "id", "row", "n_shingles", "class_id"), "documents")
    release(described)
    # Of equal ids the first row, and rows without an id last.
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("first")
    least = held.where("class_id IS NOT NULL").groupBy("class_id").agg(F.min(first).alias("first"))
    root = F.coalesce("root", "class_id")
    rooted = least.join(labels, "class_id", "left").select("class_id", "first", root.alias("_root"))
    tops = rooted.groupBy("_root").agg(F.min("first").alias("_top"))
    named = rooted.join(tops, "_root").select(F.col("class_id").alias("_class"), "_top")
    joined = held.join(named, F.col("class_id") == F.col("_class"), "left")
    alone = F.col("class_id").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("_top.id"))
    return joined.select(
        *[F.col("carried").getField(c).alias(c) for c in carried],
        "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
        (alone | (F.col("row") == F.col("_top.row"))).alias("chosen"),
    )
