"""Alignment of two tokenizers' tokens over the same bytes, as an Arrow pipeline inside Spark tasks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from figtrace.llm.bpe import encoder
from figtrace.llm.chunks import byte_letters
from figtrace.llm.texts import slices, staged

# Texts are aligned in slices of about so many bytes.
SLICE = 1 << 20
# The linked pairs held by most documents are sent to all tasks: at most so many. Rarer ones are joined.
COMMON = 1 << 20
# Partial counts of pairs a task gathers before it passes them on.
PARTIAL = 1 << 20


class Side:
    """One tokenizer: how texts are encoded, each with a space before it, and the bytes of every token."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                held = json.load(f)
            byte_of = {c: b for b, c in enumerate(byte_letters())}
            added = {t["id"]: t["content"].encode() for t in held.get("added_tokens", [])}
            entries = {i: bytes(byte_of[c] for c in t) for t, i in held["model"]["vocab"].items() if i not in added} | added
            tokens = [entries.get(i, b"") for i in range(1 + max(entries))]
            encode = encoder(path, specials=False)
            self._encode = lambda texts: [encode(" " + t) for t in texts]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            tokens = [piece_bytes(model.id_to_piece(i)) for i in range(model.get_piece_size())]
            self._encode = lambda texts: [np.array(ids, dtype=np.int32) for ids in model.encode(texts, num_threads=1)]
        self.bytes = pa.array(tokens, pa.binary())
        self.length = pa.array(map(len, tokens), pa.int64())
        self.decimal = pa.array(map(str, range(len(tokens))), pa.string())

    def lists(self, texts: list[str]) -> pa.Array:
        """The token ids of each text; none of an empty one."""
        ids = [x.astype(np.int32, copy=False) for x in self._encode(texts)]
        empty = np.zeros(0, dtype=np.int32)
        ids = [x if t else empty for x, t in zip(ids, texts)]
        ends = np.cumsum([0, *map(len, ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([empty, *ids])))

    def differ(self, lists: pa.Array, texts: list[str]) -> list[int]:
        """The texts whose bytes, after a space, are not those of their tokens."""
        flat = lists.flatten()
        want = [b" " + t.encode() if t else b"" for t in texts]
        # The bytes of all tokens lie side by side in one buffer.
        joined = self.bytes.take(flat).buffers()[2]
        held = joined.to_pybytes() if joined else b""
        sizes = np.concatenate([[0], np.cumsum(self.length.take(flat).to_numpy())])
        held = held[: int(sizes[-1])]
        if held == b"".join(want):
            return []
        at = sizes[lists.offsets.to_numpy()].tolist()
        return [i for i, w in enumerate(want) if held[at[i] : at[i + 1]] != w]


def piece_bytes(piece: str) -> bytes:
    """A piece's bytes: U+2581 is a space, ``<0xHH>`` the byte HH."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def token_lists(texts: list[bytes | None], sides: Sequence[Side]) -> list[pa.Array]:
    """Each side's tokens of every text; none for a text that is null or empty, or whose bytes either side does not keep."""
    plain = [_decoded(t) for t in texts]
    lists = [side.lists(plain) for side in sides]
    lost = {i for side, held in zip(sides, lists) for i in side.differ(held, plain)}
    if not lost:
        return lists
    kept = ["" if i in lost else t for i, t in enumerate(plain)]
    return [side.lists(kept) for side in sides]


def _decoded(text: bytes | None) -> str:
    """The text; empty where its bytes are not UTF-8, as no tokens can have these bytes."""
    try:
        return text.decode("utf-8") if text else ""
    except UnicodeDecodeError:
        return ""


def aligned(lists: Sequence[pa.Array], sides: Sequence[Side]) -> tuple[list[pa.Array], pa.Table, pa.Array]:
    """Per document n_a, n_b, n_groups and n_links; the links as a table (doc, pair); each document's groups as text.

    Both sides are flattened to one row per token with its document and its end in it, and joined on these two.
    The ends of either side cut the bytes into stretches that lie in one token of each: these are the links. The
    ends that both sides have close the groups.
    """
    n_docs = len(lists[0])
    tables, tokens, n_tokens = [], [], []
    for i, (held, side) in enumerate(zip(lists, sides)):
        ids, doc = pc.list_flatten(held), pc.list_parent_indices(held).to_numpy()
        total = pc.cumulative_sum(side.length.take(ids)).to_numpy(zero_copy_only=False)
        first = np.searchsorted(doc, np.arange(n_docs))
        end = total - np.r_[0, total][first][doc]
        tables.append(pa.table({"key": pa.array(doc.astype(np.int64) << 32 | end), f"at_{i}": pa.array(np.arange(len(ids)))}))
        tokens.append(ids)
        n_tokens.append(np.bincount(doc, minlength=n_docs))
    met = tables[0].join(tables[1], "key", join_type="full outer", use_threads=False).combine_chunks()
    met = met.take(pc.sort_indices(met["key"]))
    key = met["key"].to_numpy()
    doc = key >> 32
    shared = pc.and_(pc.is_valid(met["at_0"]), pc.is_valid(met["at_1"])).to_numpy()
    # A cut that one side lacks lies inside the token which ends next.
    pair = [tokens[i].take(pc.fill_null_backward(met[f"at_{i}"]).combine_chunks()).to_numpy().astype(np.int64) for i in (0, 1)]
    links = pa.table({"doc": pa.array(doc), "pair": pa.array(pair[0] << 32 | pair[1])})

    texts = []
    for i, side in enumerate(sides):
        closes = met[f"at_{i}"].filter(pa.array(shared)).to_numpy()
        groups = pa.ListArray.from_arrays(pa.array(np.r_[0, closes + 1], pa.int32()), side.decimal.take(tokens[i]))
        texts.append(pc.binary_join(groups, ","))
    n_groups = np.bincount(doc[shared], minlength=n_docs)
    ends = pa.array(np.r_[0, np.cumsum(n_groups)], pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(ends, pc.binary_join_element_wise(*texts, "|")), ";")
    return [pa.array(c, pa.int64()) for c in (*n_tokens, n_groups, np.bincount(doc, minlength=n_docs))], links, text


def alignments(
    docs: DataFrame, a: str, b: str, *, text: str = "text", keep: Sequence[str] | None = None, digest: bool = False
) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, the groups, and the linked id pairs with how often each is linked.

    ``a`` and ``b`` are paths of vocabulary files that every executor can read: byte-level BPE (.json), or pieces with
    byte fallback (.model). Both sides tokenize a space and the text. ``groups`` is ``a1,a2|b1;a3|b2,b3`` with the
    ids of each group in order, or with ``digest`` its SHA-256 in hexadecimal, as ``groups_sha256``; it is empty
    where there are no tokens. ``pairs`` has the linked id pairs (first id in the upper half), ``times`` their counts.
    A null or empty text, or one whose bytes either side's tokens don't give back, has zeros and empty lists. Rows
    stay as they are, repeated ones too; columns called like the new ones are replaced.
    """
    shown = "groups_sha256" if digest else "groups"
    new = StructType.fromDDL(f"n_a long, n_b long, n_groups long, n_links long, {shown} string, pairs array<long>, times array<int>")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in kept]
    out = StructType([*docs.select(*columns).schema.fields, *new.fields])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [Side(a), Side(b)]
        for batch in slices(batches, n, SLICE):
            counts, links, groups = aligned(token_lists(batch.column(n).to_pylist(), sides), sides)
            if digest:
                groups = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups.cast(pa.binary()).to_pylist()], pa.string())
            per_doc = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
            ends = np.cumsum(np.bincount(per_doc["doc"].to_numpy(), minlength=len(batch)))
            offsets = pa.array(np.r_[0, ends], pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, per_doc[c].combine_chunks().cast(t))
                for c, t in (("pair", pa.int64()), ("count_all", pa.int32()))
            ]
            arrays = [*batch.columns[:n], *counts, groups, *lists]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:n], *new.names])

    return docs.select(*columns, F.col(f"`{text}`").cast("binary").alias("_text")).mapInArrow(run, out)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold a pair linked, and whether no other pair of its first id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[pa.Table]) -> pa.Table:
            table = pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return table.rename_columns(["pair", "n"])

        def passed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.select(["pair", "n"]).combine_chunks().to_batches()

        gathered: list[pa.Table] = []
        for batch in batches:
            pairs = pc.list_flatten(batch.column(0))
            if len(pairs):
                counted = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
                gathered = [merged([*gathered, pa.table({"pair": counted["pair"], "n": counted["count_all"]})])]
                if len(gathered[0]) > PARTIAL:
                    yield from passed(gathered.pop())
        if gathered:
            yield from passed(gathered[0])

    counted = held.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = staged(counted, "pair_counts")
    first = F.shiftright("pair", 32)
    most = counted.groupBy(first.alias("_a")).agg(F.max("n").alias("_most"))
    return counted.join(most, first == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def align(
    docs: DataFrame, a: str, b: str, *, text: str = "text", keep: Sequence[str] | None = None, digest: bool = False, common: int = COMMON
) -> DataFrame:
    """``alignments`` with n_best and count_sum instead of the pairs.

    A pair's count is the number of documents (rows) that hold it linked; ``count_sum`` is its sum over all links,
    ``n_best`` the number of links whose count is the highest of any pair with their first id, ties included. At
    most ``common`` pairs, those in most documents, are sent to all tasks; the others are joined. No rows give none;
    a column ``_row`` is left out.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_best", "count_sum", "_row")]
    marked = alignments(docs, a, b, text=text, keep=kept, digest=digest).withColumn("_row", F.monotonically_increasing_id())
    held = staged(marked, "alignments")
    counts = staged(pair_counts(held), "pair_ranks")
    bar = _bar(counts, common)
    sent = counts.where(F.col("n") >= bar).sort("pair").toArrow()
    known = docs.sparkSession.sparkContext.broadcast([sent[c].to_numpy() for c in ("pair", "n", "best")])

    n_kept = len(held.columns) - 3
    names = [c for c in held.columns if c not in ("pairs", "times")]
    summed = StructType([held.schema[c] for c in names] + StructType.fromDDL("n_best long, count_sum long").fields)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(n_kept)
            times = pc.list_flatten(batch.column(n_kept + 1)).to_numpy().astype(np.int64)
            n, best, _ = _looked_up(known.value, pc.list_flatten(lists).to_numpy())
            of = pc.list_parent_indices(lists).to_numpy()
            sums = []
            for value in (times * best, times * n):
                total = np.zeros(len(batch), dtype=np.int64)
                np.add.at(total, of, value)
                sums.append(pa.array(total))
            others = [batch.column(i) for i, c in enumerate(batch.schema.names) if c in names]
            yield pa.RecordBatch.from_arrays([*others, *sums], summed.names)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pc.list_flatten(batch.column(1))
            unknown = pa.array(~_looked_up(known.value, pairs.to_numpy())[2])
            row = batch.column(0).take(pc.list_parent_indices(batch.column(1)))
            times = pc.list_flatten(batch.column(2))
            yield pa.RecordBatch.from_arrays([c.filter(unknown) for c in (row, pairs, times)], ["_row", "pair", "times"])

    result = held.mapInArrow(add, summed)
    rare = counts.where(F.col("n") < bar)
    if bar > 1 and not rare.isEmpty():
        unknown = held.select("_row", "pairs", "times").mapInArrow(rest, "_row long, pair long, times int")
        found = unknown.join(rare, "pair").groupBy(F.col("_row").alias("_r")).agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
        )
        more = [(F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c) for c, x in (("n_best", "_best"), ("count_sum", "_sum"))]
        result = result.join(found, F.col("_row") == F.col("_r"), "left").select(*names, *more)
    return result.drop("_row")


def _bar(counts: DataFrame, common: int) -> int:
    """The least power of two that at most ``common`` pairs reach; by how many pairs there are of each size (64 rows)."""
    size = F.length(F.bin("n"))
    sizes = {r[0]: r[1] for r in counts.groupBy(size).agg(F.count(F.lit(1))).collect()}
    for bits in range(0, 64):
        if sum(n for s, n in sizes.items() if s > bits) <= common:
            return 1 << bits
    return 1 << 62


def _looked_up(known: list[np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts and best marks of pairs, zero for those not known, and which are known."""
    keys, n, best = known
    if not len(keys):
        return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
    met = keys[at] == pairs
    return np.where(met, n[at], 0), (met & best[at]).astype(np.int64), met
