"""Ranked lexical search for a set of items over all documents, by dual-tree search.

Documents and items are held as trees whose nodes have the greatest value of each coordinate below them. The
product of two nodes bounds every score between them; a pair of nodes is left out when that is less than the
weakest kth score of its items. What is left is scored exactly, so nothing is missed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figtrace.llm.texts import from_texts, plain_words, ragged, release, staged

# Items are searched for in passes over the postings, of at most about so many terms each; a pass is sent to all tasks.
PASS_TERMS = 1 << 16
# A tree of items has at most so many items and, unless it has one item only, so many distinct terms.
TREE_ITEMS, TREE_TERMS = 256, 4096
# A tree of documents has so many documents, fewer where items have many terms: its coordinates stay within CELLS.
TREE_DOCS, CELLS = 1024, 1 << 22
ITEM_LEAF, DOC_LEAF, FAN = 4, 8, 8
# The first thresholds come from about so many documents.
SAMPLE = 16_384
NO_ID = np.iinfo(np.int64).max


def search(
    docs: DataFrame, items: DataFrame, *, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", sample: int = SAMPLE,
    pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 for every item.

    Scores are BM25 in integers, with N documents that have terms, L terms in all, n in a document and df documents
    of a term: a term weighs w = floor(1000 ln((2N+2)/(2df+1))), and each of the item's terms, repeats included, adds
    w * (10^9 tf div (1000 tf + 8 m)) with m = 25 + 75nN div L. Equal scores rank by ascending id, which is an
    integer; documents without one come last. Terms are ``plain_words``: a null or empty text, of any length, has
    none, and such items and documents are in no result. Each row is an item or a document of its own, repeated rows too,
    and other columns are left alone. No items or no documents give no rows.
    """
    spark = docs.sparkSession
    numbered = staged(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_item")), "items")
    listed = staged(from_texts(numbered, "terms array<binary>", lambda: lambda texts: ([plain_words(t) for t in texts],), keep=["_item"]), "item_terms")
    n_terms = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = -(-n_terms // pass_terms)
    found = None
    for i in range(passes):
        wanted = {r["_item"]: r["terms"] for r in listed.where(F.pmod(F.xxhash64("_item"), F.lit(passes)) == i).collect() if r["terms"]}
        if wanted:
            best = _one_pass(docs, wanted, k, text, doc_id, sample)
            found = best if found is None else found.unionByName(best)
    release(listed)
    if found is None:
        release(numbered)
        kept = numbered.select("item_id").schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kept}, rank int, doc_id long, score long")
    named = numbered.select("item_id", F.col("_item").alias("_i"))
    return found.join(named, F.col("_item") == F.col("_i")).select("item_id", "rank", "doc_id", "score")


def _one_pass(docs: DataFrame, wanted: dict[int, list[bytes]], k: int, text: str, doc_id: str, sample: int) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted(set().union(*wanted.values()))
    held = staged(postings(docs, terms, text=text, doc_id=doc_id), "postings")
    n_docs, n_all, of_term = corpus_counts(held, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in of_term], dtype=np.int64)
    groups = item_groups(wanted, {t: i for i, t in enumerate(terms)}, weight)
    sent = spark.sparkContext.broadcast((groups, len(terms), n_docs, n_all))

    share = max(1, n_docs // sample)
    floors: dict[int, int] = {}
    if share > 1:
        # The kth score among any documents is one that the final kth cannot fall below.
        some = held.where(F.pmod(F.xxhash64("_row"), F.lit(share)) == 0)
        floors = {r["_item"]: r["score"] for r in _best(some, sent, floors, k).where(F.col("rank") == k).select("_item", "score").collect()}
    return _best(held, sent, floors, k)


def postings(docs: DataFrame, terms: list[bytes], *, text: str, doc_id: str) -> DataFrame:
    """(_row, doc_id, n, terms, times) of every document with terms: how many it has, and which of ``terms`` how often."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        number = {t: i for i, t in enumerate(sent.value)}.get

        def compute(texts):
            words = [plain_words(t) for t in texts]
            met = [Counter(map(number, w)) for w in words]
            for m in met:
                m.pop(None, None)
            return [len(w) for w in words], [list(m) for m in met], [list(m.values()) for m in met]

        return compute

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = from_texts(source, "n long, terms array<int>, times array<long>", make, keep=["doc_id"])
    return found.where("n > 0").withColumn("_row", F.monotonically_increasing_id())


def corpus_counts(held: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms in all, and the documents of each term; every task counts its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    n_docs, n_all = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    of_term = np.zeros(n_terms, dtype=np.int64)
    counted = held.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counted.collect():
        of_term[r["term"]] = r["df"]
    return n_docs, n_all, of_term


Sparse = tuple[np.ndarray, ...]


def item_groups(wanted: dict[int, list[bytes]], number: dict[bytes, int], weight: np.ndarray) -> list[Sparse]:
    """What each tree over the items is made of, as plain arrays: the items, and of every weight its row, term and value.

    Items with the same rarest term are side by side.
    """
    sparse = {}
    for item, words in wanted.items():
        times = Counter(number[w] for w in words)
        at = np.array(sorted(times), dtype=np.int64)
        sparse[item] = (at, np.array([times[i] for i in at.tolist()], dtype=np.int64) * weight[at])
    order = sorted(sparse, key=lambda i: (-int(sparse[i][1].max()), int(sparse[i][0][sparse[i][1].argmax()]), i))
    groups, seen = [[]], set()
    for item in order:
        own = set(sparse[item][0].tolist())
        if groups[-1] and (len(groups[-1]) == TREE_ITEMS or len(seen | own) > TREE_TERMS):
            groups.append([])
            seen = set()
        groups[-1].append(item)
        seen |= own
    return [
        (
            np.array(g, dtype=np.int64), np.repeat(np.arange(len(g)), [len(sparse[i][0]) for i in g]),
            np.concatenate([sparse[i][0] for i in g]), np.concatenate([sparse[i][1] for i in g]),
        )
        for g in groups
    ]


def levels(leaves: np.ndarray) -> list[np.ndarray]:
    """Coordinate maxima from the leaves up: each node has those of ``FAN`` nodes below, until there is one."""
    held = [leaves]
    while len(held[-1]) > 1:
        held.append(np.maximum.reduceat(held[-1], np.arange(0, len(held[-1]), FAN)))
    return held


class ItemTree:
    """Items with their weights for the terms they have, and the maxima of these from leaf to root."""

    def __init__(self, items: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.items, self.terms = items, np.unique(term)
        # Sums of products are exact in doubles below 2^53; a document's side is at most 10^6.
        exact = int(np.add.reduceat(weight, np.searchsorted(row, np.arange(len(items)))).max()) * 10**6 < 2**53
        self.weights = np.zeros((len(items), len(self.terms)), dtype=np.float64 if exact else np.int64)
        self.weights[row, np.searchsorted(self.terms, term)] = weight
        self.leaf_starts = np.arange(0, len(items), ITEM_LEAF)
        self.levels = levels(np.maximum.reduceat(self.weights, self.leaf_starts))

    def weakest(self, kth: np.ndarray) -> list[np.ndarray]:
        """The least threshold below every node, level by level."""
        held = [np.minimum.reduceat(kth, self.leaf_starts)]
        for _ in self.levels[1:]:
            held.append(np.minimum.reduceat(held[-1], np.arange(0, len(held[-1]), FAN)))
        return held


class Best:
    """The best k documents met so far for each item of a tree; ``kth`` is the score a document must reach."""

    def __init__(self, tree: ItemTree, floors: dict[int, int], k: int):
        self.k = k
        self.kth = np.array([max(1, floors.get(i, 1)) for i in tree.items.tolist()], dtype=np.int64)
        self.found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(tree.items)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.kth[i]
        if not good.any():
            return
        scores, ids = np.concatenate([self.found[i][0], scores[good]]), np.concatenate([self.found[i][1], ids[good]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = scores[first], ids[first]
        if len(first) == self.k:
            self.kth[i] = max(self.kth[i], scores[first[-1]])


def dual_search(tree: ItemTree, values: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Adds documents, rows of ``values`` by the tree's terms, to the best of its items; the pairs scored."""
    rank = np.argmax(values * tree.weights.max(axis=0), axis=1)
    order = np.argsort(rank, kind="stable")
    values, ids = values[order], ids[order]
    starts = np.arange(0, len(values), DOC_LEAF)
    docs = levels(np.maximum.reduceat(values, starts))
    weakest = tree.weakest(best.kth)
    # From the roots down; the side with more levels above it descends alone first.
    i, d = len(tree.levels) - 1, len(docs) - 1
    alive = np.ones((1, 1), dtype=bool)
    while True:
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return 0
        bound = tree.levels[i][rows] @ docs[d][columns].T
        at = np.ix_(rows, columns)
        alive[at] &= bound >= weakest[i][rows][:, None]
        if not (i or d):
            break
        down_i, down_d = i and i >= d, d and d >= i
        if down_i:
            i -= 1
            alive = np.repeat(alive, FAN, axis=0)[: len(tree.levels[i])]
        if down_d:
            d -= 1
            alive = np.repeat(alive, FAN, axis=1)[:, : len(docs[d])]
    bounds = np.zeros(alive.shape)
    bounds[at] = bound
    scored = 0
    for leaf in np.flatnonzero(alive.any(axis=1)).tolist():
        # Most promising leaves first, so that the thresholds rise early.
        near = np.flatnonzero(alive[leaf])
        near = near[np.argsort(-bounds[leaf, near], kind="stable")]
        first = leaf * ITEM_LEAF
        members = range(first, min(first + ITEM_LEAF, len(tree.items)))
        for part in np.array_split(near, -(-len(near) // 16)):
            part = part[bounds[leaf, part] >= best.kth[members.start : members.stop].min()]
            if not len(part):
                break
            row = ragged(starts[part], np.minimum(DOC_LEAF, len(values) - starts[part]))
            scores = (tree.weights[members.start : members.stop] @ values[row].T).astype(np.int64)
            scored += scores.size
            for m, s in zip(members, scores):
                best.add(m, s, ids[row])
    return scored


def _best(held: DataFrame, sent, floors: dict[int, int], k: int) -> DataFrame:
    """(_item, rank, doc_id, score) of the best documents; a task gives at most ``k`` for an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, n_terms, n_docs, n_all = sent.value
        trees = [ItemTree(*g) for g in groups]
        best = [Best(t, floors, k) for t in trees]
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            m = np.array([25 + 75 * n * n_docs // n_all for n in batch.column(1).to_pylist()], dtype=np.int64)
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy())
            term, times = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            value = 10**9 * times // (1000 * times + 8 * np.repeat(m, np.diff(ends, prepend=0)))
            for tree, b in zip(trees, best):
                column = np.full(n_terms, -1, dtype=np.int64)
                column[tree.terms] = np.arange(len(tree.terms))
                step = max(DOC_LEAF, min(TREE_DOCS, CELLS // len(tree.terms)))
                for first in range(0, len(ids), step):
                    last = min(first + step, len(ids))
                    a, z = int(ends[first - 1]) if first else 0, int(ends[last - 1])
                    row = np.repeat(np.arange(last - first), np.diff(ends[first:last], prepend=a))
                    at = column[term[a:z]]
                    met = at >= 0
                    values = np.zeros((last - first, len(tree.terms)), dtype=tree.weights.dtype)
                    values[row[met], at[met]] = value[a:z][met]
                    dual_search(tree, values, ids[first:last], b)
        for tree, b in zip(trees, best):
            sizes = [len(s) for s, _ in b.found]
            if sum(sizes):
                scores, ids = (np.concatenate([f[j] for f in b.found]) for j in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(tree.items, sizes)), pa.array(ids), pa.array(scores)], ["_item", "_id", "score"]
                )

    found = held.select("doc_id", "n", "terms", "times").mapInArrow(run, "_item long, _id long, score long")
    by: list[Column] = [F.desc("score"), F.asc("_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*by))).where(F.col("rank") <= k)
    return ranked.select("_item", "rank", F.nullif("_id", F.lit(int(NO_ID))).alias("doc_id"), "score")
