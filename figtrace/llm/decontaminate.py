"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrace.llm.texts import WORDY, from_texts, plain_words, staged

# An automaton holds about so many item words; larger benchmarks are split over several, applied in turn.
AUTOMATON_WORDS = 100_000
# Longer items are cut into overlapping parts, which have the same windows.
PART_WORDS = 2_000
_WORD = re.compile(rb"[^\x20]+")


class Automaton:
    """All substrings of several word sequences: the longest one that ends at a place is followed word by word."""

    def __init__(self, items: Sequence[tuple[str, Sequence[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items]
        for _, ids in numbered:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        # Which items a window is of, by its state; a short item is a window of its own length.
        self.named: dict[tuple[int, int], set[str]] = {}
        for name, ids in numbered:
            size = min(window, len(ids))
            for _, state in self._windows(ids, size):
                self.named.setdefault((state, size), set()).add(name)
        self.sizes = sorted({size for _, size in self.named}, reverse=True)
        pairs = [a << 32 | b for _, ids in numbered for a, b in zip(ids, ids[1:])]
        self.pairs = np.unique(np.array(pairs, dtype=np.int64))
        self.single = np.unique(np.array([ids[0] for _, ids in numbered if len(ids) == 1], dtype=np.int64))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        held = nxt[last].get(w)
        if held is not None and length[held] == length[last] + 1:
            return held
        if held is None:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
        else:
            cur = -1
        p = last
        while held is None and p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if held is None and p < 0:
            return cur
        q = nxt[p][w]
        if length[q] == length[p] + 1:
            if cur >= 0:
                link[cur] = q
            return cur if cur >= 0 else q
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        if cur >= 0:
            link[cur] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return cur if cur >= 0 else clone

    def _suffix(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of what ``state`` matched."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _windows(self, ids: Sequence[int], size: int) -> Iterator[tuple[int, int]]:
        state = 0
        for i, w in enumerate(ids):
            state = self.next[state][w]
            if i + 1 >= size:
                state = self._suffix(state, size)
                yield i + 1, state

    def find(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside windows (merged, in order) and the items that those windows are of."""
        if not self.sizes or len(words) < self.sizes[-1]:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, _minus_ones()), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for begin, end in self._runs(ids):
            self._stream(ids[begin:end].tolist(), begin, spans, names)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, names

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """The stretches in which every two neighbours are neighbours in an item: all matches lie within one."""
        runs = []
        if self.single.size:
            runs += [(i, i + 1) for i in np.flatnonzero(np.isin(ids, self.single)).tolist()]
        if self.pairs.size and len(ids) > 1:
            pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << 32 | ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            edge = np.diff(np.r_[0, (self.pairs[at] == pair).astype(np.int8), 0])
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            least = min((s for s in self.sizes if s > 1), default=self.window)
            long = end - begin >= least
            runs += list(zip(begin[long].tolist(), end[long].tolist()))
        return runs

    def _stream(self, ids: list[int], begin: int, spans: list[tuple[int, int]], names: set[str]) -> None:
        nxt, link, length, named, sizes = self.next, self.link, self.length, self.named, self.sizes
        state = matched = 0
        for i, w in enumerate(ids):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(w, 0)
            matched = matched + 1 if state else 0
            at = state
            for size in sizes:
                if size <= matched:
                    at = self._suffix(at, size)
                    if found := named.get((at, size)):
                        spans.append((begin + i + 1 - size, begin + i + 1))
                        names |= found


def _minus_ones() -> Iterator[int]:
    while True:
        yield -1


def mark(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: Sequence[str] | None = None,
    automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` of words that stand inside occurrences of item windows, and ``items``.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, one without
    words none. ``spans`` is an array of (start, end) word numbers in order, end exclusive; those of different
    automata may overlap. ``items`` are the distinct ids, as text, of items with an occurring window (a null
    id is the empty text). A null or empty text has no words. Rows stay as they are, repeated ones too.

    Items are brought to the driver in groups of about ``automaton_words`` words; each group's automaton is
    built in the tasks, and the documents pass one group after the other, written out in between.
    """
    spark = docs.sparkSession

    def cut():
        step = PART_WORDS - window + 1

        def compute(texts):
            parts = []
            for t in texts:
                w = plain_words(t)
                parts.append([b" ".join(w[i : i + PART_WORDS]).decode() for i in range(0, max(1, len(w) - window + 1), step)] if w else [])
            return (parts,)

        return compute

    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("_id"), F.col(item_text).alias("_t"))
    parts = from_texts(named, "_parts array<string>", cut, text="_t", keep=["_id"]).select("_id", F.explode("_parts").alias("_part"))
    parts = staged(parts.distinct(), "items")
    total = parts.agg(F.sum(F.size(F.split("_part", " ")))).first()[0] or 0
    groups = max(1, -(-total // automaton_words))

    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "spans", "items")]
    found = docs.select(*dict.fromkeys([*kept, text]))
    names: list[int] = []
    for g in range(groups):
        of_group = parts.where(F.pmod(F.xxhash64("_part"), F.lit(groups)) == g).orderBy("_id", "_part").collect()
        sent = spark.sparkContext.broadcast([(r[0], r[1].encode().split(b" ")) for r in of_group])

        def make(sent=sent):
            automaton = Automaton(sent.value, window)

            def compute(texts):
                n, spans, ids = [], [], []
                for t in texts:
                    w = plain_words(t)
                    s, i = automaton.find(w)
                    n.append(len(w))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    ids.append(sorted(i))
                return n, spans, ids

            return compute

        fields = f"n_words long, _spans_{g} array<struct<start: long, end: long>>, _items_{g} array<string>"
        carried = [f"_{c}_{i}" for i in names for c in ("spans", "items")]
        found = from_texts(found, fields, make, text=text, keep=[*(kept if g == groups - 1 else dict.fromkeys([*kept, text])), *carried])
        names.append(g)
        if g < groups - 1:
            found = staged(found, "spans")
    spans = F.array_sort(F.flatten(F.array(*[f"_spans_{g}" for g in names])))
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[f"_items_{g}" for g in names]))))
    return found.select(*kept, "n_words", spans.alias("spans"), ids.alias("items"))


def covered(spans) -> F.Column:
    """How many words the spans of a document cover, each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(held, s):
        fresh = F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], held["end"]))
        return F.struct(F.greatest(s["end"], held["end"]).alias("end"), (held["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, add, lambda held: held["n"])


def remove(
    docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.8, text: str = "text", **names
) -> DataFrame:
    """``docs`` without the spans that ``mark`` finds: clean documents stay to the byte.

    Of a document with spans, the text from the first to the last word of each span goes. A document of
    which spans cover more than ``max_coverage`` of the words goes whole.
    """
    marked = mark(docs, items, window=window, text=text, **names).withColumn("_hit", covered(F.col("spans")))
    kept = marked.where(F.col("_hit") <= F.col("n_words") * max_coverage)

    def make():
        def compute(texts, spans):
            return ([_without(t, s) if s else t for t, s in zip(texts, spans)],)

        return compute

    cleaned = from_texts(kept, "_clean binary", make, text=text, also=["spans"], keep=docs.columns)
    return cleaned.select(*[F.col("_clean").cast("string").alias(c) if c == text else c for c in docs.columns])


def _without(text: bytes, spans: list[dict]) -> bytes:
    places = [m.span() for m in _WORD.finditer(text.translate(WORDY))]
    out, at = [], 0
    for s in spans:
        out.append(text[at : max(at, places[s["start"]][0])])
        at = max(at, places[s["end"] - 1][1])
    return b"".join([*out, text[at:]])
