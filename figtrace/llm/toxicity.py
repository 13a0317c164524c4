"""Toxicity by class-conditional Kneser-Ney models with shared backoff."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrace.llm.fitting import log_loss, logistic, probability
from figtrace.llm.texts import from_texts, give_back, plain_words, release, staged
from figtrace.llm.word_counts import Hashes

# Labelled documents a model is fitted on at most: those with the least hash of their id.
SAMPLE = 20_000
# One labelled document in so many calibrates the scores instead of being counted.
CALIBRATE = 5
# Levels of an expression: the word, then its first bytes, longest first; all classes share what is below.
STEMS = (7, 6, 5, 4)
WORD = 0
DISCOUNTS = (1.0, 2.0, 4.0)
WINDOW = 2
# Pairs of words whose ratios are taken at a time.
BLOCK = 1 << 17


@dataclass
class Model:
    """Log-likelihood ratio, toxic over ordinary, of each expression with evidence, by level, and of each word
    after the one before, by hash; calibration weights. Arrays, as the driver holds several models."""

    expressions: dict[int, tuple[pa.Array, np.ndarray]]
    weights: tuple[float, ...] | None  # of document ratio, passage ratio, one; None: no examples of both
    pairs: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.float32)))

    @property
    def ratios(self) -> dict[int, dict[bytes, float]]:
        return _tables(self.expressions)


def _tables(expressions: dict[int, tuple[pa.Array, np.ndarray]]) -> dict[int, dict[bytes, float]]:
    return {level: dict(zip(keys.to_pylist(), known.tolist())) for level, (keys, known) in expressions.items()}


class _Ratio(dict):
    """Word -> ratio of the longest of its expressions that has one."""

    def __init__(self, ratios: dict[int, dict[bytes, float]], pairs: tuple[np.ndarray, np.ndarray], hashes: Hashes):
        super().__init__()
        self.pairs, self.hashes = pairs, hashes
        self.words = ratios.get(WORD, {})
        self.stems = [(n, ratios[n]) for n in STEMS if ratios.get(n)]

    def __missing__(self, word: bytes) -> float:
        if len(self) > 1_000_000:
            self.clear()
        found = self.words.get(word)
        if found is None:
            found = next((held[word[:n]] for n, held in self.stems if word[:n] in held and len(word) >= n), 0.0)
        self[word] = found
        return found


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One hash of two words' hashes, in order."""
    return before * np.int64(-7046029254386353131) + (word ^ (word >> 29))


def train(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> Model:
    """Fit on labelled documents: ``labels`` has ``doc_id`` and 0 or 1; rows with a null in either are skipped.

    Per class, an expression's count is the number of distinct words it follows (its continuation count).
    Above these levels stands the word after the one before, by the number of documents that hold both in a row;
    its discount goes to the word's continuation counts. Every level takes a discount off the counts and gives it to the level below by a weight that both classes
    share, in proportion to counts of both classes together. An expression whose counts stay under the
    discount therefore has the ratio of the level below, and need not be held. The discount is the one of
    ``DISCOUNTS`` that does best on the calibration documents.
    """
    spark = docs.sparkSession
    held = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"), F.xxhash64(F.col(doc_id).cast("string")).alias("_h")
    )
    held = held.groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_h").alias("_h")).orderBy("_h", "_id").limit(sample)
    chosen = staged(held, "labelled")
    labelled = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    calibrates = F.pmod(F.col("_h"), F.lit(CALIBRATE)) == 0

    def expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number: dict[bytes, int] = {b"": 0}
            pairs: list[list[np.ndarray]] = [[], []]
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([0, *[number.setdefault(w, len(number)) for w in plain_words(t)]], dtype=np.int64)
                pairs[y].append(np.unique(ids[:-1] << 32 | ids[1:]))
            words = pa.array(list(number), pa.binary())
            hashed = Hashes().of(list(number))
            for y in (0, 1):
                if pairs[y]:
                    p, n = np.unique(np.concatenate(pairs[y]), return_counts=True)
                    a, b = p >> 32, p & 0xFFFFFFFF
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), y, dtype=np.int32)), words.take(pa.array(a)), words.take(pa.array(b)), pa.array(_pair(hashed[a], hashed[b])), pa.array(n)],
                        ["y", "before", "word", "h", "n"],
                    )

    followed = labelled.where(~calibrates).select("_y", F.col("_text").cast("binary").alias("_text")).mapInArrow(
        expressions, "y int, before binary, word binary, h long, n long"
    )
    in_class = [F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in (0, 1)]
    pairs = staged(followed.groupBy("before", "word").agg(F.first("h").alias("h"), *in_class), "pairs")
    per_word = pairs.groupBy("word").agg(*[F.count(F.when(F.col(f"c{c}") > 0, 1)).alias(f"c{c}") for c in (0, 1)])
    level = F.explode(F.array(F.lit(WORD), *[F.when(F.length("word") >= n, F.lit(n)) for n in STEMS])).alias("level")
    keyed = per_word.select("word", "c0", "c1", level).where("level IS NOT NULL")
    key = F.when(F.col("level") == WORD, F.col("word")).otherwise(F.col("word").substr(F.lit(1), F.col("level")))
    counts = staged(keyed.groupBy("level", key.alias("key")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "expressions")
    both = F.col("c0") + F.col("c1")
    totals = counts.groupBy("level").agg(
        F.sum("c0"), F.sum("c1"), *[F.sum(F.least(both, F.lit(d))) / F.sum(both) for d in DISCOUNTS]
    ).collect()
    total = {r[0]: r[1:] for r in totals}
    if WORD not in total or not total[WORD][0] or not total[WORD][1]:
        return Model({}, None)
    evident = counts.where(F.greatest("c0", "c1") > min(DISCOUNTS)).toArrow()

    heads = pairs.groupBy("before").agg(
        F.sum("c0").alias("v0"), F.sum("c1").alias("v1"), *[(F.sum(F.least(both, F.lit(d))) / F.sum(both)).alias(f"s{i}") for i, d in enumerate(DISCOUNTS)]
    )
    after = pairs.where(F.greatest("c0", "c1") > min(DISCOUNTS)).join(heads, "before").join(per_word.select("word", both.alias("both")), "word")
    after = after.select("h", "word", *[F.col(c).cast("float").alias(c) for c in ("c0", "c1", "v0", "v1", "both", *[f"s{i}" for i in range(len(DISCOUNTS))])]).toArrow()

    # One model after the other, so that the driver holds the best one and the next.
    probes = staged(labelled.where(calibrates).select("_y", F.col("_text")), "probes")
    levels = _levels(evident)
    del evident
    below = {n: _places(levels[n][0], levels, [k for k in STEMS if k < n or n == WORD]) for n in levels}
    coded = after["word"].combine_chunks().dictionary_encode()
    after, of_word = after.drop_columns("word"), coded.indices.to_numpy()
    below_pairs = _places(coded.dictionary, levels, (WORD, *STEMS))
    del coded
    give_back()
    best = None
    for i in range(len(DISCOUNTS)):
        ratios, mass = _ratios(levels, below, total, i)
        model = ratios, _after(after, of_word, below_pairs, mass, total, i)
        del ratios, mass
        seen = _probed(probes, model)
        x, y = seen[:, 1:], seen[:, 0]
        w = logistic(x, y)
        loss = log_loss(probability(x @ w[:-1] + w[-1]), y) if len(y) else np.inf
        if best is None or loss < best[0]:
            best = loss, model, tuple(w) if len(y) else (1.0, 4.0, -8.0)
        del model
        give_back()
    del levels, below, after, of_word, below_pairs
    release(chosen, pairs, counts, probes)
    give_back()
    return Model(best[1][0], best[2], best[1][1])


def _probed(probes: DataFrame, model: tuple) -> np.ndarray:
    """The labels of the calibration documents and their features under a model."""
    sent = probes.sparkSession.sparkContext.broadcast(model)

    def make():
        expressions, pairs = sent.value
        table = _Ratio(_tables(expressions), pairs, Hashes())
        return lambda texts: [list(c) for c in zip(*[features(table, t) for t in texts])]

    found = from_texts(probes, "m double, p double", make, text="_text", keep=["_y"]).collect()
    sent.destroy()
    return np.array(found, dtype=float).reshape(-1, 3)


def _levels(evident: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The expressions of every level and their counts in both classes."""
    found = {}
    for level in (*reversed(STEMS), WORD):
        own = evident.filter(pc.equal(evident["level"], level))
        found[level] = pa.concat_arrays(own["key"].chunks or [pa.array([], pa.binary())]), own["c0"].to_numpy(), own["c1"].to_numpy()
    return found


def _places(words: pa.Array, levels: dict[int, tuple], which: Sequence[int]) -> list[tuple[int, np.ndarray]]:
    """For each of these levels, where each word or its first bytes stand among its expressions; -1: nowhere."""
    return [(n, pc.index_in(pc.binary_slice(words, 0, n) if n else words, value_set=levels[n][0]).fill_null(-1).to_numpy()) for n in which]


def _backoff(places: list[tuple[int, np.ndarray]], mass: dict[int, tuple], n: int, total: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both classes' probabilities in the first of the levels that holds a word, and of how large a count."""
    p0, p1, both = np.ones(n), np.ones(n), np.full(n, float(total[WORD][0] + total[WORD][1]))
    left = np.arange(n)
    for level, at in places:
        some, q0, q1, q = mass[level]
        at = at[left]
        met = at >= 0
        met[met] = some[at[met]]
        i, at = left[met], at[met]
        p0[i], p1[i], both[i] = q0[at], q1[at], q[at]
        left = left[~met]
    return p0, p1, both


def _ratios(levels: dict[int, tuple], below: dict[int, list], total: dict, which: int) -> tuple[dict[int, tuple[pa.Array, np.ndarray]], dict[int, tuple]]:
    """The ratios under one discount, level by level from the shortest stem up to the word; the probabilities."""
    d = DISCOUNTS[which]
    n0, n1 = map(float, total[WORD][:2])
    mass: dict[int, tuple] = {}
    ratios: dict[int, tuple[pa.Array, np.ndarray]] = {}
    for level, (keys, c0, c1) in levels.items():
        share = total[level][2 + which] if level in total else 1.0
        p0, p1, both = _backoff(below[level], mass, len(keys), total)
        part = share * (c0 + c1) / both
        p0 = (1 - share) * np.maximum(c0 - d, 0.0) / n0 + part * p0
        p1 = (1 - share) * np.maximum(c1 - d, 0.0) / n1 + part * p1
        some = np.maximum(c0, c1) > d
        mass[level] = some, p0, p1, (c0 + c1).astype(np.float64)
        ratios[level] = keys.filter(pa.array(some)), np.array([math.log(x) for x in p1[some] / p0[some]], dtype=np.float64)
    return ratios, mass


def _after(after: pa.Table, of_word: np.ndarray, places: list[tuple[int, np.ndarray]], mass: dict, total: dict, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of pairs of words, in order, and the ratio of the second word after the first."""
    d = DISCOUNTS[which]
    q0, q1, q = _backoff(places, mass, len(places[0][1]), total)
    hashes, known = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for a in range(0, len(after), BLOCK):
        block, word = after.slice(a, BLOCK), of_word[a : a + BLOCK]
        c0, c1, v0, v1, both, share = (block[c].to_numpy().astype(np.float64) for c in ("c0", "c1", "v0", "v1", "both", f"s{which}"))
        part = share * np.minimum(both / q[word], 1.0)
        p0 = (1 - share) * np.maximum(c0 - d, 0) / np.maximum(v0, 1) + part * q0[word]
        p1 = (1 - share) * np.maximum(c1 - d, 0) / np.maximum(v1, 1) + part * q1[word]
        some = np.flatnonzero((np.maximum(c0, c1) > d) & (p0 > 0) & (p1 > 0))
        hashes.append(block["h"].to_numpy()[some])
        known.append(np.log(p1[some] / p0[some]).astype(np.float32))
    h = np.concatenate(hashes)
    order = np.argsort(h)
    return h[order], np.concatenate(known)[order]


def features(ratio: _Ratio, text: bytes | None) -> tuple[float, float]:
    """Length-normalised log-likelihood ratio of the whole text, and of its most toxic passage."""
    w = plain_words(text)
    if not w:
        return 0.0, 0.0
    r = np.fromiter(map(ratio.__getitem__, w), np.float64, len(w))
    held, known = ratio.pairs
    if len(held):
        h = ratio.hashes.of([b"", *w])
        pair = _pair(h[:-1], h[1:])
        at = np.minimum(np.searchsorted(held, pair), len(held) - 1)
        r = np.where(held[at] == pair, known[at], r)
    size = min(WINDOW, len(r))
    sums = np.concatenate([[0.0], np.cumsum(r)])
    return float(r.mean()), float((sums[size:] - sums[:-size]).max() / size)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``score``, 0 to 1, the higher the likelier toxic; whole texts of any length.

    A null or empty text, or one of unknown words only, has equal likelihoods and gets the score of that. A
    model without examples of both classes scores 0. Rows stay as they are, repeated ones too.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.expressions, model.pairs, model.weights))

    def make():
        expressions, pairs, weights = sent.value
        table = _Ratio(_tables(expressions), pairs, Hashes())

        def compute(texts):
            if weights is None:
                return ([0.0] * len(texts),)
            a, b, c = weights
            return (probability(np.array([a * x + b * y + c for x, y in (features(table, t) for t in texts)])),)

        return compute

    return from_texts(docs, "score double", make, text=text, keep=keep)
