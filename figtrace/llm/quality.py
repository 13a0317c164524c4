"""Quality by hierarchical empirical Bayes: a document classifier, hosts and paths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrace.llm.fitting import logistic, probability
from figtrace.llm.texts import from_texts, plain_words, staged
from figtrace.llm.word_counts import Hashes

# Labelled documents the classifier is fitted on at most: those with the least hash of their id.
SAMPLE = 20_000

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_NOT_SYMBOLS = bytes(c for c in range(256) if c in b" \t\n\r.,;:!?'\"()-" or 48 <= c <= 57 or c in _LETTERS or c > 127)
_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
FEATURES = 10
# Words and pairs of words are hashed into so many buckets, whose evidence is smoothed by so many documents of each class.
BUCKETS, SMOOTH = 1 << 18, 2.0
# The evidence of the words in a document that the classifier is fitted on comes from the other folds.
FOLDS = 5


def features(text: bytes | None) -> list[float]:
    """What sets junk apart from prose, as shares and logarithms: symbols, digits, capitals, repetition of
    words and lines, word lengths, size. All zero for a null text or one without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * FEATURES
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x]
    again = sum(a == b for a, b in zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.float64, n)
    return [
        np.log1p(1000 * len(text.translate(None, _NOT_SYMBOLS)) / size),
        np.log1p(1000 * len(text.translate(None, _NOT_DIGITS)) / size),
        np.log1p(1000 * len(text.translate(None, _NOT_UPPER)) / size),
        np.log1p(1000 * again / n),
        len(set(words)) / n ** 0.9,
        len(set(lines)) / len(lines) if lines else 1.0,
        lengths.mean(),
        lengths.std(),
        np.log(n),
        np.log1p(n / len(lines)) if lines else 0.0,
    ]


def buckets(text: bytes | None, hashes: Hashes) -> np.ndarray:
    """Which buckets the words of a text, and its words after the one before, fall into."""
    h = hashes.of(plain_words(text))
    pairs = h[:-1] * np.int64(-7046029254386353131) + (h[1:] ^ (h[1:] >> 29))
    return np.unique(np.concatenate([h, pairs]) & (BUCKETS - 1))


def evidence(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """The log-odds of good over bad of every bucket, by how many documents of each class have it."""
    share = (counts + SMOOTH) / (documents + 2 * SMOOTH)
    return np.log(share[:, 1] / share[:, 0]).astype(np.float32)


def _wide(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -5, 5)
    return np.column_stack([z, z * z])


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    host: Column,
    path: Column,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """The kept columns with classifier, host_rate, path_rate, score (0 to 1, higher: better) and kept.

    ``labels`` has ``doc_id`` and 0 or 1. A logistic regression on whole texts, fitted on a bounded sample of
    them, gives each document's evidence: from its shape, and from the mean and the least log-odds of its words and
    pairs of words. Documents are counted as good by their label, or else by that
    evidence; a host's rate is shrunk towards the global one, a path's towards its host's, by prior weights
    that the spread of rates between hosts, and between paths, tells (method of moments). The score puts the
    document's evidence, against the global rate, on top of its path's rate without the document itself; ``kept``
    from 0.5 on. A missing
    host or path is one of its own, named ''. Without labels, evidence is 0.5 for all. Rows stay as they are,
    repeated ones too; null and empty texts are judged by their lack of words.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("classifier", "host_rate", "path_rate", "score", "kept")]
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    chosen = staged(known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample), "labelled")

    labelled = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    labelled = labelled.select("_y", fold.alias("_fold"), "_text")
    tables = _word_evidence(labelled)
    sent = spark.sparkContext.broadcast(tables)

    def measure():
        hashes, held = Hashes(), sent.value
        return lambda texts, folds: ([[*features(t), *_told(t, held[f], hashes)] for t, f in zip(texts, folds)],)

    rows = from_texts(labelled, "_f array<double>", measure, text="_text", keep=["_y"], also=["_fold"]).collect()
    if rows:
        x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], dtype=float)
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        w = logistic(_wide(x, mean, scale), y, ridge=1.0)
    else:
        mean, scale, w = np.zeros(FEATURES + 2), np.ones(FEATURES + 2), np.zeros(2 * FEATURES + 5)
    sent.destroy()
    whole = spark.sparkContext.broadcast(tables[-1])

    def judge():
        hashes, held = Hashes(), whole.value

        def compute(texts):
            x = np.array([[*features(t), *_told(t, held, hashes)] for t in texts]).reshape(len(texts), -1)
            return (probability(_wide(x, mean, scale) @ w[:-1] + w[-1]),)

        return compute

    blank = F.lit("")
    named = docs.select(
        F.struct(*keep).alias("carried"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text"),
        F.coalesce(host.cast("string"), blank).alias("host"), F.coalesce(path.cast("string"), blank).alias("path"),
    )
    judged = from_texts(named, "classifier double", judge, text="_text", keep=["carried", "_doc", "host", "path"])
    believed = F.coalesce(F.col("_y").cast("double"), F.col("classifier")).alias("_own")
    judged = judged.join(known, F.col("_doc") == F.col("_id"), "left").select("carried", "host", "path", "classifier", believed)
    held = staged(judged, "judged")
    paths = staged(held.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("_own").alias("k")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    n, k, groups, squares = hosts.agg(F.sum("hn"), F.sum("hk"), F.count("hn"), F.sum(F.col("hk") * F.col("hk") / F.col("hn"))).first()
    overall = min(max((k or 0.5) / (n or 1), 1e-6), 1 - 1e-6)
    host_weight = _prior_weight(n or 1, groups, (squares or 0) - (n or 0) * overall**2, overall)
    rated = paths.join(hosts.select("host", "hn", "hk", ((F.col("hk") + host_weight * overall) / (F.col("hn") + host_weight)).alias("host_rate")), "host")
    between = F.col("n") * (F.col("k") / F.col("n") - F.col("hk") / F.col("hn")) ** 2
    count, spread = rated.agg(F.count("n"), F.sum(between)).first()
    path_weight = _prior_weight(n or 1, max(1, count - groups + 1), spread or 0.0, overall)
    path_rate = (F.col("k") + path_weight * F.col("host_rate")) / (F.col("n") + path_weight)
    rates = rated.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate", path_rate.alias("path_rate"), "n", "k", "hn", "hk")
    # What is known of the path and its host apart from the document.
    host_besides = (F.col("hk") - F.col("_own") + host_weight * overall) / (F.col("hn") - 1 + host_weight)
    besides = (F.col("k") - F.col("_own") + path_weight * host_besides) / (F.col("n") - 1 + path_weight)
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    total = logit(F.col("classifier")) + logit(besides) - float(np.log(overall / (1 - overall)))
    joined = held.join(rates, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")))
    scored = joined.withColumn("score", 1 / (1 + F.exp(-total)))
    return scored.select(
        *[F.col("carried").getField(c).alias(c) for c in keep], "classifier", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept")
    )


def _told(text: bytes | None, table: np.ndarray, hashes: Hashes) -> tuple[float, float]:
    """The mean and the least evidence of a text's words; none of a text without words."""
    found = table[buckets(text, hashes)]
    return (float(found.mean()), float(found.min())) if len(found) else (0.0, 0.0)


def _word_evidence(labelled: DataFrame) -> list[np.ndarray]:
    """The evidence of all buckets without each fold, and, last, with all of them. What reaches the driver are counts of
    at most ``BUCKETS`` buckets in each fold."""

    def make():
        hashes = Hashes()
        return lambda texts: ([buckets(t, hashes) for t in texts],)

    met = from_texts(labelled, "_b array<long>", make, text="_text", keep=["_y", "_fold"])
    in_class = [F.count_if(F.col("_y") == c).alias(f"c{c}") for c in (0, 1)]
    counted = met.select("_y", "_fold", F.explode("_b").alias("b")).groupBy("_fold", "b").agg(*in_class).toArrow()
    documents = np.zeros((FOLDS, 2))
    for r in labelled.groupBy("_fold", "_y").count().collect():
        documents[r["_fold"], r["_y"]] = r["count"]
    counts = np.zeros((FOLDS, BUCKETS, 2), dtype=np.float32)
    counts[counted["_fold"].to_numpy(), counted["b"].to_numpy()] = np.column_stack([counted["c0"].to_numpy(), counted["c1"].to_numpy()])
    every, all_documents = counts.sum(0), documents.sum(0)
    return [*(evidence(every - counts[f], all_documents - documents[f]) for f in range(FOLDS)), evidence(every, all_documents)]


def _prior_weight(n: float, groups: int, spread: float, rate: float) -> float:
    """How many documents a group's prior is worth: within-group variance over that between groups, the
    latter by what the groups' rates spread beyond chance."""
    within = rate * (1 - rate)
    beyond = (spread - (groups - 1) * within) / n
    return float(np.clip(within / beyond, 1.0, 1e6)) if beyond > 0 else 1e6
