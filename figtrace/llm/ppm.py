"""Language-model scores by prediction by partial matching over bytes, and by word counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrace.llm.texts import LOWER, from_texts, give_back, release, slices, staged, words
from figtrace.llm.word_counts import Hashes, add_up, word_counts

ORDER = 5
# Bytes of text that a task takes at a time, as each becomes several numbers; grams that it holds while it counts.
SLICE = 1 << 20
HELD = 2_000_000
# What a symbol costs after the ORDER before it is sent to all tasks for the most frequent cases, no more than
# this many. The others are joined.
CONTEXTS = 1 << 22
# A word's count is sent to all tasks when it is at least one in so many of all tokens; no more than this
# many words can be. The others are joined.
COMMON = 1 << 20
EDGE = 256  # stands before and after every text
SYMBOLS = 257
_BITS = 9


def _flat(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER edges and before one, and where each text's first symbol is."""
    starts, parts, at = [], [], 0
    edge = np.full(ORDER, EDGE, dtype=np.int64)
    for t in texts:
        body = np.frombuffer((t or b"").translate(LOWER), dtype=np.uint8).astype(np.int64)
        parts += [edge, body, edge[:1]]
        starts.append(at + ORDER)
        at += ORDER + len(body) + 1
    return (np.concatenate(parts) if parts else edge[:0]), np.array(starts, dtype=np.int64)


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Every predicted symbol (all but the edges before the texts) with the ``ORDER`` before it, as one number,
    and where each text's first one is."""
    flat, starts = _flat(texts)
    code = np.zeros(len(flat), dtype=np.int64)
    mask = np.ones(len(flat), dtype=bool)
    for k in range(ORDER + 1):
        code[k:] |= flat[: len(flat) - k] << (_BITS * k)
        if k:
            mask[starts - k] = False
    return code[mask], starts - ORDER * np.arange(1, len(starts) + 1)


def byte_counts(docs: DataFrame, training: Column, *, text: str = "text") -> DataFrame:
    """How often each symbol follows each ``ORDER`` symbols: gram, n in all texts, t in those to learn from."""

    source = docs.select(F.col(text).cast("binary").alias("_text"), F.coalesce(training, F.lit(False)).alias("_learn"))
    return source.mapInArrow(_counted, "gram long, n long, t long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of texts (text, whether to learn from it) with their counts; a gram can come again where a task has more than it holds."""
    held: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}

    def given() -> Iterator[pa.RecordBatch]:
        for learn in (True, False):
            if not held[learn][0]:
                continue
            grams, n = add_up(*held[learn])
            held[learn] = ([], [])
            for a in range(0, len(grams), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[part]), pa.array(n[part]), pa.array(n[part] if learn else np.zeros_like(n[part]))], ["gram", "n", "t"]
                )

    size = 0
    for b in slices(batches, 0, SLICE):
        texts, learned = b.column(0).to_pylist(), b.column(1).to_pylist()
        for learn in (True, False):
            some = [t for t, y in zip(texts, learned) if y == learn]
            if some:
                grams, n = np.unique(_grams(some)[0], return_counts=True)
                held[learn][0].append(grams)
                held[learn][1].append(n)
                size += len(grams)
        if size > HELD:
            size = 0
            for learn, (grams, n) in held.items():
                if grams:
                    k, m = add_up(grams, n)
                    held[learn] = ([k], [m])
                    size += len(k)
            if size > HELD // 2:
                yield from given()
                size = 0
    yield from given()
    give_back(collect=False)


def _last(gram: Column, symbols: int) -> Column:
    return gram.bitwiseAND((1 << _BITS * symbols) - 1)


def costs(grams: DataFrame) -> DataFrame:
    """gram, n and the cost (log10 probability) of the gram's last symbol after the others, for all of ``byte_counts``.

    Escapes by method C (as many as distinct symbols seen), and symbols seen in a longer context are excluded
    from the shorter ones. Every context that the texts to learn from have counts, however rare. Without any
    text all symbols are alike.
    """
    learned = [grams.where("t > 0").select(F.col("gram").alias("g"), F.col("t").alias("c"))]
    for k in range(ORDER, 0, -1):
        learned.insert(0, staged(learned[0].groupBy(_last(F.col("g"), k).alias("g")).agg(F.sum("c").alias("c")), f"grams{k}"))
    # Of every context: its symbols' number and counts, and their counts in the context one shorter.
    contexts: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        shorter = learned[k - 1].select(F.col("g").alias("_g"), F.col("c").alias("_c"))
        both = learned[k].join(shorter, _last(F.col("g"), k) == F.col("_g"))
        sums = both.groupBy(F.shiftright("g", _BITS).alias("h")).agg(F.sum("c").alias("m"), F.count("c").alias("q"), F.sum("_c").alias("a"))
        contexts.append(staged(sums, f"contexts{k}"))
    m0, q0 = learned[0].agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()

    longest = contexts[-1].select("h", (F.col("m") + F.col("q")).alias("room"))
    seen = grams.where("t > 0").join(longest, F.shiftright("gram", _BITS) == F.col("h")).select("gram", "n", F.log10(F.col("t") / F.col("room")).alias("cost"))

    rest = grams.where("t = 0").select(
        "gram", "n", F.lit(None).cast("double").alias("cost"), F.lit(0.0).alias("escape"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("q")
    )
    for k in range(ORDER, -1, -1):
        small = k < 2  # at most SYMBOLS**2 rows
        if k:
            of = contexts[k - 1].select("h", F.col("m").alias("_m"), F.col("q").alias("_q"), F.col("a").alias("_a"))
            rest = rest.join(F.broadcast(of) if k < 3 else of, _last(F.shiftright("gram", _BITS), k) == F.col("h"), "left").drop("h")
        else:
            rest = rest.withColumns({"_m": F.lit(m0), "_q": F.lit(q0), "_a": F.lit(0)})
        if k < ORDER:
            of = learned[k].select("g", F.col("c").alias("_c"))
            rest = rest.join(F.broadcast(of) if small else of, _last(F.col("gram"), k + 1) == F.col("g"), "left").drop("g")
        else:
            rest = rest.withColumn("_c", F.lit(None).cast("long"))
        m, q, a = (F.coalesce(c, F.lit(0)).cast("long") for c in ("_m", "_q", "_a"))
        left, symbols = m - F.col("a"), q - F.col("q")
        some = (m > 0) & (left > 0)
        rest = rest.select(
            "gram", "n", F.coalesce("cost", F.when(some, F.col("escape") + F.log10(F.col("_c") / (left + symbols)))).alias("cost"),
            (F.col("escape") + F.when(some, F.log10(symbols / (left + symbols))).otherwise(0.0)).alias("escape"), a.alias("a"), q.alias("q"),
        )
    unseen = rest.select("gram", "n", F.coalesce("cost", F.col("escape") - math.log10(SYMBOLS - q0)).alias("cost"))
    out = staged(seen.union(unseen).withColumn("cost", F.col("cost").cast("float")), "costs")
    release(*learned, *contexts)
    return out


def _bar(priced: DataFrame) -> tuple[float, bool]:
    """From which eighth of a power of two on a gram is frequent: at most CONTEXTS are. And whether others are not."""
    bar, n = float("inf"), 0
    for r in priced.groupBy(_rung(F.col("n")).alias("r")).count().orderBy(F.desc("r")).collect():
        n += r["count"]
        if n > CONTEXTS:
            return bar, True
        bar = r["r"]
    return bar, False


def _rung(n: Column) -> Column:
    return F.floor(F.log2(n) * 8).cast("double")


def _priced(texts: list[bytes | None], held: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, list, list]:
    """log10 probability of each text, its end included, without the grams that are not held; those, and how often."""
    code, starts = _grams(texts)
    grams, of = np.unique(code, return_inverse=True)
    at = np.minimum(np.searchsorted(held, grams), max(len(held) - 1, 0))
    met = held[at] == grams if len(held) else np.zeros(len(grams), dtype=bool)
    each = np.zeros(len(grams))
    each[met] = cost[at[met]]
    other, times = [np.zeros(0, dtype=np.int64)] * len(texts), [np.zeros(0, dtype=np.int64)] * len(texts)
    if not met.all():
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(code)])):
            part = of[a:b]
            other[i], times[i] = np.unique(code[a:b][~met[part]], return_counts=True)
    return np.add.reduceat(each[of], starts), other, times


def score(docs: DataFrame, training: Column, *, text: str = "text", keep: list[str]) -> DataFrame:
    """The kept columns of ``docs`` with n_tokens, n_known, train_tokens, base_score and score.

    Both models learn from the rows where ``training`` holds, whole texts. Words are lower-cased; a text's
    tokens are its words and one end. ``base_score`` is the sum of log10((c + 1) / (N + V + 1)), ``score`` the
    byte model's log10 probability of the lower-cased text with its end. A null text is empty. Rows stay as
    they are, repeated ones too; columns called like the new ones are replaced. Without training rows every count is 0 and all bytes are alike.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    learned = docs.where(training)
    grams = staged(byte_counts(docs, training, text=text), "grams")
    counted = staged(word_counts(learned, split=words, text=text), "word_counts")
    priced = costs(grams)
    release(grams)
    bar, more = _bar(priced)
    model = priced.where(_rung(F.col("n")) >= bar).select("gram", "cost").orderBy("gram").toArrow()  # at most CONTEXTS rows
    n_texts = learned.count()
    n_words, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("h")).first()
    total, room = n_words + n_texts, n_words + n_texts + distinct + (n_texts > 0) + 1
    common = counted.where(F.col("n") * COMMON >= n_words).toPandas().sort_values("h")  # at most COMMON rows
    sent = spark.sparkContext.broadcast((model["gram"].to_numpy(), model["cost"].to_numpy(), common["h"].to_numpy(), common["n"].to_numpy()))

    def make():
        grams_held, cost, held, n_held = sent.value
        hashes = Hashes()
        logs = np.log10((n_held + 1) / room)
        end = np.log10((n_texts + 1) / room)

        def compute(texts):
            n_tokens, known, base, rare, rare_n = [], [], [], [], []
            for t in texts:
                h = hashes.of(words(t))
                at = np.minimum(np.searchsorted(held, h), max(len(held) - 1, 0))
                met = held[at] == h if len(held) else np.zeros(len(h), dtype=bool)
                n_tokens.append(len(h) + 1)
                known.append(int(met.sum()) + (n_texts > 0))
                base.append(float(logs[at[met]].sum() + end) if len(held) else float(end))
                other, n = np.unique(h[~met], return_counts=True)
                rare.append(other)
                rare_n.append(n)
            return n_tokens, known, base, *_priced(texts, grams_held, cost), rare, rare_n

        return compute

    fields = "_n_tokens long, _known long, _base double, _score double, _grams array<long>, _grams_n array<long>, _rare array<long>, _rare_n array<long>"
    numbered = docs.select(*keep, F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    first = staged(from_texts(numbered, fields, make, text="_text", keep=[*keep, "_row"], size=SLICE), "scored")

    rest = first.select("_row", F.explode(F.arrays_zip("_rare", "_rare_n")).alias("_z")).select(
        "_row", F.col("_z._rare").alias("h"), F.col("_z._rare_n").alias("_times")
    )
    counts = counted.where(F.col("n") * COMMON < n_words)
    c = F.coalesce(F.col("n"), F.lit(0))
    of_row = rest.join(counts, "h", "left").groupBy(F.col("_row").alias("_r")).agg(
        F.sum(F.when(c > 0, F.col("_times")).otherwise(0)).alias("_k"), F.sum(F.col("_times") * F.log10((c + 1) / F.lit(float(room)))).alias("_b")
    )
    scored = first.join(of_row, F.col("_row") == F.col("_r"), "left")
    by_grams = F.lit(0.0)
    if more:
        asked = first.select(F.col("_row").alias("_g"), F.explode(F.arrays_zip("_grams", "_grams_n")).alias("_z")).select(
            "_g", F.col("_z._grams").alias("gram"), F.col("_z._grams_n").alias("_times")
        )
        of_grams = asked.join(priced.where(_rung(F.col("n")) < bar), "gram").groupBy("_g").agg(F.sum(F.col("_times") * F.col("cost")).alias("_s"))
        scored = scored.join(of_grams, F.col("_row") == F.col("_g"), "left")
        by_grams = F.coalesce("_s", F.lit(0.0))
    return scored.select(
        *keep,
        F.col("_n_tokens").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_b", F.lit(0.0))).alias("base_score"),
        (F.col("_score") + by_grams).alias("score"),
    )
