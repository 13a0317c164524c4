"""Personal data: patterns, and words that disclose what the patterns found, by information theory."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrace.llm.texts import LOWER, bit_table, from_texts, plain_words, release, staged
from figtrace.llm.word_counts import Hashes

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
# What an address may have before its @ and after it, and numbers joined by points; then cards and phones.
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
PATTERNS = (re.compile(r"[0-9](?:[\x20-]?[0-9])++"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))
SMOOTH = 2  # texts without any evidence that every word is given when what it discloses is estimated
LEAST = 0.5  # part of a word's texts, these included, that must have the entity
BITS = 1 << 24  # of the table that drops most of the words that disclose nothing before the join
GENERALISE, REMOVE = 0.9, 0.98  # parts of the entity's information that a word may disclose

_PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # words before they are lower-cased
_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _valid(kind: int, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @, the run of characters to its left that an address may have, and the domain to its right."""
    end = before = 0
    at = text.find("@")
    while at >= 0:
        left = text[max(end, before) : at]
        start = at - len(left) + len(left.rstrip(_LOCAL))
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        before = at + 1
        at = text.find("@", max(before, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Of each run of numbers joined by points, four after four."""
    for run in _NUMBERS.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            short = [p.lstrip("0") for p in four]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in short):
                yield at, at + size
            at += size + 1


def entities(text: bytes | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start: leftmost matches that don't overlap, of each
    kind for itself; those that fail its condition are dropped. The time is in proportion to the text."""
    if not text:
        return []
    digits = text.translate(None, _NOT_DIGITS)
    kinds = [k for k, there in enumerate((b"@" in text, len(digits) >= 4, len(digits) >= 13, b"+" in text and len(digits) >= 9)) if there]
    if not kinds:
        return []
    whole = text.decode("utf-8")
    found = []
    for k in kinds:
        if k < 2:
            found += [(k, a, b) for a, b in (_emails, _ips)[k](whole)]
        else:
            found += [(k, m.start(), m.end()) for m in PATTERNS[k - 2].finditer(whole) if _valid(k, m.group())]
    return found


def _key(*parts: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest("\0".join(parts).encode()), "little", signed=True)


def others(text: str, found: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the words of the whole text that overlap no entity."""
    spans = sorted((s, e) for _, s, e in found)
    i = end = 0
    for m in _PLAIN.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            end = max(end, spans[i][1])
            i += 1
        if end <= m.start():
            yield m.span()


def _word_hash(word: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(word.translate(LOWER)), "little", signed=True)


def find(docs: DataFrame, *, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, removed) in code points, kinds numbered as ``KINDS``.

    Pattern spans always stay. A word is a span of kind term, wherever it stands in any text, when it discloses
    an entity: the corpus tells in how many distinct texts it occurs with the entity, c(e, t), and at all, c(t). With
    c(e, t) / c(t) smoothed by ``SMOOTH`` texts in which e is as likely as anywhere, p(e), PMI =
    log(c(e, t) / c(t) / p(e)) over the entity's information log(1 / p(e)) is the part disclosed; from
    ``GENERALISE`` on the word is to be generalised, from ``REMOVE`` on to be removed (``removed``). Besides, c(e, t)
    must be ``LEAST`` of c(t) + ``SMOOTH``, so that one text alone, or copies of one, disclose nothing however large
    the corpus is. A null or empty text has no spans. Rows stay as they are, repeated ones too.
    """
    keep = docs.columns if keep is None else list(keep)
    telling = staged(_telling(docs, text), "telling")
    sent = docs.sparkSession.sparkContext.broadcast(_bits(telling))

    def make():
        bits, hashes = sent.value, Hashes()

        def compute(texts):
            spans, near = [], []
            for t in texts:
                found = entities(t)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                h = hashes.of(plain_words(t))
                some = set(h[bits[h & (BITS - 1)]].tolist())
                near.append([])
                if some:
                    whole = t.decode("utf-8")
                    for a, b in others(whole, found):
                        term = hashes[whole[a:b].encode().translate(LOWER)]
                        if term in some:
                            near[-1].append({"start": a, "end": b, "term": term})
            return spans, near

        return compute

    carried = [c for c in keep if c != "spans"]
    numbered = docs.select(F.struct(*carried).alias("carried"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("row"))
    fields = "base array<struct<kind: int, start: long, end: long>>, near array<struct<start: long, end: long, term: long>>"
    held = staged(from_texts(numbered, fields, make, text="_text", keep=["carried", "row"]), "entities")
    said = held.select("row", F.explode("near").alias("c")).select(F.col("row").alias("_row"), "c.*")
    terms = said.join(telling, "term").groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct(F.lit(TERM).alias("kind"), "start", "end", (F.col("part") >= REMOVE).alias("removed")))).alias("terms")
    )
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("removed")))
    spans = F.concat(base, F.coalesce("terms", F.array().cast("array<struct<kind: int, start: long, end: long, removed: boolean>>")))
    return held.join(terms, F.col("row") == F.col("_row"), "left").select(
        *[F.col("carried").getField(c).alias(c) for c in carried], spans.alias("spans")
    )


def _telling(docs: DataFrame, text: str) -> DataFrame:
    """Words that disclose an entity, by hash, and the largest part of one that each discloses: term, part.

    All counts are of distinct texts. Words are first counted in the texts with entities alone: what is then still
    bound to one entity is counted in all texts.
    """

    def make():
        def compute(texts):
            met, terms, said = [], [], []
            for t in texts:
                found = entities(t)
                whole = t.decode("utf-8") if found else ""
                met.append(list({_key(KINDS[k], whole[a:b].lower()) for k, a, b in found}))
                words = {whole[a:b] for a, b in others(whole, found)} if found else set()
                terms.append(list({_word_hash(w.encode()) for w in words}))
                said.append(_text_hash(t))
            return met, terms, said

        return compute

    found = from_texts(docs.select(F.col(text).alias("_text")), "met array<long>, terms array<long>, said long", make, text="_text", keep=[])
    found = staged(found.where(F.size("met") > 0).dropDuplicates(["said"]), "disclosing")
    in_text = found.select("said", F.explode("met").alias("entity"))
    # What one text alone says of an entity tells nothing of its words.
    often = in_text.groupBy("entity").agg(F.count(F.lit(1)).alias("_e")).where("_e > 1")
    of_text = in_text.join(often, "entity").select(F.col("said").alias("_said"), "entity", "_e")
    words = found.select("said", F.explode("terms").alias("term"))
    seen = words.groupBy("term").agg(F.count(F.lit(1)).alias("_t")).where("_t > 1")
    # A word met in more texts than it may be, if each of the entity's texts had it, makes no pair.
    pairs = words.join(seen, "term").join(of_text, (F.col("said") == F.col("_said")) & _bound(F.least("_e", "_t"), F.col("_t")))
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("_et"), F.any_value("_e").alias("_e"), F.any_value("_t").alias("_t"))
    likely = staged(together.where(_bound(F.col("_et"), F.col("_t"))).select("entity", "term", "_et", "_e"), "likely")
    release(found)

    counted = _texts_of(docs, text, likely)
    total = (counted.where("term IS NULL").select("n").first() or [0])[0]
    p = F.col("_e") / F.lit(float(total + 1))
    part = 1 + F.log((F.col("_et") + SMOOTH * p) / (F.col("n") + SMOOTH)) / F.log(1 / p)
    parts = likely.join(counted.withColumnRenamed("term", "_term"), F.col("term") == F.col("_term"))
    parts = parts.where(_bound(F.col("_et"), F.col("n"))).select("term", part.alias("part")).where(F.col("part") >= GENERALISE)
    return parts.groupBy("term").agg(F.max("part").alias("part"))


def _bound(together: Column, texts: Column) -> Column:
    """Whether a word is rather met with the entity than without, given ``SMOOTH`` texts in which it is not."""
    return together >= LEAST * (texts + SMOOTH)


def _texts_of(docs: DataFrame, text: str, likely: DataFrame) -> DataFrame:
    """(term, n): in how many distinct texts the likely terms stand, and, for the term NULL, how many there are."""
    sent = docs.sparkSession.sparkContext.broadcast(_bits(likely.select("term").distinct()))

    def make():
        bits, hashes = sent.value, Hashes()

        def compute(texts):
            said, terms = [], []
            for t in texts:
                h = np.unique(hashes.of(plain_words(t)))
                said.append(_text_hash(t))
                terms.append([None, *h[bits[h & (BITS - 1)]].tolist()])
            return said, terms

        return compute

    met = from_texts(docs.select(F.col(text).alias("_text")), "said long, terms array<long>", make, text="_text", keep=[])
    each = met.select("said", F.explode("terms").alias("term")).distinct()
    return staged(each.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "text_counts")


def _text_hash(text: bytes | None) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text or b""), "little", signed=True)


def _bits(telling: DataFrame) -> np.ndarray:
    """Which last bits of a hash any of the words has."""
    held = bit_table(telling.select(F.col("term").bitwiseAND(BITS - 1).alias("s")), BITS)
    return np.unpackbits(held.view(np.uint8), bitorder="little").view(bool)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def clean(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and the most telling words removed; spans
    that overlap are replaced as one, by the first one's kind. Texts without spans stay to the byte."""
    found = find(docs, text=text)

    def make():
        def compute(texts, spans):
            return ([_replaced(t, s) if s else t for t, s in zip(texts, spans)],)

        return compute

    cleaned = from_texts(found, "_clean binary", make, text=text, also=["spans"], keep=docs.columns)
    return cleaned.select(*[F.col("_clean").cast("string").alias(c) if c == text else c for c in docs.columns])


def _replaced(text: bytes, spans: list[dict]) -> bytes:
    whole, out, at = text.decode("utf-8"), [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if s["start"] >= at:
            out += [whole[at : s["start"]], "" if s["removed"] else f"[{KINDS[s['kind']].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, whole[at:]]).encode()
