"""Token counts, packing and language-model scores against the library and brute force."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from figtrace.llm import packing, ppm, token_count
from figtrace.llm.chunks import Merges
from figtrace.llm.queries import QUERIES
from tests.llm.conftest import SF, rows, spaced


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_merging_equals_the_library(library, vocabulary):
    draw = random.Random(5)
    pieces = ["".join(draw.choices(["a", "th", "e", "é", "Ġ", "中", "aaa", "1"], k=draw.randint(1, 20))) for _ in range(300)]
    merges = Merges(vocabulary)
    ids, sizes = merges.encode([p.encode() for p in pieces])
    from figtrace.llm.chunks import byte_letters

    letters = byte_letters()
    want = [[t.id for t in library.model.tokenize("".join(letters[b] for b in p.encode()))] for p in pieces]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_counts_of_odd_texts(spark, vocabulary, library):
    draw = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "é", "<|endoftext|>", "　", "\x85", "\x1c", "'s", "9", "²", "!", "😀", "\t", "中文", "'"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 25))) for _ in range(500)] + ["", " ", "a ", " a", "\n", "a" * 3000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_count.count_tokens(df, vocabulary).collect():
        assert r["n_tokens"] == len(ids_of(library, texts[r["doc_id"]])), repr(texts[r["doc_id"]])
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())


def test_count_query(spark, texts, library):
    got = {r["doc_id"]: r for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n = len(ids_of(library, t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 1024)


def test_counts_keep_rows_and_clashing_columns(odd, none, vocabulary):
    got = token_count.count_tokens(odd, vocabulary)
    assert got.count() == odd.count() and got.columns == [c for c in odd.columns if c != "n_tokens"] + ["n_bytes", "n_tokens"]
    assert {r["n_tokens"] for r in got.where("text IS NULL OR text = ''").collect()} == {0}
    assert token_count.count_tokens(none, vocabulary).count() == 0


def plainly_packed(lengths, size):
    """Best-fit decreasing, piece by piece."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(size - n)
    return sorted(room)


def test_plan_is_best_fit_decreasing():
    draw = random.Random(1)
    for _ in range(60):
        size = draw.choice([10, 37, 64])
        lengths = [draw.randint(1, size) for _ in range(draw.randint(0, 120))]
        room = Counter()
        for length, first, sequence, each, _ in packing.best_fit_plan(dict(Counter(lengths)), size).tolist():
            ranks = [r for r in range(first, Counter(lengths)[length])]
            later = [p[1] for p in packing.best_fit_plan(dict(Counter(lengths)), size).tolist() if p[0] == length and p[1] > first]
            for r in ranks[: (min(later) - first) if later else None]:
                room[sequence + (r - first) // each] += length
        assert sorted(size - n for n in room.values()) == plainly_packed(lengths, size)


def check_packed(packed, texts_of, library, size):
    by_sequence = {}
    by_doc = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    for i, t in texts_of.items():
        ids = np.array([*ids_of(library, t), 2], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == size)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return by_sequence


def test_packing_query(spark, texts, library):
    packed = rows(QUERIES["op8_packing"](spark, SF))
    sequences = check_packed(packed, texts, library, 1024)
    assert sorted(1024 - sum(n for _, n in s) for s in sequences.values()) == plainly_packed([r["length"] for r in packed], 1024)


def test_packing_of_odd_texts(odd, none, vocabulary, library):
    pieces = packing.token_pieces(odd, vocabulary, size=64, end=2, keep=["doc_id", "row"])
    packed = rows(packing.best_fit(pieces.withColumn("ids_crc32", F.crc32("ids")), size=64, order=["doc_id", "piece"]))
    empty = [r for r in packed if r["doc_id"] in (3, 4)]
    assert [r["length"] for r in empty] == [1, 1] and len([r for r in packed if r["doc_id"] == 6]) == 2
    once = [r for r in packed if r["doc_id"] not in (6, None)]
    held = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] not in (6, None)}
    for i, t in held.items():
        assert sum(r["length"] for r in once if r["doc_id"] == i) == len(ids_of(library, t)) + 1
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(a + n == b for s in sequences.values() for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:]))
    assert packing.best_fit(packing.token_pieces(none, vocabulary, size=64, end=2), size=64, order=["doc_id"]).count() == 0


def test_score_query(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op9_lm_score"](spark, SF).collect()}
    tokens = {i: [*spaced(t), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(t in counts for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)


def plain_ppm(training, text):
    """Escapes by method C with exclusion, over the contexts that are frequent enough."""
    order, edge = ppm.ORDER, ppm.EDGE
    seen = [Counter() for _ in range(order + 1)]
    total = 0
    for t in training:
        s = [edge] * order + list(t.lower().encode()) + [edge]
        for i in range(order, len(s)):
            total += 1
            for k in range(order + 1):
                seen[k][tuple(s[i - k : i]), s[i]] += 1
    of = [{} for _ in range(order + 1)]
    for k in range(order + 1):
        for (c, x), n in seen[k].items():
            of[k].setdefault(c, {})[x] = n
    out = 0.0
    s = [edge] * order + list(text.lower().encode()) + [edge]
    for i in range(order, len(s)):
        escape, excluded, p = 1.0, set(), None
        for k in range(order, -1, -1):
            held = of[k].get(tuple(s[i - k : i]), {})
            if sum(held.values()) * ppm.CONTEXTS < total and k:
                continue
            left = {x: n for x, n in held.items() if x not in excluded}
            if not left:
                continue
            room = sum(left.values()) + len(left)
            if s[i] in left:
                p = escape * left[s[i]] / room
                break
            escape *= len(left) / room
            excluded |= left.keys()
        out += math.log10(p if p else escape / (ppm.SYMBOLS - len(excluded)))
    return out


def test_byte_model_is_ppm(spark):
    training = ["banana bandana", "an apple and a band", "", "annabel"]
    probes = ["banana", "zebra", "", "an\x00", "bandé"]
    df = spark.createDataFrame([(t, True) for t in training] + [(t, False) for t in probes], "text string, learn boolean")
    got = {r["text"]: r["score"] for r in ppm.score(df, F.col("learn"), keep=["text", "learn"]).where("NOT learn").collect()}
    for t in probes:
        assert got[t] == pytest.approx(plain_ppm(training, t), rel=1e-4), t


@pytest.mark.parametrize("sent", [0, 3, 20])
def test_rare_contexts_count(spark, monkeypatch, sent):
    """What is not sent to all tasks is joined: no context is dropped, and unrelated data change nothing."""
    training = ["banana bandana", "an apple and a band", "", "annabel"] + ["0123456789" * 40] * 3
    probes = ["banana", "zebra", "", "an\x00", "bandé", "0123 and"]
    want = {t: plain_ppm(training, t) for t in probes + training}
    monkeypatch.setattr(ppm, "CONTEXTS", sent)
    df = spark.createDataFrame([(t, True) for t in training] + [(t, False) for t in probes], "text string, learn boolean")
    got = ppm.score(df, F.col("learn"), keep=["text"]).collect()
    assert len(got) == len(df.collect())
    for r in got:
        assert r["score"] == pytest.approx(want[r["text"]], rel=1e-4), r["text"]


def test_counting_bytes_takes_bounded_memory(monkeypatch):
    """A task counts 16 MB of random text, nearly all of whose grams are distinct: it held them all, in slices of 4 MB."""
    monkeypatch.setattr(ppm, "HELD", 400_000)
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes() for _ in range(800)]
    batches = (pa.RecordBatch.from_arrays([pa.array(texts[a : a + 100], pa.binary()), pa.array([i % 3 > 0 for i in range(a, a + 100)])], ["_text", "_learn"]) for a in range(0, 800, 100))
    symbols, learned = 0, 0
    tracemalloc.start()
    for b in ppm._counted(batches):
        symbols += sum(b.column(1).to_pylist())
        learned += sum(b.column(2).to_pylist())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (symbols, learned) == (800 * 20_001, sum(i % 3 > 0 for i in range(800)) * 20_001)
    assert most < 100 << 20


def test_counts_given_in_parts_add_up(monkeypatch):
    texts = [None, b"", b"Aa bb", "ünï 中文".encode(), b"ab" * 300, b"Aa bb"]

    def counted():
        found = Counter()
        for b in ppm._counted(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([True, False, False, True, True, True])], ["_text", "_learn"])])):
            for gram, n, t in zip(*[c.to_pylist() for c in b.columns]):
                found[gram, "n"] += n
                found[gram, "t"] += t
        return found

    whole = counted()
    assert sum(n for (_, kind), n in whole.items() if kind == "n") == sum(len(t or b"") + 1 for t in texts)
    monkeypatch.setattr(ppm, "SLICE", 5)
    monkeypatch.setattr(ppm, "HELD", 8)
    assert counted() == whole


def test_score_of_odd_texts(odd, none):
    got = rows(ppm.score(odd, F.col("doc_id") > 0, keep=["doc_id", "score"]))
    assert len(got) == odd.count() and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (3, 4, 5))
    assert ppm.score(none, F.lit(True), keep=["doc_id"]).count() == 0
    untrained = rows(ppm.score(odd, F.lit(False), keep=["doc_id"]))
    assert {r["n_known"] for r in untrained} == {0} and {r["base_score"] for r in untrained} == {0.0}


@pytest.mark.parametrize("specials", [True, False])
def test_whole_texts_are_encoded_as_by_the_library(vocabulary, specials):
    from tokenizers import Tokenizer

    from figtrace.llm import bpe

    model = Tokenizer.from_file(vocabulary)
    model.encode_special_tokens = not specials
    encode, draw = bpe.encoder(vocabulary, specials=specials), random.Random(6)
    odd = [*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), *range(0x3000, 0x3010), *range(0x1F600, 0x1F640)]
    pieces = ["<|endoftext|>", "'s", "'LL", "  ", "\r\n", " \t", "word", "WORD9", "!!", *map(chr, odd)]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(5_000)] + ["a" * 100_000, " " * 50_000, "7\n" * 30_000, "<|endoftext" * 5]
    for t in texts:
        assert encode(t).tolist() == model.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_other_vocabularies_are_left_to_the_library(vocabulary, tmp_path):
    """A file whose ids don't follow its merges."""
    import json

    from tokenizers import Tokenizer

    from figtrace.llm import bpe

    with open(vocabulary, encoding="utf-8") as f:
        held = json.load(f)
    held["model"]["merges"][:200] = held["model"]["merges"][199::-1]
    path = str(tmp_path / "v.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(held, f)
    text = "The other thing is that this was there"
    assert bpe.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_texts_with_double_spaces_are_remembered_within_bounds(library, vocabulary):
    """What is held grows with the distinct chunks, not with the texts, and starts anew beyond the limit."""
    from figtrace.llm.chunks import Chunks, pretokens

    draw = random.Random(8)
    words = [f"w{i:x}" for i in range(2_000)]
    chunks = Chunks({}, limit=5_000)
    for _ in range(6):
        texts = []
        for _ in range(200):
            said = draw.choices(words, k=200)
            texts.append(" ".join(said[:100]) + "  " + " ".join(said[100:]))
        _, numbers, _ = chunks.batch([t.encode() for t in texts])
        assert len(chunks.parts) <= 4 * (5_000 + 2_200) and len(chunks._number) <= 5_000 + 2_200
    names = list(chunks._pretoken)
    ends = np.r_[0, np.cumsum(chunks.sizes)]
    got = [names[p] for n in numbers[0] for p in chunks.parts[ends[n] : ends[n + 1]]]
    from figtrace.llm.chunks import _SPLIT

    assert got == pretokens(texts[0], {}, _SPLIT, None)
