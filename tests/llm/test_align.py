"""Alignment of two tokenizers against a plain version that encodes whole texts and compares byte ranges."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from figtrace.llm import align
from figtrace.llm.queries import QUERIES
from tests.llm.conftest import SF, rows

COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return [str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def whole(paths):
    """Both sides' (id, start, end) of a whole text, encoded in one piece."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def bytes_of_piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at += len(of(i))
        return out

    def encode(text):
        if not text:
            return [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
        want = (" " + text).encode()
        if b"".join(map(of_a, ids_a)) != want or b"".join(map(bytes_of_piece, ids_b)) != want:
            return [], []
        return spans(ids_a, of_a), spans(ids_b, bytes_of_piece)

    return encode


def plainly(texts, encode):
    """The contract's columns for a list of texts, by comparing every two neighbouring ranges."""
    links, shapes = [], []
    for t in texts:
        a, b = encode(t)
        links.append([(i, k) for i, s, e in a for k, s2, e2 in b if s < e2 and s2 < e] if len(a) < 400 else swept(a, b))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            inside = [",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)]
            groups.append("|".join(inside))
            start = end
        shapes.append((len(a), len(b), len(ends), ";".join(groups)))
    held = Counter(p for found in links for p in set(found))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (*shape[:3], len(found), sum(held[p] == most[p[0]] for p in found), sum(held[p] for p in found), shape[3])
        for shape, found in zip(shapes, links)
    ]


def swept(a, b):
    out, i, k = [], 0, 0
    while i < len(a) and k < len(b):
        out.append((a[i][0], b[k][0]))
        end = min(a[i][2], b[k][2])
        i, k = i + (a[i][2] == end), k + (b[k][2] == end)
    return out


ODD = ["", None, " ", "a ", " a", "  a  b\n c ", "\n", "plain words here", "plain words here", "<|endoftext|> <s> </s> <0x41>", "a▁b",
       "café naïve 中文字 \U0001f600\U0001f468‍\U0001f469 x", "　wide　 space", "tab\tand\r\nlines\x1c end", "'s don't I'll",
       "x" * 3000, "0123456789 " * 50, "\x00nul \x85next"]


def test_against_whole_texts(spark, paths, whole):
    draw = random.Random(7)
    parts = ["the", " ", "  ", "\n", "é", "<|endoftext|>", "　", "tion", "'s", "9", "!", "\U0001f600", "\t", "中文", "<0x41>", "▁"]
    texts = ODD + ["".join(draw.choices(parts, weights=[3] * 15 + [0.1], k=draw.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plainly(texts, whole)
    for common in (align.COMMON, 8, 0):
        got = align.align(df, *paths, common=common)
        assert got.count() == len(texts)
        for r in got.collect():
            assert (*[r[c] for c in COUNTS], r["groups"]) == want[r["doc_id"]], repr(texts[r["doc_id"]])


def test_query(spark, texts, whole):
    got = {r["doc_id"]: r for r in QUERIES["op11_token_alignment"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    chosen = list(texts)
    for i, want in zip(chosen, plainly([texts[i] for i in chosen], whole)):
        r = got[i]
        assert tuple(r[c] for c in COUNTS) == want[:6]
        assert r["groups_sha256"] == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")


def test_keeps_rows_and_clashing_columns(odd, none, paths):
    clash = odd.withColumn("pairs", odd["lang"]).withColumn("n_best", odd["lang"])
    got = align.align(clash, *paths)
    assert got.count() == odd.count() and "pairs" not in got.columns and dict(got.dtypes)["n_best"] == "bigint"
    empty = got.where("text IS NULL OR text = ''").collect()
    assert len(empty) == 2 and all(not any(r[c] for c in (*COUNTS, "groups")) for r in empty)
    twice = rows(got.where("doc_id = 6").drop("_row"))
    assert len(twice) == 2 and twice[0] == twice[1]
    assert align.align(none, *paths).count() == 0
    assert align.align(none.select("text"), *paths, keep=[]).columns == ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def test_bytes_that_are_not_utf8_have_no_tokens(spark, paths):
    df = spark.sql("SELECT 1 AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert [align.align(df, *paths).first()[c] for c in COUNTS] == [0] * 6
