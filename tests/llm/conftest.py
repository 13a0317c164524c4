from __future__ import annotations

import re

import pytest

SF = "/root/testdata/sf0.001"
VOCABULARY = "byte_bpe_50k.json"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, kept string, n_tokens string, row string"
EXTRA = ("xx", "s1", 3, "a score", "a span", "kept?", "tokens?", "a row")
SAID = "The quick brown fox jumps over the lazy dog while eleven more words follow it home today"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns called like new ones."""
    texts = [
        (1, SAID), (2, SAID + " again"), (3, None), (4, ""), (5, " \t\n"), (6, "word"), (6, "word"), (None, SAID),
        (None, "quite another text of some length here"), (7, "Ünï cödé 中文 　 tail  "), (8, "ab cd " * 12_000),
        (9, "mail a.b@mail.example.com now or call +44 20 7946 0958, host 10.0.0.1 card 4111 1111 1111 1111"),
    ]
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in texts], FIELDS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
