"""Dual-tree search against scores of all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from figtrace.llm import lexical
from figtrace.llm.queries import QUERIES
from tests.llm.conftest import SF, plain, rows


def plainly(docs, items, k=10):
    """The k best documents of every item, as a sorted list of (item_id, rank, doc_id, score)."""
    said = [(i, plain(t)) for i, t in docs]
    said = [(i, Counter(w), len(w)) for i, w in said if w]
    n_docs, n_all = len(said), sum(n for *_, n in said)
    df = Counter(t for _, c, _ in said for t in c)
    out = []
    for item, text in items:
        wanted = Counter(plain(text))
        scores = []
        for i, c, n in said:
            m = 25 + 75 * n * n_docs // n_all
            s = sum(
                x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, x in wanted.items() if t in c
            )
            if s > 0:
                scores.append((-s, lexical.NO_ID if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_query_is_what_all_pairs_give(spark, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(QUERIES["op13_lexical_search"](spark, SF)) == plainly(list(texts.items()), items)


@pytest.fixture(scope="module")
def many():
    """Documents and items with common and rare words, many equal scores, copies, and rows without an id."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    often = [1 / (i + 1) for i in range(120)]
    text = lambda n: " ".join(draw.choices(words, often, k=n))
    docs = [(i, text(draw.randint(0, 40))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w3 w90 w91"), (None, None), (2000, "w7 " * 5000)]
    items = [(f"i{i}", text(draw.randint(0, 25))) for i in range(90)] + [("none", None), ("empty", ""), ("unknown", "zzz"), ("i1", "w5 w6"), (None, "w3 w90")]
    items.append(("copy", docs[3][1]))
    return docs, items


def frames(spark, many):
    return spark.createDataFrame(many[0], "doc_id long, text string").repartition(5), spark.createDataFrame(many[1], "item_id string, text string")


@pytest.mark.parametrize("options", [{}, {"sample": 50}, {"pass_terms": 100, "sample": 20}, {"k": 3}])
def test_ties_copies_and_passes(spark, many, options):
    docs, items = frames(spark, many)
    assert got(lexical.search(docs, items, **options)) == plainly(*many, k=options.get("k", 10))


def test_small_trees(spark, many, monkeypatch):
    for name, value in {"TREE_ITEMS": 7, "TREE_TERMS": 30, "TREE_DOCS": 33, "ITEM_LEAF": 2, "DOC_LEAF": 3, "FAN": 2}.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = frames(spark, many)
    assert got(lexical.search(docs, items, sample=40)) == plainly(*many)


def test_nodes_are_left_out(many):
    """Pairs of nodes below the thresholds are not scored, and nothing is lost by that."""
    draw = np.random.default_rng(3)
    words = [f"t{i}".encode() for i in range(400)]
    wanted = {i: [words[8 * i + j] for j in range(8)] for i in range(48)}
    weight = draw.integers(500, 9000, len(words))
    tree = lexical.ItemTree(*lexical.item_groups(wanted, {w: i for i, w in enumerate(words)}, weight)[0])
    values = np.zeros((960, len(tree.terms)))
    for d in range(960):
        own = [8 * (d % 48) + j for j in draw.choice(8, 5, replace=False)]
        values[d, np.searchsorted(tree.terms, own)] = draw.integers(200, 900, 5)
    ids = np.arange(960)
    best = lexical.Best(tree, {}, 5)
    scored = lexical.dual_search(tree, values, ids, best)
    again = lexical.dual_search(tree, np.zeros_like(values), ids + 5000, best)
    assert scored < 0.5 * 48 * 960 and again == 0
    scores = (tree.weights @ values.T).astype(int)
    for r in range(48):
        first = np.lexsort((ids, -scores[r]))[:5]
        first = first[scores[r][first] > 0]
        assert best.found[r][1].tolist() == first.tolist() and best.found[r][0].tolist() == scores[r][first].tolist()


def test_very_long_items_are_summed_in_integers(spark):
    items = [("long", "a b " * 400_000), ("short", "a")]
    docs = [(1, "a"), (2, "a b"), (3, "b " * 10), (4, "c")]
    frame = spark.createDataFrame(items, "item_id string, text string")
    assert got(lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), frame)) == plainly(docs, items)


def test_odd_rows_and_clashing_names(spark, odd, none):
    items = odd.select(F.col("doc_id").cast("string").alias("item_id"), "text", F.lit(1).alias("score"), F.lit(2).alias("rank"), F.lit(3).alias("doc_id"))
    docs = odd.withColumn("terms", odd["lang"]).withColumn("n", odd["lang"]).withColumn("_row", odd["lang"])
    want = plainly([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(lexical.search(docs, items)) == want
    assert rows(lexical.search(none, items)) == [] and rows(lexical.search(docs, items.limit(0))) == []
