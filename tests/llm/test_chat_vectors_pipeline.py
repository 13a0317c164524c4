"""Preference formatting, near-duplicate vectors, and the pipeline as a whole."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from figtrace.llm import chat_format, vector_dedup
from figtrace.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF, rows
from tests.llm.test_documents import plain_groups, plain_hits, plain_spans

# Preferences

TURNS = "pair_id long, side string, turn long, role string, text string, prompt string"


def plain_preferences(turns):
    out = {}
    for pair in {t[0] for t in turns} - {None}:
        sides = {
            side: [(r or "", x or "") for _, _, _, r, x in sorted(
                (t[:5] for t in turns if t[0] == pair and t[1] == side), key=lambda t: (t[2] is not None, t[2] or 0, t[3] or "", t[4] or ""))]
            for side in ("chosen", "rejected")
        }
        n = 0
        while n < min(map(len, sides.values())) and sides["chosen"][n] == sides["rejected"][n]:
            n += 1
        parts = {
            side: [p for r, x in said[n:] for p in ((f"<|{r}|>\n", False), (f"{x}<|end|>\n", r == "assistant"))] for side, said in sides.items()
        }
        if any(sides.values()):
            out[pair] = (n, "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in sides["chosen"][:n]), parts["chosen"], parts["rejected"])
    return out


def test_preferences(spark):
    draw = random.Random(9)
    turns = [(1, "chosen", 0, "user", "hi", "p"), (1, "rejected", 0, "user", "hi", "p"), (2, "chosen", 0, "user", "only", "p"), (3, "rejected", 1, None, None, "p"),
             (None, "chosen", 0, "user", "lost", "p"), (4, None, 0, "user", "no side", "p")]
    for pair in range(10, 60):
        common = [(i, draw.choice(["user", "assistant"]), draw.choice(["a", "b", None, ""])) for i in range(draw.randint(0, 4))]
        for side in ("chosen", "rejected"):
            rest = [(len(common) + i, draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "x" * 9000])) for i in range(draw.randint(0, 3))]
            turns += [(pair, side, i if i != 3 else None, r, x, "p") for i, r, x in [*common, *rest]]
    turns += turns[20:24]
    df = spark.createDataFrame(turns, TURNS)
    got = {
        r["pair_id"]: (r["n_common"], r["prompt"], *[[(s["text"], s["trained"]) for s in r[side]] for side in ("chosen", "rejected")])
        for r in rows(chat_format.preferences(df))
    }
    assert got == {k: v for k, v in plain_preferences(turns).items() if k != 4}
    assert chat_format.preferences(df.limit(0)).count() == 0


def test_chat_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    result = con.execute(ORACLES["op1_chat_format"])
    names = [d[0] for d in result.description]
    got = QUERIES["op1_chat_format"](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(result.fetchall())
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Vectors


def plain_links(vectors, threshold):
    good = {i: np.array(v, dtype=float) for i, v in vectors.items() if v and None not in v and np.isfinite(v).all() and any(v)}
    least, links = {i: i for i in vectors}, dict.fromkeys(vectors, 0)
    pairs = []
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                pairs.append((i, j))
    for _ in least:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return {i: (links[i], least[i], least[i] == i) for i in vectors}


@pytest.mark.parametrize("element", ["float", "double"])
def test_vectors(spark, monkeypatch, element):
    for name, n in (("PER_CELL", 16), ("OWNERS", 8), ("MEMBERS", 16)):
        monkeypatch.setattr(vector_dedup, name, n)
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=32) for i in range(150)}
    vectors |= {200 + i: vectors[i % 5] * (1 + i) + rng.normal(size=32) * 0.15 for i in range(100)}
    vectors |= {400 + i: vectors[7] for i in range(40)}
    vectors = {i: v.astype(np.float32).astype(float).tolist() for i, v in vectors.items()}
    vectors |= {500: None, 501: [0.0] * 32, 502: [None] + [1.0] * 31, 503: [float("nan")] * 32, 504: [float("inf")] + [1.0] * 31, 505: [], 506: [1.0, 2.0], 507: [2.0, 4.0]}
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()], f"vec_id long, embedding array<{element}>, n_links int")
    got = vector_dedup.linked(df)
    assert got.columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == plain_links(vectors, 0.95)


def test_tiny_and_huge_vectors_keep_their_direction(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(100, 8))
    vectors = {i: (base[i % 50]).tolist() for i in range(100)}
    for k, scale in enumerate((1e-200, 1e200, 1e-320, 1e308 / np.abs(base).max(), 2.0**-1074)):
        vectors |= {1000 * (k + 1) + i: (np.sign(base[i]) * scale if scale < 1e-310 else base[i] * scale).tolist() for i in range(2)}
        vectors |= {1000 * (k + 1) + 100 + i: vectors[1000 * (k + 1) + i] for i in range(2)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vector_dedup.linked(df).collect()}
    scaled = {i: (np.array(v) / np.abs(v).max()).tolist() for i, v in vectors.items()}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == plain_links(scaled, 0.95)
    assert got[0]["n_links"] >= 1 and got[1000]["component_id"] == 0 and got[2000]["component_id"] == 0


def test_borders_are_exact_in_many_dimensions():
    """Two linked vectors that differ straight across a border meet in the cell of one of them."""
    centres = np.eye(768)[:2]
    half = np.arcsin(np.sqrt(2 - 2 * 0.951) / 2)
    angles = np.pi / 4 + np.array([-half, half])
    x = np.zeros((2, 768))
    x[:, 0], x[:, 1] = np.cos(angles), np.sin(angles)
    between = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    home, visits = vector_dedup._cells_of(x, centres, between, vector_dedup._reach(0.95, 768))
    assert x[0] @ x[1] > 0.95 and home.tolist() == [0, 1] and (visits[0, 1] or visits[1, 0])
    assert vector_dedup._reach(0.95, 64) == pytest.approx(4 * np.sqrt(0.1) / 8)


def test_repeated_and_missing_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in vector_dedup.linked(df).collect())
    assert got == [(0, 0, 0, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]
    assert vector_dedup.linked(df.limit(0)).count() == 0


def test_vector_query(spark):
    vectors = {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op3_vector_dedup"](spark, SF).collect()}
    assert got == plain_links(vectors, 0.95)


# Pipeline


def test_stages_and_run(spark):
    """Each stage on what the one before kept, against brute force; ``run`` packs what the last one left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("mine"))
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    before = text(docs)
    after = corpus_pipeline.staged(stages["toxicity"](spark, docs, SF), "t")
    held = text(after)
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    assert held == {i: t for i, t in before.items() if not scores[i]}

    kept = corpus_pipeline.staged(stages["near_copies"](spark, after, SF), "t")
    assert text(kept) == {i: held[i] for i, (_, top) in plain_groups(held, 5, 80).items() if top == i}

    clean = corpus_pipeline.staged(stages["decontamination"](spark, kept, SF), "t")
    for i, t in text(clean).items():
        n, hit, _ = plain_hits(text_of(kept, i), items, 10)
        assert (t == text_of(kept, i)) == (hit == 0)
    hidden = corpus_pipeline.staged(stages["personal_data"](spark, clean, SF), "t")
    for i, t in text(hidden).items():
        spans = plain_spans(text_of(clean, i))
        assert not plain_spans(t) and (t == text_of(clean, i) or spans)
    for stage in (after, kept, clean, hidden):
        assert stage.columns == docs.columns and {r[0] for r in stage.select("score").distinct().collect()} == {"mine"}
    assert hidden.where("n_chars != length(text)").count() == 0

    packed = stages["packing"](spark, hidden, SF)
    whole = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


_TEXTS: dict = {}


def text_of(df, i):
    held = _TEXTS.setdefault(id(df), {r["doc_id"]: r["text"] for r in df.collect()} if id(df) not in _TEXTS else {})
    return held[i]


def test_stages_of_odd_texts(spark, odd, none):
    for docs in (odd.drop("n_tokens"), none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_a_row_is_kept_whole(odd):
    whole = corpus_pipeline._back(corpus_pipeline._whole(odd), odd)
    assert sorted(map(str, whole.collect())) == sorted(map(str, odd.collect()))


def test_one_row_of_each_group_stays(spark, odd):
    """Repeated rows, equal ids, and near copies without ids."""
    words = " ".join(f"word{i}" for i in range(60))
    near, other = words + " tail", " ".join(f"thing{i}" for i in range(30))
    rows = [(7, words), (7, words), (None, near), (None, words), (3, near), (None, other), (None, other), (8, None), (8, None), (9, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", str(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.drop_near_copies(spark, docs.repartition(3), SF)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, near), (None, other), (8, None), (8, None), (9, ""), (None, "")], key=str) and kept.columns == docs.columns
    again = corpus_pipeline.drop_near_copies(spark, odd, SF)
    texts = [r["text"] for r in again.collect()]
    assert texts.count("word") == 1 and texts.count(None) == 1
