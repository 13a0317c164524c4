"""Toxicity, quality, near copies, decontamination and personal data against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from figtrace.llm import decontaminate, minhash, pii, quality, toxicity
from figtrace.llm.components import components
from figtrace.llm.queries import QUERIES
from figtrace.llm.texts import bit_table
from tests.llm.conftest import EXTRA, SAID, SF, lower, plain, rows, spaced

MORE = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5


# Toxicity and quality


@pytest.mark.parametrize(("query", "label"), [("op2_toxicity", "toxic"), ("op4_quality", "quality")])
def test_held_out_accuracy(spark, query, label):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES[query](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = got.join(labels, "doc_id").where("held_out").select("doc_id", "score", label).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"])
    assert held["score"].between(0, 1).all() and auc(held["score"].values, held[label].values) > 0.9


def labels_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, toxic int, quality int")


def test_toxic_words_tell(spark):
    draw = random.Random(2)
    neutral = [f"w{i}" for i in range(40)]
    said = [(i, draw.choices(neutral, k=30), i % 3 == 0) for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(w[:15] + ["vile"] * bad + w[15:])) for i, w, bad in said], "doc_id long, text string")
    model = toxicity.train(docs, labels_of(spark, [(i, int(bad), 1) for i, _, bad in said]))
    assert max(model.ratios[toxicity.WORD], key=model.ratios[toxicity.WORD].get) == b"vile"
    new = spark.createDataFrame([(1, "w1 w2 vile w3"), (2, "w1 w2 w3"), (3, ""), (4, None), (5, "unheard of")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert score[1] > 0.5 > score[2] and score[3] == score[4] == score[5] < 0.5


def test_toxic_phrases_tell(spark):
    """Ordinary words that are toxic only in one order: single words say nothing."""
    draw = random.Random(12)
    neutral = [f"w{i}" for i in range(40)]
    said = []
    for i in range(600):
        w = draw.choices(neutral, k=30)
        w[10:12] = ["get", "lost"] if i % 3 == 0 else ["lost", "get"]
        said.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([x[:2] for x in said], "doc_id long, text string")
    model = toxicity.train(docs, labels_of(spark, [(i, y, 1) for i, _, y in said if i < 400]))
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert auc(np.array([score[i] for i in range(400, 600)]), np.array([y for i, _, y in said if i >= 400])) > 0.9


def test_training_leaves_little_with_the_driver():
    """What several discounts' models take while they are compared: dicts of tuples took 547 bytes an expression."""
    words = [b"%07d" % i for i in range(60_000)]
    level = [0] * len(words) + [4] * 6000
    keys = words + [b"%04d" % i for i in range(6000)]
    evident = pa.table({"level": pa.array(level), "key": pa.array(keys, pa.binary()), "c0": [i % 7 + 2 for i in range(len(keys))], "c1": [i % 5 for i in range(len(keys))]})
    total = {0: (200_000, 100_000, 0.3, 0.5, 0.7), 4: (30_000, 10_000, 0.2, 0.4, 0.6)}
    levels = toxicity._levels(evident)
    tracemalloc.start()
    below = {n: toxicity._places(levels[n][0], levels, [k for k in toxicity.STEMS if k < n or n == 0]) for n in levels}
    for which in range(3):
        ratios, mass = toxicity._ratios(levels, below, total, which)
    taken = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken < 150 * len(keys)
    # Discount 4: a word backs off to its first four bytes where these have evidence, else to the uniform.
    (stems, said), (words_of, known) = ratios[4], ratios[0]
    stem, word = dict(zip(stems.to_pylist(), said.tolist())), dict(zip(words_of.to_pylist(), known.tolist()))
    row = dict(zip(keys, zip(evident["c0"].to_pylist(), evident["c1"].to_pylist())))
    for key in (b"0000003", b"0001011", b"0059999"):
        p, above = [1.0, 1.0], 300_000.0
        for k, (n0, n1, *shares), held in ((key[:4], total[4], stem), (key, total[0], word)):
            c = row[k]
            assert (k in held) == (max(c) > 4)
            if max(c) > 4:
                part = shares[2] * sum(c) / above
                p, above = [(1 - shares[2]) * max(x - 4, 0) / n + part * q for x, n, q in zip(c, (200_000, 100_000), p)], sum(c)
                assert held[k] == math.log(p[1] / p[0])


def test_bit_tables_take_one_job(spark):
    """Whatever the number of partitions; a job for each was 211 jobs of the driver on as many."""
    size, group = 1 << 12, "bit-table"
    spots = spark.createDataFrame([(i * i % size,) for i in range(900)], "s long").repartition(40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup(group, group)
    try:
        held = bit_table(spots, size)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(np.flatnonzero(np.unpackbits(held.view(np.uint8), bitorder="little")).tolist()) == {i * i % size for i in range(900)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 4
    assert not bit_table(spots.where("s < 0"), size).any()


def test_scores_of_odd_texts(spark, odd, none):
    one_class = labels_of(spark, [(1, 0, 1), (None, 1, 1), (2, None, None)])
    for docs in (odd, none):
        model = toxicity.train(docs, one_class)
        got = toxicity.score(docs, model)
        assert got.count() == docs.count() and {r["score"] for r in got.collect()} <= {0.0}
        judged = quality.score(docs, one_class, host=F.col("source"), path=F.col("lang"), keep=["doc_id", "kept"])
        assert judged.count() == docs.count() and judged.columns == ["doc_id", "classifier", "host_rate", "path_rate", "score", "kept"]
    no_labels = quality.score(odd, labels_of(spark, []), host=F.lit(None), path=F.lit(None), keep=["doc_id"])
    assert {round(r["score"], 6) for r in no_labels.collect()} == {0.5}


def test_sparse_sites_shrink(spark):
    good = "plain words of prose that go on for a while and end here"
    sites = [("a", 60, 57), ("b", 60, 6), ("c", 1, 0), ("d", 40, 30)]
    docs, labels, i = [], [], 0
    for host, n, fine in sites:
        for k in range(n):
            docs.append((i, good, host))
            labels.append((i, 0, int(k < fine)))
            i += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string, host string")
    got = quality.score(frame, labels_of(spark, labels), host=F.col("host"), path=F.col("host"), keep=["doc_id", "host"])
    rate = {r["host"]: r["host_rate"] for r in got.collect()}
    overall = sum(f for _, _, f in sites) / sum(n for _, n, _ in sites)
    assert rate["b"] < 0.2 < rate["c"] < overall < rate["d"] < rate["a"]


def test_words_tell_quality(spark):
    """Texts of one shape, that only their words tell apart."""
    draw = random.Random(4)
    neutral, good, bad = ([f"{c}{i:03}" for i in range(80)] for c in "ngb")
    texts = [(i, " ".join(draw.choices(neutral, k=30) + draw.choices(good if i % 2 else bad, k=3)), "h") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, host string")
    got = quality.score(docs, labels_of(spark, [(i, 0, i % 2) for i in range(400)]), host=F.col("host"), path=F.col("host"), keep=["doc_id"])
    held = {r["doc_id"]: r["classifier"] for r in got.collect() if r["doc_id"] >= 400}
    assert auc(np.array(list(held.values())), np.array([i % 2 for i in held])) > 0.95


def test_rates_and_scores_are_those_of_the_formula(spark):
    """Shrinkage by the method of moments, and scores that leave the document itself out."""
    draw = random.Random(5)
    docs = [(i, "words of prose " + " ".join(draw.choices("abcdefgh", k=6)), f"h{i % 7}", f"p{i % 3}") for i in range(300)]
    labels = [(i, 0, int(draw.random() < 0.2 + 0.1 * (i % 7))) for i in range(250)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    got = [r.asDict() for r in quality.score(frame, labels_of(spark, labels), host=F.col("host"), path=F.col("path"), keep=["doc_id", "host", "path"]).collect()]
    label = {i: y for i, _, y in labels}
    own = {r["doc_id"]: float(label.get(r["doc_id"], r["classifier"])) for r in got}
    of = {(h, p): [r["doc_id"] for r in got if (r["host"], r["path"]) == (h, p)] for h, p in {(r["host"], r["path"]) for r in got}}
    at = {h: [i for (g, _), ids in of.items() if g == h for i in ids] for h in {h for h, _ in of}}
    n, k = len(own), sum(own.values())
    overall, total = k / n, lambda ids: sum(own[i] for i in ids)
    weight = lambda groups, spread: (lambda beyond: min(max(overall * (1 - overall) / beyond, 1.0), 1e6) if beyond > 0 else 1e6)((spread - (groups - 1) * overall * (1 - overall)) / n)
    hw = weight(len(at), sum(total(ids) ** 2 / len(ids) for ids in at.values()) - n * overall**2)
    pw = weight(max(1, len(of) - len(at) + 1), sum(len(ids) * (total(ids) / len(ids) - total(at[h]) / len(at[h])) ** 2 for (h, _), ids in of.items()))
    logit = lambda p: math.log(max(p, 1e-9) / max(1 - p, 1e-9))
    for r in got:
        h, ids, mine = at[r["host"]], of[r["host"], r["path"]], own[r["doc_id"]]
        host = (total(h) + hw * overall) / (len(h) + hw)
        assert r["host_rate"] == pytest.approx(host) and r["path_rate"] == pytest.approx((total(ids) + pw * host) / (len(ids) + pw))
        host = (total(h) - mine + hw * overall) / (len(h) - 1 + hw)
        rate = (total(ids) - mine + pw * host) / (len(ids) - 1 + pw)
        score = 1 / (1 + math.exp(logit(overall) - logit(r["classifier"]) - logit(rate)))
        assert r["score"] == pytest.approx(score) and r["kept"] == (r["score"] >= 0.5)


# Near copies


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = spaced(t)
        n = min(size, len(w))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    return out


def plain_groups(texts, size, percent):
    held = sets_of(texts, size)
    least = {i: i for i in held}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(held)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = held[i], held[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                least[max(x, y)] = min(x, y)
    return {i: (len(held[i]), top(i)) for i in held}


def test_near_copy_query(spark, texts):
    want = plain_groups(texts, 2, 80)
    for r in QUERIES["op5_minhash_dedup"](spark, SF).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_a_group_of_near_copies(spark, monkeypatch):
    """Copies that are like their original but not like each other, in blocks smaller than the group."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    draw = random.Random(4)
    words = [f"w{i}" for i in range(100)]
    texts = {50: " ".join(words)}
    for i in range(30):
        changed = list(words)
        for k in draw.sample(range(100), 9):
            changed[k] = f"x{i}_{k}"
        texts[i] = " ".join(changed)
    texts |= {100 + i: " ".join(draw.choices(words, k=40)) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size, percent in ((1, 80), (2, 80)):
        want = plain_groups(texts, size, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(docs, size=size, percent=percent).collect()}
        assert got == want


def test_near_copies_of_odd_texts(odd, none):
    got = rows(minhash.groups(odd, size=5))
    assert len(got) == odd.count()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    assert {r["component_id"] for r in [*of[1], *of[2]]} == {1} and [r["kept"] for r in of[2]] == [False]
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for i in (3, 4, 5) for r in of[i]] == [(0, i, True) for i in (3, 4, 5)]
    assert [r["component_id"] for r in of[6]] == [6, 6]
    assert sorted((r["component_id"] or 0, r["kept"]) for r in of[None]) == [(0, True), (1, False)]
    assert minhash.groups(none).count() == 0


def test_bounds_give_up_what_is_unlikely():
    bounds = minhash.least_matches(0.8)
    assert [n for n, _ in bounds] == list(range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH))
    assert all(0 < m < 0.8 * n for n, m in bounds)


def test_components(spark):
    draw = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)]
    least = {i: i for p in links for i in p}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    linked = {i for a, b in links if a != b for i in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["id"], r["root"]) for r in got) == sorted((i, least[i]) for i in linked)


# Benchmark


def plain_hits(text, items, window):
    w = plain(text)
    hit, names = set(), set()
    for name, t in items:
        i = plain(t)
        n = min(window, len(i))
        windows = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if i else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                names.add(name)
    return len(w), len(hit), sorted(names)


def test_benchmark_query(spark, texts):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in QUERIES["op6_decontaminate"](spark, SF).collect():
        n, hit, names = plain_hits(texts[r["doc_id"]], items, 10)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(names), digest, hit > 0)


@pytest.mark.parametrize("words", [1_000, 15])
def test_short_items_and_several_automata(spark, words):
    draw = random.Random(8)
    say = lambda n: " ".join(draw.choices(["a", "b", "c", "É"], k=n))
    items = [(i, say(draw.randint(0, 9))) for i in range(8)] + [(8, None), (9, "...")]
    texts = {i: say(draw.randint(0, 60)) for i in range(40)}
    got = decontaminate.mark(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), window=4, automaton_words=words,
    ).withColumn("n_hit", decontaminate.covered(F.col("spans")))
    named = [(str(i), t or "") for i, t in items]
    for r in got.collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == plain_hits(texts[r["doc_id"]], named, 4)


def test_removing_benchmark_passages(spark, odd, none):
    items = spark.createDataFrame([(1, "brown FOX jumps -- over the lazy dog while eleven more")], "item_id long, text string")
    cleaned = {(r["doc_id"], r["text"]) for r in decontaminate.remove(odd, items).collect()}
    before = {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert (1, SAID.replace("brown fox jumps over the lazy dog while eleven more", "")) in cleaned
    assert {c for c in cleaned if c[0] not in (1, 2, None)} == {b for b in before if b[0] not in (1, 2, None)}
    assert decontaminate.remove(odd, items).columns == odd.columns
    assert {(r["doc_id"], r["text"]) for r in decontaminate.remove(odd, items.limit(0)).collect()} == before
    assert decontaminate.remove(none, items).count() == 0 and decontaminate.remove(odd, items, max_coverage=0.1).count() < odd.count()


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def passes(kind, found):
        d = [int(c) for c in found if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            twice = [2 * x - 9 * (x > 4) if i % 2 else x for i, x in enumerate(reversed(d))]
            return 13 <= len(d) <= 19 and sum(twice) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_personal_data_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    some = 0
    for r in QUERIES["op7_pii"](spark, MORE).collect():
        spans = plain_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"].startswith(listed)
        some += len(spans)
    assert some > 20


@pytest.mark.parametrize(
    ("text", "kinds"),
    [("1.2.3.400", []), ("é 10.0.0.255", ["ip"]), ("4111-1111 11111111", ["card"]), ("4111 1111 1111 1112", []), ("+1 (2) 3456789", ["phone"]),
     ("+123", []), ("a@b", []), ("x.y+z@a-b.co.uk", ["email"]), ("0000000000000", ["card"]), (None, [])],
)
def test_personal_data_patterns(text, kinds):
    found = pii.entities(text.encode() if text else None)
    assert [pii.KINDS[k] for k, _, _ in found] == kinds and [(pii.KINDS[k], a, b) for k, a, b in found] == plain_spans(text)


def test_patterns_of_random_texts():
    draw = random.Random(9)
    parts = ["a", "B9", "@", ".", "-", "%", "+", " ", "1", "23", "4111", "300", "00", "(", ")", "é", "\n", "x.y@z.co", "10.0.0.1", "4111 1111 1111 1111"]
    for _ in range(30_000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 14)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.entities(text.encode())] == plain_spans(text), text


@pytest.mark.parametrize("text", ["a" * 10**6 + "@", "7" * 10**6 + "@+", "1." * 500_000, "@" * 10**6 + "123456789+", "a@" * 500_000, "+1" + " " * 10**6 + "23456789",
                                  "+1" * 500_000, "9 " * 500_000, "a@b." * 250_000, "0" * 10**6 + "1.2.3.4"])
def test_long_runs_take_linear_time(text):
    start = time.perf_counter()
    found = pii.entities(text.encode())
    assert time.perf_counter() - start < 5
    if text.startswith("0"):
        assert [text[a:b] for k, a, b in found if pii.KINDS[k] == "ip"] == [text]


def test_words_that_disclose(spark, odd, none):
    said = [(i, f"please ask zorblat or write to a.b@mail.example.com the common word n{i}", *EXTRA) for i in range(6)]
    other = [(100 + i, f"the common word and please write of thing{i} to all", *EXTRA) for i in range(400)]
    docs = spark.createDataFrame(said + other, odd.schema)
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    word = lambda i, s: docs_text[i][s["start"] : s["end"]]
    docs_text = {r[0]: r[1] for r in said + other}
    for i in range(6):
        assert [word(i, s) for s in spans[i]] == ["a.b@mail.example.com", *[w for w in ("ask", "zorblat", "or") if w in docs_text[i]]]
    assert not any(spans[i] for i in range(100, 500))
    cleaned = {r["doc_id"]: r["text"] for r in pii.clean(docs).collect()}
    assert "zorblat" not in cleaned[0] and "[EMAIL]" in cleaned[0] and cleaned[100] == docs_text[100]
    kept = {(r["doc_id"], r["text"]) for r in odd.where("doc_id != 9").collect()}
    assert kept <= {(r["doc_id"], r["text"]) for r in pii.clean(odd).collect()} and pii.find(odd).count() == odd.count()
    assert pii.find(odd).columns == [c for c in odd.columns if c != "spans"] + ["spans"] and pii.clean(none).count() == 0


def test_disclosing_words_go_everywhere(spark):
    """Far from the entity, and in a text without it; a word inside an entity stays part of that."""
    far = "the common words go on here " * 40
    said = [(i, f"write to a.b@mail.example.com {far} said zorblat n{i}") for i in range(8)] + [(50, f"{far} and Zorblat again")]
    docs = spark.createDataFrame(said + [(100 + i, far + f"said and write to again k{i}") for i in range(3000)], "doc_id long, text string")
    cleaned = {r["doc_id"]: r["text"] for r in pii.clean(docs).collect()}
    assert not any("zorblat" in t.lower() for t in cleaned.values())
    assert cleaned[0].startswith("write to [EMAIL] the common") and cleaned[100] == far + "said and write to again k0"


def plain_terms(texts):
    """Hidden words of distinct texts, by counting every pair of an entity and a word."""
    held = {t: ({(k, t[a:b].lower()) for k, a, b in plain_spans(t)}, plain_spans(t)) for t in set(texts)}
    words = {}
    for t, (_, spans) in held.items():
        inside = {i for _, a, b in spans for i in range(a, b)}
        found = [(m.span(), lower(m.group())) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        words[t] = {w for (a, b), w in found if not inside & set(range(a, b))} if spans else set()
    every = {t: set(plain(t)) for t in held}
    total, out = len(held) + 1, set()
    for e in set().union(*(es for es, _ in held.values())):
        of = [t for t, (es, _) in held.items() if e in es]
        for w in set().union(*(words[t] for t in of)):
            both, at_all = sum(w in words[t] for t in of), sum(w in ws for ws in every.values())
            p = len(of) / total
            part = 1 + math.log((both + pii.SMOOTH * p) / (at_all + pii.SMOOTH)) / math.log(1 / p)
            if both > 1 and both >= pii.LEAST * (at_all + pii.SMOOTH) and part >= pii.GENERALISE:
                out.add(w)
    return out


def hidden_words(texts, rows):
    return {lower(texts[r["doc_id"]][s["start"] : s["end"]]) for r in rows for s in r["spans"] if s["kind"] == pii.TERM}


def test_terms_are_those_of_all_pairs(spark):
    """Whatever is counted; copies of texts change nothing, and copies alone hide nothing."""
    draw = random.Random(12)
    mails = [f"m{i}@ex.org" for i in range(12)]
    names = {m: [f"name{i}x{k}" for k in range(3)] for i, m in enumerate(mails)}
    texts = []
    for i in range(400):
        said = draw.choices([f"w{k}" for k in range(300)], k=30)
        if i % 4 == 0:
            for m in draw.sample(mails, 1 + i % 2):
                said += [m, *draw.sample(names[m], 2)]
        if i % 17 == 0:
            said.append(draw.choice(names[draw.choice(mails)]))
        draw.shuffle(said)
        texts.append(" ".join(said))
    lone = "only here stands quixotal by someone@else.net and nowhere else"
    for times in (1, 3):
        all_texts = texts * times + [lone] * 3
        df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(5)
        got = hidden_words(dict(enumerate(all_texts)), pii.find(df).collect())
        assert got == plain_terms(all_texts) and len(got) > 5 and "quixotal" not in got


def test_words_around_entities_are_whole():
    text = "é" * 500 + " a.b@c.de " + "x" * 900 + " end"
    assert [text[a:b] for a, b in pii.others(text, pii.entities(text.encode()))] == ["é" * 500, "x" * 900, "end"]
