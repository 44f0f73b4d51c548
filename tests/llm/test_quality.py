from __future__ import annotations

import random
import zlib

import numpy as np

from sieveworks.llm import quality
from sieveworks.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, predicted double"


def test_shapes():
    assert quality.shape("Thre***") == "Aaa**"
    assert quality.shape("THE!!") == "AA!!" and quality.shape("a1B22|") == "a9A99|" and quality.shape("") == ""


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = np.where(x @ [1.0, -2.0, 0.5, 0.0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows, cost = [np.arange(4)] * 60, np.full(60, 0.7)
    w, b = quality.dual_coordinate_descent(rows, list(x), y, 4, cost, epochs=3000)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    best = loss(w, b)
    for _ in range(400):
        assert loss(w + rng.normal(size=4) * 0.02, b + rng.normal() * 0.02) >= best - 1e-3


def test_ratios_equal_counts(session):
    texts = [("aa bb aa", 1), ("bb CC", 0), ("aa", 1), ("", 0), (None, 1)]
    df = session.createDataFrame([(y, t, i) for i, (t, y) in enumerate(texts)], "label int, text string, draw long")
    got = quality.log_count_ratios(df)
    p, q = np.ones(2 * quality.BUCKETS), np.ones(2 * quality.BUCKETS)
    for t, y in texts:
        (p if y else q)[quality.Indicators().of(t)] += 1
    assert np.allclose(got, np.log(p / p.sum()) - np.log(q / q.sum()))


def corpus(n):
    rng = random.Random(8)
    out = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(rng.randint(20, 60))]
        good = i % 5 != 0
        if not good:
            words = [w + "***" for w in words] if i % 2 else [words[0]] * 40
        out.append((i, " ".join(words), "x", 0.0, int(good)))
    return out


def test_new_junk_is_told_apart(session):
    rows = corpus(500)
    docs = session.createDataFrame([r[:4] for r in rows], SCHEMA)
    labels = session.createDataFrame([(r[0], r[4]) for r in rows if r[0] < 400], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    unseen = [(got[r[0]]["predicted"], r[4]) for r in rows if r[0] >= 400]
    assert sum(a == b for a, b in unseen) >= 98


def test_odd_rows(session):
    rows = corpus(200)
    odd = [(None, None, "x", 0.0), (900, "", "x", None), (901, " \n", "x", None), (902, "w " * 60_000, "x", None),
           (3, None, "x", None), (3, None, "x", None)]
    docs = session.createDataFrame([r[:4] for r in rows] + odd, SCHEMA)
    labels = session.createDataFrame([(r[0], r[4]) for r in rows] + [(None, 1), (3, None), (7, 5), (1, 1), (1, 0)],
                                     "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 206 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1
    one_class = quality.score(docs, labels.filter("quality = 1")).collect()
    assert {r["score"] for r in one_class} == {1.0}
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.score(docs.limit(0), labels.limit(0)).count() == 0


def test_query_held_out(session):
    path = "/root/testdata/sf0.01"
    rows = QUERIES["op7_quality"](session, path).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7)
    labels = dict(session.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality").collect())
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
