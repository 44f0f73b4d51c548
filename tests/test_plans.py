"""Ordering, catalog, chat, models and merges against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sieveworks.models import ngram as N
from sieveworks.models import tabular as TB
from sieveworks.models import vectors as V
from sieveworks.plans import catalog as K
from sieveworks.plans import chat as C
from sieveworks.plans import ordering as O
from sieveworks.plans.merge import signature_compare, weighted_merge


def test_global_position_dense(spark):
    df = spark.range(0, 5000).withColumn("k", F.sha2(F.col("id").cast("string"), 256))
    pos = O.with_global_position(df, [F.col("k"), F.col("id")], "p")
    got = {r["id"]: r["p"] for r in pos.collect()}
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((r["k"], r["id"]) for r in df.collect()))}
    assert got == want


def test_source_number_parquet(spark, small_dir):
    d = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = O.with_source_number(d).select("doc_id", O.SN).collect()
    assert all(r[O.SN] == r["doc_id"] + 1 for r in got)


def test_toggle_state_matches_fold(spark):
    rng = np.random.default_rng(1)
    rows = [(int(u), int(t), ["up", "down"][int(rng.integers(0, 2))]) for t, u in enumerate(rng.integers(0, 30, 800))]
    df = spark.createDataFrame(rows, "user long, ts long, v string")
    got = {r["user"]: r["state"] for r in K.toggle_state(df, ["user"], ["ts"], "v").collect()}
    state = {}
    for u, _, v in rows:
        state[u] = None if state.get(u) == v else v
    assert got == {u: s for u, s in state.items() if s is not None}


def test_chat_context_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for conv in range(6):
        for turn in range(int(rng.integers(1, 40))):
            rows.append((conv, turn, ["user", "assistant", "system"][turn % 3], "  word " * int(rng.integers(0, 30))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["context"] for r in C.chat_context(df, maximum_characters=300).collect()}
    for conv in range(6):
        msgs = [r for r in rows if r[0] == conv]
        lines = [f"{'Assistant' if r[2] == 'assistant' else 'User'}: {r[3].strip()}" for r in msgs] + ["Assistant:"]
        assert got[conv] == "\n\n".join(lines)[-300:]


def test_ngram_brute_force(spark):
    texts = ["the cat sat on the mat", "the cat ran", "a cat sat on the hat", "the cat sat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    model = N.ngram_fit(df, F.col("text"), F.col("doc"), order=2)
    trans = defaultdict(Counter)
    for t in texts:
        toks = re.findall(r"\w+|[^\w\s]", t.lower())
        for i in range(len(toks) - 2):
            trans[tuple(toks[i:i + 2])][toks[i + 2]] += 1
    got = {(r["state"], r["next"]): r["cnt"] for r in model.collect()}
    want = {(N.SEP.join(s), n): c for s, cnt in trans.items() for n, c in cnt.items()}
    assert got == want
    best = {r["state"]: r["next"] for r in N.ngram_next(model).collect()}
    assert best == {N.SEP.join(s): max(cnt, key=cnt.get) for s, cnt in trans.items()}
    prompts = spark.createDataFrame([(1, "so the cat"), (2, "x")], "id long, p string")
    gen = {r["id"]: r["text"] for r in N.ngram_generate(prompts, "p", "id", N.ngram_next(model), 2, 5).collect()}
    table = {s: max(cnt, key=cnt.get) for s, cnt in trans.items()}  # dicts keep first-seen order
    state, out = ("the", "cat"), []
    for _ in range(5):
        if state not in table:
            break
        out.append(table[state])
        state = (state[1], table[state])
    assert gen[1] == " ".join(out) == "sat on the mat" and gen[2] is None


def test_sales_predictor(spark):
    schema = [TB.Feature("ad_spend", "numeric", 100.0, 100.0, 20.0), TB.Feature("region", "categorical",
                                                                                  categories=["north", "south"])]
    df = spark.createDataFrame([("120", "north")], "ad_spend string, region string")
    x = TB.encode(df, schema)
    pred = df.select(TB.predict_regression(x, np.array([1000, 200, 50, -50, 0.0]))).first()[0]
    assert pred == 1250.0


def test_ridge_and_softmax_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.c_[np.ones(200), rng.normal(size=(200, 3))]
    y = x @ np.array([1.0, 2.0, -1.0, 0.5]) + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y)], "x array<double>, y double")
    pen = np.eye(4) * 0.001
    pen[0, 0] = 0
    assert np.allclose(TB.ridge_fit(df, 4, 0.001), np.linalg.pinv(x.T @ x + pen) @ x.T @ y)
    labels = (y > y.mean()).astype(int)
    dfc = spark.createDataFrame([(list(map(float, r)), int(t)) for r, t in zip(x, labels)], "x array<double>, y long")
    w = TB.softmax_fit(dfc, 4, 2, 0.05, 20, 0.001)
    ref = np.zeros((4, 2))
    for _ in range(20):
        s = x @ ref
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
        g = x.T @ (p - np.eye(2)[labels]) / len(x)
        g[1:] += 0.001 * ref[1:]
        ref -= 0.05 * g
    assert np.allclose(w, ref)


def test_tiny_centroids(spark):
    train = spark.createDataFrame([("dark", [0.0]), ("light", [1.0])], "label string, v array<double>")
    cents = V.centroids_as_arrays(V.centroid_fit(train, "v", "label"))
    pred = V.centroid_classify(spark.createDataFrame([([1.0],)], "v array<double>"), "v", cents, 3).first()
    assert pred["predictions"][0]["label"] == "light"


def test_weighted_merge(spark):
    a = spark.createDataFrame([("w", [2, 2], [1.0] * 4)], "name string, shape array<int>, values array<float>")
    b = spark.createDataFrame([("w", [2, 2], [2.0] * 4)], "name string, shape array<int>, values array<float>")
    assert signature_compare(a, b).first()["blockers"] == ""
    assert weighted_merge(a, b, 0.25, 0.75).first()["values"] == [1.75] * 4


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, "a" if i < 80 else "b") for i in range(100)], "id long, label string")
    out = O.split_stratified(df, "id", "label", 0.2, 42)
    counts = Counter((r["label"], r["split"]) for r in out.collect())
    assert counts[("a", "test")] + counts[("b", "test")] == 20 and counts[("b", "test")] >= 1


def test_ngram_sample_brute_force(spark):
    import hashlib

    texts = ["a b c a b d a b c", "a b e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    model = N.ngram_fit(df, F.col("text"), F.col("doc"), order=2)
    prompts = spark.createDataFrame([(7, "x a b")], "id long, p string")
    got = N.ngram_sample(prompts, "p", "id", model, 2, 4, seed=3).first()["text"]
    trans = {}
    for d, t in enumerate(texts):
        toks = t.split()
        for i in range(len(toks) - 2):
            opts = trans.setdefault((toks[i], toks[i + 1]), {})
            opts[toks[i + 2]] = opts.get(toks[i + 2], 0) + 1  # dict order = first seen
    state, out = ("a", "b"), []
    for step in range(4):
        opts = trans.get(state)
        if not opts:
            break
        u = int(hashlib.sha256(f"3:7:{step}".encode()).hexdigest()[:13], 16) / 2 ** 52
        r = int(u * sum(opts.values()))
        acc = 0
        for tok, cnt in opts.items():
            acc += cnt
            if acc > r:
                break
        out.append(tok)
        state = (state[1], tok)
    assert got == " ".join(out)
