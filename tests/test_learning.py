"""Shared narrowing, tree sums, jump tables and bucketed sampling."""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.models import ngram as N
from sieveworks.models import tabular as TB
from sieveworks.plans.select import order_statistics


def jobs(spark, work) -> int:
    """How many Spark jobs ``work`` runs."""
    sc = spark.sparkContext
    group = uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        work()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("buckets", [64, 4096])
def test_order_statistics_equal_a_sort(spark, buckets):
    rng = np.random.default_rng(1)
    columns = {
        "plain": rng.normal(size=500), "ties": rng.integers(0, 3, 500).astype(float), "one": np.full(500, 7.0),
        "wide": np.concatenate([rng.normal(size=498), [-1.7e308, 1.7e308]]),
        "scales": 10.0 ** rng.uniform(-250, 250, 500), "tiny": rng.integers(0, 4, 500) * 5e-324,
    }
    rows = [tuple(float(columns[c][i]) for c in columns) + (None,) for i in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", empty double").repartition(3)
    ranks = {c: [1, 2, 250, 251, 499, 500] for c in columns}
    bounds = {c: (float(v.min()), float(v.max())) for c, v in columns.items()}
    got = order_statistics(df, ranks, bounds, buckets)
    for c, v in columns.items():
        assert got[c] == [np.sort(v)[k - 1] for k in ranks[c]], c
    assert order_statistics(df, {}, {}) == {}


def test_schema_jobs_do_not_grow_with_columns(spark):
    n = 400
    rows = [(i, *[float((i * 7) % 101)] * 6, *[f"v{(i * i) % 5}"] * 3) for i in range(n)]
    names = [f"n{c}" for c in range(6)] + [f"t{c}" for c in range(3)]
    df = spark.createDataFrame(rows, "__sw_sn long, " + ", ".join(
        f"{x} {'double' if x[0] == 'n' else 'string'}" for x in names))
    few = jobs(spark, lambda: TB.feature_schema(df, ["n0", "t0"]))
    many = jobs(spark, lambda: TB.feature_schema(df, names))
    assert many == few
    for f in TB.feature_schema(df, names):
        if f.kind == "numeric":
            assert f.median == np.median([r[1 + names.index(f.name)] for r in rows])
        else:
            seen = [r[1 + names.index(f.name)] for r in rows]
            assert f.categories == sorted(set(seen), key=lambda v: (-seen.count(v), seen.index(v)))


def test_tree_sum_in_levels(spark):
    blocks = [np.arange(5.0) * i for i in range(100)]
    df = spark.createDataFrame([(b.tobytes(),) for b in blocks], "sums binary").repartition(100)
    want = np.sum(blocks, axis=0)
    for fan_in in (2, 7, 1000):
        assert np.allclose(TB.tree_sum(df, 5, 100, fan_in), want)
    assert TB.tree_sum(df.limit(0), 5, 0).tolist() == [0.0] * 5


def test_ridge_equals_numpy_over_many_partitions(spark):
    rng = np.random.default_rng(2)
    x = np.hstack([np.ones((300, 1)), rng.normal(size=(300, 3))])
    y = x @ [1.0, 2.0, -3.0, 0.5] + rng.normal(size=300)
    df = spark.createDataFrame([(list(map(float, a)), float(b), "train" if i % 3 else "validation")
                                for i, (a, b) in enumerate(zip(x, y))], "x array<double>, y double, split string")
    penalty = np.diag([0, 1e-3, 1e-3, 1e-3])
    train, every = TB.ridge_fit_with_validation(df.repartition(70), 4)
    mask = np.arange(300) % 3 != 0
    for got, (a, b) in ((train, (x[mask], y[mask])), (every, (x, y))):
        assert np.allclose(got, np.linalg.solve(a.T @ a + penalty, a.T @ b), atol=1e-10)
    assert np.allclose(TB.ridge_fit(df, 4), every)


def test_softmax_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.hstack([np.ones((200, 1)), rng.normal(size=(200, 2))])
    y = rng.integers(0, 3, 200)
    df = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "x array<double>, y long")
    w = np.zeros((3, 3))
    for _ in range(20):
        p = np.exp(x @ w)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(200), y] -= 1
        g = x.T @ p / 200
        g[1:] += 0.001 * w[1:]
        w -= 0.05 * g
    assert np.allclose(TB.softmax_fit(df.repartition(40), 3, 3, iterations=20), w, atol=1e-12)


def test_too_many_classes(spark, monkeypatch):
    monkeypatch.setattr(TB, "MAXIMUM_CLASSES", 3)
    df = spark.createDataFrame([(i, float(i), f"c{i}") for i in range(8)], "__sw_sn long, a double, c string")
    with pytest.raises(ValueError, match="at most 3"):
        TB.fit_tabular(df, ["a"], "c", "classification")


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(1, "a b c d e f a b c d e g"), (2, "x y z"), (3, "a b c d e f"), (4, "q q q q")],
                                 "id long, text string")
    return N.ngram_fit(docs, F.col("text"), F.col("id"), order=2)


def walked(best: dict, prompt: str, steps: int) -> str | None:
    toks = re.findall(r"\w+|[^\w\s]", prompt.lower())
    if len(toks) < 2:
        return None
    out = []
    for _ in range(steps):
        token = best.get(N.SEP.join((toks + out)[-2:]))
        if token is None:
            break
        out.append(token)
    return " ".join(out)


@pytest.mark.parametrize("steps", [0, 1, 5, 13, 30])
@pytest.mark.parametrize("sent", [0, N.MAX_BROADCAST_BYTES])
def test_jumps_walk_as_single_steps(spark, model, steps, sent):
    best = N.ngram_next(model)
    table = {r["state"]: r["next"] for r in best.collect()}
    prompts = ["a b", "x y", "y z", "q q", "nothing here", "short", "", "E F A B"]
    df = spark.createDataFrame(list(enumerate(prompts)), "id long, text string")
    got = N.ngram_generate(df, "text", "id", best, max_new_tokens=steps, max_broadcast_bytes=sent)
    assert {r["id"]: r["text"] for r in got.collect()} == {i: walked(table, p, steps) for i, p in enumerate(prompts)}


def test_thirty_steps_take_few_joins(spark, model):
    prompts = spark.createDataFrame([(1, "a b")], "id long, text string")
    got = N.ngram_generate(prompts, "text", "id", N.ngram_next(model))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b", plan)) <= 6


def drawn(model: dict, prompt: list[str], key: int, steps: int, seed: int = 42) -> list[str]:
    out, state = [], prompt
    for step in range(steps):
        options = list(model.get(N.SEP.join(state), {}).items())
        if not options:
            break
        u = int(hashlib.sha256(f"{seed}:{key}:{step}".encode()).hexdigest()[:13], 16) / 2.0 ** 52
        r = int(u * sum(n for _, n in options))
        for token, n in options:
            if r < n:
                break
            r -= n
        out.append(token)
        state = (state + [token])[-2:]
    return out


@pytest.mark.parametrize("inline", [1, 7, 1024])
def test_sampling_by_buckets_equals_one_list(spark, inline):
    rows = [("a\x1fb", f"t{i}", 1 + i % 5) for i in range(300)] + [(f"b\x1ft{i}", "a", 1) for i in range(300)]
    rows += [(f"t{i}\x1fa", "b", 2) for i in range(300)]
    rows = [(*r, i // 7, i % 7) for i, r in enumerate(rows)]
    table: dict = {}
    for state, token, n, _, _ in rows:
        table.setdefault(state, {})[token] = n
    model = spark.createDataFrame(rows, "state string, next string, cnt long, first_doc long, first_pos int").repartition(3)
    prompts = spark.createDataFrame([(k, "a b") for k in range(40)] + [(99, "b zzz"), (100, "a")], "id long, text string")
    got = N.ngram_sample(prompts, "text", "id", model, max_new_tokens=7, inline=inline).collect()
    want = {k: " ".join(drawn(table, ["a", "b"], k, 7)) for k in range(40)} | {99: "", 100: None}
    assert {r["id"]: r["text"] for r in got} == want


def test_a_hot_state_is_never_one_row(spark):
    hot = spark.range(100_000).select(F.lit("a\x1fb").alias("state"), F.concat(F.lit("t"), F.col("id")).alias("next"),
                                      F.lit(1).cast("long").alias("cnt"), F.col("id").alias("first_doc"),
                                      F.lit(0).alias("first_pos"))
    states, buckets = N.ngram_sample_tables(hot)
    row = states.select("total", "whole", F.size("options").alias("n")).first()
    assert (row["total"], row["whole"]) == (100_000, False) and row["n"] <= 4096
    sizes = buckets.agg(F.max(F.size("options")), F.sum(F.size("options"))).first()
    assert sizes[0] <= 1024 and sizes[1] == 100_000
    prompts = spark.range(50).select("id", F.lit("a b").alias("text"))
    got = N.ngram_sample(prompts, "text", "id", hot, max_new_tokens=3)
    assert got.filter("text RLIKE '^t[0-9]+$'").count() == 50


def test_gradient_tells_the_optimum(spark):
    from sieveworks.models import vectors as V

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(120, 3)), rng.integers(0, 3, 120)
    df = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "v array<double>, k int")
    labels, w, b = V.linear_softmax_fit(df, "v", "k")
    at = V.linear_softmax_gradient(df, "v", "k", labels, w, b)
    assert at.shape == (3, 4) and abs(at).max() < 1e-3
    p = np.exp(x @ w.T + b)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(120), y] -= 1
    want = np.concatenate([p.mean(axis=0)[:, None], p.T @ x / 120 + w / 120], axis=1)
    assert np.allclose(at, want)
    assert abs(V.linear_softmax_gradient(df, "v", "k", labels, w + 0.5, b)).max() > 1e-3


def test_large_document_numbers_fit_alike(spark):
    texts = ["a b c a b d", "a b c", "x a b c"]
    small = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    large = small.withColumn("id", F.col("id") + 2 ** 40)
    got, far = (sorted(map(tuple, N.ngram_fit(df, F.col("text"), F.col("id")).collect())) for df in (small, large))
    assert [(*r[:3], r[3] + 2 ** 40, r[4]) for r in got] == far
    assert ("a\x1fb", "c", 3, 0, 0) in got and ("x\x1fa", "b", 1, 2, 0) in got
    assert N.ngram_fit(small.limit(0), F.col("text"), F.col("id")).collect() == []


def test_fit_by_state_is_the_same_in_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(N, "COMBINED_ROWS", 3)
    texts = ["a b c a b d", "a b c", "x a b c", "a b c a b c", None, "a"]
    for far in (0, 2 ** 40):
        docs = spark.createDataFrame([(i + far, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
        plain, dealt = (N.ngram_fit(docs, F.col("text"), F.col("id"), by_state=b) for b in (False, True))
        assert plain.dtypes == dealt.dtypes
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect())) != []
        best = N.ngram_next(dealt)
        assert sorted(map(tuple, best.collect())) == sorted(map(tuple, N.ngram_next(plain).collect()))
    docs = spark.range(3).select("id", F.lit("a b c d").alias("text"))
    plan = N.ngram_next(N.ngram_fit(docs, F.col("text"), F.col("id"), by_state=True))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


@pytest.mark.parametrize("most", [0, 3, 1024])
def test_walks_read_the_states_they_reach(spark, model, most):
    best = N.ngram_next(model)
    table = {r["state"]: r["next"] for r in best.collect()}
    prompts = ["a b", "x y", "y z", "q q", "nothing here", "short", "", "E F A B"]
    df = spark.createDataFrame(list(enumerate(prompts)), "id long, text string")
    got = N.ngram_generate(df, "text", "id", best, max_new_tokens=13, max_broadcast_bytes=0, most_looked_up=most)
    assert {r["id"]: r["text"] for r in got.collect()} == {i: walked(table, p, 13) for i, p in enumerate(prompts)}
    stored, parts = N.stored_by_state(best)
    starts = N.few_states(df.select(N.prompt_state(F.col("text"), 2).alias("s")).filter("s = 'x\x1fy'"), "s", parts, 5)
    near = N.reachable(stored, parts, starts, 2, 13, 5)
    assert [r["state"] for r in near.collect()] == ["x\x1fy"] and best.count() > 5
    assert N.reachable(stored, parts, starts, 2, 13, 0) is None
    # one hash of many: the other folders are not opened
    one = N.looked_up(stored, starts)
    assert len({f for f in one.select("_metadata.file_path").distinct().collect()}) == 1


def test_no_large_table_is_broadcast():
    # the driver of the check has a heap of 750 MB, and holds a broadcast table several times over
    assert N.MAX_BROADCAST_BYTES <= 16 * 1024 ** 2


@pytest.mark.parametrize("inline, most", [(1, 0), (1, 1024), (1024, 2), (1024, 1024)])
def test_sampling_from_states_looked_up(spark, model, inline, most):
    table: dict = {}
    for r in sorted(model.collect(), key=lambda r: (r["first_doc"], r["first_pos"])):
        table.setdefault(r["state"], {})[r["next"]] = r["cnt"]
    prompts = spark.createDataFrame([(k, "a b") for k in range(9)] + [(98, "x y"), (99, "b zzz"), (100, "a")],
                                    "id long, text string")
    got = N.ngram_sample(prompts, "text", "id", model, max_new_tokens=6, inline=inline, max_broadcast_bytes=0,
                         most_looked_up=most).collect()
    want = {k: " ".join(drawn(table, ["a", "b"], k, 6)) for k in range(9)}
    assert {r["id"]: r["text"] for r in got} == want | {98: " ".join(drawn(table, ["x", "y"], 98, 6)), 99: "", 100: None}


def test_ranked_scores_of_one_product(spark):
    rng = np.random.default_rng(7)
    x, w, labels = rng.normal(size=(50, 4)), rng.normal(size=(4, 3)), ["a", "b", "c"]
    w[:, 2] = w[:, 1]   # b and c tie
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)] + [(50, None)], "i long, x array<double>")
    got = df.select("i", TB.classify(F.col("x"), w, labels).alias("r"))
    assert got.schema["r"].dataType.simpleString() == "array<struct<label:string,score:double>>"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "zip_with" not in plan
    for row in got.collect():
        if row["i"] == 50:
            assert row["r"] is None
            continue
        e = np.exp(x[row["i"]] @ w)
        want = sorted(zip(labels, e / e.sum()), key=lambda t: -t[1])
        assert [t["label"] for t in row["r"]] == [t[0] for t in want]
        assert np.allclose([t["score"] for t in row["r"]], [t[1] for t in want])


def test_stored_blocks_are_small(spark):
    rows = [([float(i), 1.0, 2.0], float(i), i % 2 == 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "x array<double>, y double, fit boolean").repartition(2)
    with TB.StoredBlocks(df, 3) as blocks:
        assert blocks.rows.agg(F.max(F.octet_length("x"))).first()[0] <= TB.BLOCK_BYTES
        got = blocks.total(4, lambda x, y, fit: np.array([x[:, 0].sum(), y[fit].sum(), len(y), x.shape[0] <= TB.BLOCK_ROWS]))
    assert got[:3].tolist() == [sum(range(5000)), sum(range(0, 5000, 2)), 5000] and got[3] >= 2
    with TB.StoredBlocks(df.limit(0), 3) as blocks:
        assert blocks.total(1, lambda x, y, fit: np.ones(1)).tolist() == [0.0]


def test_counts_only_are_the_same_in_bounded_runs(spark, monkeypatch):
    monkeypatch.setattr(N, "COMBINED_ROWS", 3)
    texts = ["a b c a b d", "a b c", "x a b c", "a b c a b c", None, "a", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    plain, counts = (N.ngram_fit(docs, F.col("text"), F.col("id"), counts_only=c) for c in (False, True))
    plan = counts._jdf.queryExecution().executedPlan().toString()   # before it runs
    assert counts.dtypes == plain.select("state", "next", "cnt").dtypes
    assert sorted(map(tuple, counts.collect())) == sorted(tuple(r)[:3] for r in plain.collect()) != []
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")   # counted before the shuffle
