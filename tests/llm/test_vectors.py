from __future__ import annotations

import numpy as np
import pytest

from sieveworks.llm import ann, topk
from sieveworks.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


LIMIT = 2 ** 63 - 1


def exact(rows, k, scale=1024):
    scaled = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows]
    out = {}
    for q, v in scaled:
        scores = sorted((-max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(v, w)))), i) for i, w in scaled if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_top_k_equals_brute_force(session, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "PACK_ROWS", 7)
    rng = np.random.default_rng(int(spread * 10))
    data = rng.normal(size=(300, 6)) * np.exp(spread * rng.normal(size=(300, 1)))
    data[100:180] = data[100]   # a large group of equal vectors
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    df = session.createDataFrame([(i, v, "s", "r") for i, v in rows], SCHEMA)
    got = ranked(topk.exact_top_k(df, df.filter("vec_id % 9 = 0"), "vec_id", "embedding", k=10))
    want = exact(rows, 10)
    assert got == {q: want[q] for q in got} and len(got) == 34


def test_top_k_odd_rows(session):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (None, [1.0, 1.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [0.0, 0.0]),
            (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [-1.0, -2.0]), (7, [1.0]), (8, []), (9, [None, 1.0])]
    df = session.createDataFrame([(i, v, "s", "r") for i, v in rows], SCHEMA)
    got = ranked(topk.exact_top_k(df, df, "vec_id", "embedding", k=3))
    unit = 1024 * 1024
    assert got == {0: [(5, 5 * unit), (4, 0), (6, -5 * unit)], 5: [(0, 5 * unit), (4, 0), (6, -5 * unit)],
                   4: [(0, 0), (5, 0), (6, 0)], 6: [(4, 0), (0, -5 * unit), (5, -5 * unit)]}
    assert topk.exact_top_k(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0


def test_top_k_large_numbers(session):
    rows = [(0, [3e8, 1.0]), (1, [3e8, 2.0]), (2, [3e8, 3.0]), (3, [-3e8, 0.5])]
    df = session.createDataFrame([(i, v, "s", "r") for i, v in rows], SCHEMA)
    got = ranked(topk.exact_top_k(df, df, "vec_id", "embedding", k=2))
    assert got == exact(rows, 2)


def cosines(rows, k):
    out = {}
    for q, v in rows:
        v = np.array(v)
        found = [(-float(v @ np.array(w) / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in rows
                 if i != q and len(w) == len(v)]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in found)[:k]]
    return out


def test_neighbours_recall(session, small_dir):
    df = session.read.parquet(f"{small_dir}/embeddings.parquet")
    got = ranked(QUERIES["op10_graph_neighbours"](session, small_dir))
    want = cosines([(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()], 5)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in got]
    assert np.mean(hits) >= 0.9
    assert set(got) == {q for q in want if q % 50 == 0}


def test_neighbours_over_shards(session):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 12)))]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]   # copies of one vector
    df = session.createDataFrame([(i, v, "s", "r") for i, v in rows], SCHEMA)
    index = ann.build_index(df, "vec_id", "embedding", shard_rows=250)
    assert index.count() == len(rows)
    asked = df.filter("vec_id % 20 = 0 or vec_id = 7")
    got = ranked(ann.search(index, asked, "vec_id", "embedding"))
    want = cosines(rows, 5)
    assert [i for i, _ in got[7]] == [1000, 1001, 1002, 1003, 1004]
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in got]) >= 0.9
    for q, found in got.items():
        assert [round(s, 9) for _, s in found] == sorted((round(s, 9) for _, s in found), reverse=True)


def test_neighbours_odd_rows(session):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, []),
            (5, [2.0, 0.0]), (5, [2.0, 0.0]), (6, [1e200, 1e200]), (7, [1.0, 1.0, 1.0])]
    df = session.createDataFrame([(i, v, "s", "r") for i, v in rows], SCHEMA)
    got = ranked(ann.nearest(df, df, "vec_id", "embedding"))
    assert {q: [i for i, _ in f] for q, f in got.items()} == {0: [5, 6], 5: [0, 6], 6: [0, 5]}
    assert got[0][0][1] == pytest.approx(1.0) and got[0][1][1] == pytest.approx(0.5 ** 0.5)
    assert ann.nearest(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0
