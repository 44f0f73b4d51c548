from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from sieveworks.llm import near_dup
from sieveworks.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, kept string, class_id string, node string"


def bag(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def brute(rows):
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8 and root(i) != root(j):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return sorted(sorted(rows[i][0] if rows[i][0] is not None else -1 for i in g) for g in groups.values())


def grouped(out):
    rows = out.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["class_id"], []).append(r["doc_id"] if r["doc_id"] is not None else -1)
    for c, ids in groups.items():
        assert c is None or c == min(i for i in ids if i >= 0)
    return sorted(sorted(g) for g in groups.values()), rows


def edited(rng, words, share):
    words = list(words)
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
    return words


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=60)
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        if i % 5 == 0:
            words = shared + words[:60]     # a passage in common, not near duplicates
        rows.append(words)
        for _ in range(rng.randint(0, 3)):
            rows.append(edited(rng, words, rng.choice([0.005, 0.02, 0.05])))
    rows += [rows[0]] * 30
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 8])
def test_classes_equal_brute_force(session, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "LARGE", block // 2)
    rows = corpus(3)
    df = session.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    groups, out = grouped(near_dup.classes(df))
    assert groups == brute(rows)
    assert sum(r["kept"] for r in out) == len(groups)
    kept = near_dup.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_signature_is_unbiased():
    rng = np.random.default_rng(4)
    errors = []
    for trial in range(30):
        names = rng.integers(0, 2 ** 63, size=60).astype(np.uint64)
        a = rng.integers(0, 9, size=60) * (rng.random(60) < 0.8)
        b = np.where(rng.random(60) < 0.6, a, rng.integers(0, 9, size=60))
        bags = [(names[x > 0], x[x > 0]) for x in (a, b)]
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        sig = near_dup.signatures(bags, 512)
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.1


def test_odd_rows(session):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "one two"), (4, "one two"), (4, "one two"), (5, "One  TWO"),
            (6, "one two three"), (7, "x " * 30_000), (8, "x " * 29_999), (9, "y"), (None, None)]
    df = session.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    groups, out = grouped(near_dup.classes(df))
    assert groups == [[-1, 1, 2, 3], [-1, 4, 4, 5], [6], [7, 8], [9]]
    assert near_dup.deduplicate(df).count() == 5
    assert near_dup.classes(df.limit(0)).count() == 0
    alone = near_dup.classes(session.createDataFrame([(None, "only row here", "", "", "")], SCHEMA)).collect()
    assert [(r["class_id"], r["kept"]) for r in alone] == [(None, True)]


def test_large_group_of_near_copies(session):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.01))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"o{i}w{k}" for k in range(20))) for i in range(50)]
    df = session.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA).repartition(6)
    groups, _ = grouped(near_dup.classes(df))
    assert groups == brute(rows)


def test_query(session, small_dir):
    docs = session.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    groups, out = grouped(QUERIES["op8_near_duplicates"](session, small_dir))
    assert groups == brute([(r["doc_id"], r["text"]) for r in docs])
