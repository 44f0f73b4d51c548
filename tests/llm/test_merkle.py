"""Merkle manifests against a plain list version."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sieveworks.llm import merkle

SCHEMA = "id long, lang string, n long, text string, leaf string, item int, grp string, __other string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a list of nodes and each node's steps."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for i, at in enumerate(where):
            run, place = runs[at // fanout], at % fanout
            paths[i].append(("".join(run[:place]), "".join(run[place + 1:])))
            where[i] = at // fanout
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows, tampered, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for g in order:
        inside = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r[:4])))
        below[g] = (inside, *climb([leaf_of(r[:4]) for r in inside], fanout))
    root, above = climb([below[g][1] for g in order], fanout)
    out = []
    for g, up in zip(order, above):
        inside, subroot, paths = below[g]
        for r, path in zip(inside, paths):
            node = leaf_of(tampered(r[:4]))
            for left, right in path + up:
                node = h(left, node, right)
            out.append((r[0], leaf_of(r[:4]), subroot, root, h(*[a + b for a, b in path + up]), node, node == root))
    return sorted(out, key=repr)


def made(session, rows, fanout=2, height=2):
    df = session.createDataFrame(rows, SCHEMA).repartition(3)
    more = F.when(F.col("id") % 5 == 0, F.col("n") + 1).otherwise(F.col("n"))
    got = merkle.manifest(df, ["id", "lang", "n", "text"], "lang", "id", tampered={"n": more},
                          fanout=fanout, height=height)
    return got.withColumn("proof", merkle.proof_digest(F.col("proof")))


def tampered(r):
    return (r[0], r[1], r[2] + 1 if r[2] is not None and r[0] is not None and r[0] % 5 == 0 else r[2], r[3])


def rows_of(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    extra = ("x", 1, "y", "z")
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "en", "en", "en", "é", "z", "Z", "", "one"]),
             rng.choice([None, 1, 2 ** 62]), rng.choice([None, "", "a:b", "ü" * 50]), *extra) for _ in range(n)]
    return rows + rows[:3] * 3 + [(7, "alone", 1, "w" * 100_000, *extra)]


@pytest.mark.parametrize("fanout,height,n", [(2, 2, 70), (3, 2, 45), (2, 8, 30), (4, 1, 40)])
def test_equals_brute_force(session, fanout, height, n):
    rows = rows_of(n, n)
    got = made(session, rows, fanout, height).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, tampered, fanout)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_small_and_empty(session):
    one = [(5, None, None, None, "", 0, "", "")]
    assert sorted([tuple(r) for r in made(session, one).collect()], key=repr) == brute(one, tampered, 2)
    assert made(session, one).first()["verified"]           # a null stays what it is
    empty = made(session, one).limit(0)
    assert made(session, one[:0]).collect() == [] and empty.columns == \
        ["id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]


def test_hot_group_over_many_partitions(session):
    rows = [(i // 2, "en" if i % 3 else None, i, "t", "", 0, "", "") for i in range(400)]
    df = session.createDataFrame(rows, SCHEMA)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = made(session, rows, 2, 3).collect()
        parts = merkle._ranked(df.select(F.col("lang").alias("grp"), F.col("id").alias("ord"),
                                         F.col("text").alias("hash"), F.struct("n").alias("item")))[0]
        ranks = {g: sorted(r["rank"] for r in parts.collect() if r["grp"] == g) for g in (None, "en")}
    finally:
        session.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, tampered, 2)
    assert all(r == list(range(len(r))) for r in ranks.values())


def test_no_join_in_the_plan(session):
    plan = made(session, rows_of(1, 20))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
