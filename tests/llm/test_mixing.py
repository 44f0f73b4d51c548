from __future__ import annotations

import math
import re

import pytest

from sieveworks.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        heavy = sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and left * weight[s] / heavy > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else left * weight[s] / heavy for s in names}
        capped |= more


def run(session, rows):
    return mixing.mix(session.createDataFrame([(i, t, s, "x") for i, t, s in rows], SCHEMA)).collect()


@pytest.mark.parametrize("big", [1, 40])
def test_targets_and_taken(session, big):
    rows = [(i, "wörd " * (1 + i % 7 * big), ["b", "a", "é", "Z", None][i % 5 if i % 3 else 0]) for i in range(400)]
    got = run(session, rows)
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        by[s] = by.get(s, 0) + size[i]
    want = targets(by)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    for s in by:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - want[s]) <= max(size.values()) / 2 + 1e-6
        copies = {r["copies"] for r in got if r["source"] == s}
        assert copies <= {math.floor(want[s] / by[s]), math.floor(want[s] / by[s]) + 1}
    assert sorted(map(repr, run(session, rows))) == sorted(map(repr, got))


def test_quality_goes_first(session):
    rows = [(i, "plain words here " * 5 if i % 2 else "## $$ %% !! ** && " * 5, "abc"[i % 3]) for i in range(1500)]
    got = [r for r in run(session, rows) if r["source"] == "c"]   # weight 1: a part of one epoch
    share = {q: sum(r["copies"] for r in got if r["doc_id"] % 2 == q) for q in (0, 1)}
    assert share[1] > 1.3 * share[0]


def test_odd_rows(session):
    rows = [(1, None, "a"), (2, "", "a"), (None, "one two", "b"), (3, "one", None), (3, "one", None), (4, "x" * 200_000, "b"),
            (5, " \t\n", "c")]
    got = {(r["doc_id"], r["source"]): r for r in run(session, rows)}
    assert got[(1, "a")]["taken"] == got[(2, "a")]["taken"] == got[(5, "c")]["taken"] == 0
    assert got[(4, "b")]["size"] == 1 and got[(None, "b")]["size"] == 2
    assert run(session, []) == []
    assert [r["taken"] for r in run(session, [(1, None, None)])] == [0]
    many = run(session, [(1, "a b", "s")] * 3000 + [(i, "a b c", "t") for i in range(2, 900)])
    assert len(many) == 3898
