"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sieveworks.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, nth int, fault int"


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying every audit in a best-first search."""
    heap = [(0, "", "", 0, ())]
    done = set()
    while heap:
        cost, audit, roles, i, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        key = (roles if len(roles) < 2 else roles[-1], i)
        if (key, audit) in done or len(audit) > len(rows) + 4:
            continue
        done.add((key, audit))
        following = ["u", "s"] if not roles else ["a"] if roles[-1] == "u" else ["u"]
        for r in set(following) - {"s"}:
            name = {"u": "user", "a": "assistant"}[r]
            heapq.heappush(heap, (cost + 5, audit + "I", roles + r, i, lines + (f"{name}:",)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", roles, i + 1, lines))
            if fault not in ("blank", "duplicate"):
                price = cost + (5 if fault == "truncated" else 0)
                if role[:1] in following:
                    heapq.heappush(heap, (price, audit + "K", roles + role[0], i + 1, lines + (f"{role}:{text}",)))
                for r in set(following) - {"s"}:
                    name = {"u": "user", "a": "assistant"}[r]
                    heapq.heappush(heap, (price + 1, audit + "R", roles + r, i + 1, lines + (f"{name}:{text}",)))
    raise AssertionError("no way")


def brute(rows):
    out = []
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in after if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, found = set(), []
        for _, _, role, text in mine:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else \
                "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            found.append((role, text, fault))
        count = {f: sum(x[2] == f for x in found) for f in ("blank", "duplicate", "truncated")}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        cost, audit, lines = cheapest(found)
        out.append((conv, gaps, *count.values(), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(session, rows, spill=repair.SPILL_BYTES):
    df = session.createDataFrame(rows, SCHEMA).repartition(3)
    return repair.summary(repair.damaged(df), spill_bytes=spill)


def rows_of(seed, n):
    rng = random.Random(seed)
    texts = ["One. ", "two!", "three", "", " \t", "four?\n", None, "five…", "è.", "One. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "ua"]
    return [(rng.choice([None, *range(n // 5)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts),
             "x", 1, 2) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(session, seed):
    rows = rows_of(seed, 150)
    got = sorted([tuple(r) for r in made(session, rows).collect()], key=repr)
    assert got == brute(rows)


def test_steps_equal_the_search_on_every_short_conversation():
    step = repair.Steps()
    kinds = {"": repair.FINE, "T": repair.TRUNCATED, "B": repair.GONE}
    names = {"": None, "T": "truncated", "B": "blank"}
    rows = [(r, k) for r in ("system", "user", "assistant", "x") for k in kinds]
    for n in range(4):
        for chosen in itertools.product(rows, repeat=n):
            c = repair.Conversation(1, step, 1 << 20)
            for i, (role, kind) in enumerate(chosen):
                c.add(i, role, f"t{i}", kind)
            cost, audit, lines = cheapest([(role, f"t{i}", names[kind]) for i, (role, kind) in enumerate(chosen)])
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            assert c.result()[5:] == (cost, audit, digest), chosen


def test_giant_conversation_over_many_batches_spills(session):
    roles = ["user", "assistant"]
    rows = [(1, i, roles[i % 2], f"text {i} é" + ("." if i % 7 else ""), "", 0, 0) for i in range(6000)]
    rows += [(c, 1, "user", "hi.", "", 0, 0) for c in range(2, 40)]
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        small = sorted(map(tuple, made(session, rows, spill=100).collect()))
        lines = repair.repaired(repair.damaged(session.createDataFrame(rows, SCHEMA)), spill_bytes=100)
        text = lines.filter("conv_id = 1").orderBy("position").collect()
    finally:
        session.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == sorted(map(tuple, made(session, rows).collect())) and len(small) == 39
    whole = "\n".join(f"{r['role']}:{r['text']}" for r in text)
    assert hashlib.sha256(whole.encode()).hexdigest() == small[0][-1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in text))


def test_spill_reads_both_ways():
    data = bytes(range(256)) * 5
    for most in (10, 10_000):
        spill = repair.Spill(most)
        for at in range(0, len(data), 4):
            spill.append(data[at:at + 4])
        assert b"".join(reversed(list(spill.backwards(64)))) == data
        assert spill.forwards().read() == data


def test_nothing_left_and_empty_table(session):
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "a.", "", 0, 0)]
    assert [tuple(r) for r in made(session, rows).collect()] == [
        (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert made(session, rows[:0]).collect() == []


def test_one_exchange(session):
    plan = made(session, rows_of(1, 20))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_wide_turns_and_hot_conversation(session):
    rows = [(1, -2 ** 63, "user", "a.", "", 0, 0), (1, 2 ** 63 - 1, "assistant", "b.", "", 0, 0)]
    assert made(session, rows).first()["gaps"] in (0, 2 ** 63 - 1)
    same = [(1, 3, "user", "same.", "", 0, 0)] * 500
    got = made(session, same).first()
    assert got["duplicate"] == 500 * (1 + (zlib.crc32(b"1:3") % 20 == 3)) - 1 or zlib.crc32(b"1:3") % 20 in (0, 1)


def test_other_id_types(session):
    df = session.createDataFrame([("a", 1, "user", "x.", "", 0, 0), (None, 1, "user", "x.", "", 0, 0)],
                                 SCHEMA.replace("conv_id long", "conv_id string"))
    got = repair.summary(repair.damaged(df))
    assert dict(got.dtypes)["conv_id"] == "string" and {r["conv_id"] for r in got.collect()} == {"a", None}
    assert got.select(F.max("gaps")).first()[0] == 0
