from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveworks.llm import gsaca, substrings
from sieveworks.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, kept string, n_bytes long"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-2, 3), max_size=40))
def test_suffix_array_equals_sorting(text):
    array = gsaca.suffix_array(np.array(text, dtype=np.int64))
    assert array == sorted(range(len(text)), key=lambda i: text[i:])
    got = gsaca.common_prefixes(text, array, 0)
    for r in range(1, len(text)):
        a, b, h = text[array[r]:], text[array[r - 1]:], 0
        while h < min(len(a), len(b)) and a[h] == b[h] and a[h] >= 0:
            h += 1
        assert got[r] == h


def brute(texts, length):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 2, dtype=bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        body = gone[1:-1]
        kept = bytes(np.frombuffer(raw, np.uint8)[~body]) if raw else b""
        out.append((len(raw), int(body.sum()), runs, kept))
    return out


def check(session, rows, length):
    df = session.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = substrings.remove_repeated_substrings(df, length=length)
    got = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["text"] or "")
                 for r in got.collect())
    want = sorted((repr(i), *w, t or "") for (i, t), w in zip(rows, brute([t for _, t in rows], length), strict=True))
    assert got == want


def corpus(seed, n):
    rng = random.Random(seed)

    def prose(k):
        return " ".join("".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(k))
    passages = [prose(30) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts += [p[a:len(p) - rng.randrange(len(p) // 3)], prose(rng.randint(0, 12))]
        rows.append((i, "".join(parts)))
    rows += [(1000 + i, rows[i % 7][1][:-rng.randint(1, 40)]) for i in range(20)]
    rows += [(2000, "ab" * 150), (2001, "a" * 200), (2002, "xyz" * 100 + "q" + "xyz" * 50)]
    return rows


@pytest.mark.parametrize(("length", "group"), [(40, 256), (60, 3), (33, 2)])
def test_equals_brute_force(session, monkeypatch, length, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    check(session, corpus(length, 60), length)


def test_production_length(session):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh ", k=3000))
    rows = [(i, long[rng.randrange(1500):rng.randrange(1500, 3000)]) for i in range(25)]
    rows += [(100, long[:399]), (101, long[:400]), (102, "z" * 1500), (103, "z" * 400)]
    check(session, rows, 400)


def test_odd_rows(session):
    t = "the same text that is long enough to count " * 2
    rows = [(1, None), (2, ""), (None, t), (3, t), (3, t), (4, "short"), (5, "é" * 60)]
    check(session, rows, 40)
    check(session, [(1, t + "1"), (2, "0" + t[:50])], 40)
    empty = session.createDataFrame([], SCHEMA)
    assert substrings.remove_repeated_substrings(empty).count() == 0


def test_query(session, small_dir):
    docs = session.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_suffix_dedup"](session, small_dir).collect()}
    want = brute([r["text"] for r in docs], 400)
    assert got == {r["doc_id"]: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(docs, want, strict=True)}
    assert sum(w[1] for w in want) > 0


def test_planted_passages_go_from_400_bytes_on(session):
    """Repeated passages below the contract's 400 bytes stay whole, all others go
    whole: the share caught is 0 below and 1 from there on."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzäöüß "

    def noise(n):
        text = "".join(rng.choices(letters, k=n))
        while len(text.encode()) > n:
            text = text[:-1]
        return text + "x" * (n - len(text.encode()))

    sizes = [60, 250, 399, 400, 401, 700, 2500]
    passages = [noise(n) for n in sizes]
    rows = []
    for i in range(30):
        held = passages[i % len(sizes)]
        # the bytes around a passage differ from copy to copy, so no copy grows beyond it
        copy = i // len(sizes)
        rows.append((i, f"{noise(150)}{'ABCDE'[copy]}{held}{'01234'[copy]}{noise(90)}"))
    df = session.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeated_substrings(df, length=400).collect()}
    assert got == {i: n if n >= 400 else 0 for i in got for n in [sizes[i % len(sizes)]]}
