from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sieveworks.llm import chunks

SCHEMA = "doc_id long, text string, n_bytes string, off int"


def slow_ends(data):
    """The textbook loop: one byte at a time."""
    ends, at, h = [], 0, 0
    for i, byte in enumerate(data):
        h = (2 * h + int(chunks.GEAR[byte])) % 2 ** 32
        boundary = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
        while i + 1 - at > chunks.MAX_CHUNK:
            cut = at + chunks.MAX_CHUNK
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            at = cut
        if boundary and h >> (32 - chunks.CUT_BITS) == 0 and i + 1 - at >= chunks.MIN_CHUNK:
            ends.append(i + 1)
            at = i + 1
    if at < len(data):
        ends.append(len(data))
    return ends


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=900), st.integers(1, 4))
def test_ends_equal_the_rolling_loop(text, times):
    data = (text * times).encode()
    ends = chunks.chunk_ends(data)
    assert ends == slow_ends(data)
    start = 0
    for end in ends:
        data[start:end].decode()
        assert 0 < end - start <= chunks.MAX_CHUNK
        start = end
    assert start == len(data)


def brute(rows):
    seen, spans = {}, {}
    order = sorted({(i is None, i or 0, t) for i, t in rows if t}, key=lambda r: r[:2])
    for none, i, t in order:
        data, start = t.encode(), 0
        for end in slow_ends(data):
            piece = data[start:end]
            if piece in seen:
                mine = spans.setdefault((none, i, t), [])
                if mine and mine[-1][1] == start:
                    mine[-1][1] = end
                else:
                    mine.append([start, end])
            seen.setdefault(piece, True)
            start = end
    out = []
    for i, t in rows:
        data = (t or "").encode()
        cut = [s for s in spans.get((i is None, i or 0, t), []) if s[1] - s[0] >= chunks.MIN_RUN]
        for s, e in reversed(cut):
            data = data[:s] + data[e:]
        out.append((i, data.decode() if t is not None else None, len((t or "").encode()), sum(e - s for s, e in cut),
                    len(cut)))
    return sorted(out, key=repr)


def run(session, rows):
    df = session.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = chunks.remove_repeated_chunks(df)
    assert set(got.columns) == {"doc_id", "text", "off", "n_bytes", "n_removed", "n_spans"}
    return sorted(((r["doc_id"], r["text"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()), key=repr)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 9))) for _ in range(n))


def test_against_brute_force_and_shared_passages(session):
    rng = random.Random(1)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, rng.randint(5, 150))) for i in range(80)]
    rows += [(100 + i, sentence(rng, 20 + i % 9) + " " + passage + " " + sentence(rng, 15)) for i in range(150)]
    rows += [(300 + i, rows[3][1]) for i in range(5)]
    got = run(session, rows)
    assert got == brute(rows)
    removed = {r[0]: r[3] for r in got}
    assert all(removed[i] == 0 for i in range(80))
    assert all(removed[100 + i] > 0 for i in range(1, 150))


def test_odd_rows(session):
    rng = random.Random(2)
    long = sentence(rng, 200)
    rows = [(1, None), (2, ""), (None, long), (3, long), (4, long), (4, long), (5, "é" * 3000), (6, "short"),
            (7, "short"), (8, "x" * 100_000)]
    got = run(session, rows)
    assert got == brute(rows)
    assert [r for r in got if r[0] is None][0][3] == len(long.encode()) and run(session, []) == []


def test_short_copies_of_whole_documents_go(session):
    rng = random.Random(3)
    repeated, short = sentence(rng, 8)[:40], "a short text"
    rows = [(1, short), (2, short), (3, short), (4, ""), (5, None), (6, repeated), (7, repeated), (8, short + "s")]
    df = session.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in chunks.remove_repeated_chunks(df, whole_documents=True).collect()}
    assert {i: r["text"] for i, r in got.items()} == {
        1: short, 2: "", 3: "", 4: "", 5: None, 6: repeated, 7: "", 8: short + "s"}
    assert all(r["n_left"] == 0 for r in got.values())
    long = sentence(rng, 60)
    chunk = long.encode()[:chunks.chunk_ends(long.encode())[0]]
    df = session.createDataFrame([(1, chunk.decode(), "x", 1), (2, long, "x", 1)], SCHEMA)
    left = {r["doc_id"]: r for r in chunks.remove_repeated_chunks(df, min_run=400, whole_documents=True).collect()}
    assert (left[2]["n_removed"], left[2]["n_left"]) == (0, len(chunk)) and left[1]["n_left"] == 0
