"""Best-fit-decreasing packing against a plain list version and round trips."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveworks.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, length int, ids string, __text int"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def test_tightest_window_as_a_list_would_find_it():
    rng = random.Random(4)
    for capacity in (1, 7, 64, 100):
        lengths = [rng.randint(1, capacity) for _ in range(300)]
        rooms: list[int] = []
        for need in sorted(lengths, reverse=True):
            fits = [(room, i) for i, room in enumerate(rooms) if room >= need]
            if fits:
                rooms[min(fits)[1]] -= need
            else:
                rooms.append(capacity - need)
        windows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(sum(lengths[i] for i in w) for w in windows) == sorted(capacity - r for r in rooms)
        assert sorted(i for w in windows for i in w) == list(range(300))


@pytest.mark.parametrize("least", [1, 10])
def test_closing_leaves_small_gaps_only(least):
    rng = random.Random(5)
    for n in (1, 2, 3, 40):
        items = [(i, 0, rng.randint(1, 100)) for i in range(n)]
        windows = [[x] for x in items]
        got = packing.closed([list(w) for w in windows], 100, least)
        for i, _, length in items:
            spans = sorted((s, s + m) for w in got for k, s, m in w if k == i)
            assert spans[0][0] == 0 and spans[-1][1] == length
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        totals = [sum(p[2] for p in w) for w in got]
        assert max(totals) <= 100
        assert all(100 - t < least for t in totals if packing._needs_padding(t, 100))


def texts():
    rng = random.Random(3)
    words = ["the", "dog's", "Über", "été", "12345", "we'll", "\n\n", "  ", "x" * 300, "日本語", "😀", " ", "\x1c",
             "<|endoftext|>", "...", "ՠ֋", "İ"]
    made = [" ".join(rng.choices(words, k=rng.randint(0, 400))) for _ in range(60)]
    return made + [None, "", "a " * 20_000, made[0], made[0]]


def checked(library, rows, pieces, capacity):
    of = {}
    for p in pieces:
        of.setdefault(p["doc_id"], []).append(p)
        assert 0 < p["length"] <= capacity and len(p["ids"]) == 4 * p["length"]
    for doc, text in rows:
        want, parts = ids_of(library, text), sorted(of[doc], key=lambda p: p["start"])
        assert [i for p in parts for i in np.frombuffer(p["ids"], "<u4").tolist()] == want
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        assert {p["doc_tokens"] for p in parts} == {len(want)}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
    return [sum(p["length"] for p in parts) for parts in sequences.values()]


@pytest.mark.parametrize("capacity,block", [(2048, packing.BLOCK_TOKENS), (100, 3000)])
def test_every_id_once_and_little_padding(session, library, capacity, block):
    rows = list(enumerate(texts()))
    df = session.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in rows], SCHEMA).repartition(3)
    packed = packing.pack(df, packing.share_tokenizer(session, FILE), keep=["doc_id", "__text", "LENGTH"],
                          capacity=capacity, block_tokens=block)
    assert packed.columns == ["doc_id", "__text", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    pieces = packed.collect()
    totals = checked(library, rows, pieces, capacity)
    padding = sum(capacity - t for t in totals if packing._needs_padding(t, capacity))
    assert max(totals) <= capacity and padding < packing.LEAST_CUT * len(totals)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for p in pieces:
        r = whole[p["sequence_id"]]
        assert r["ids"][4 * p["offset"]:4 * (p["offset"] + p["length"])] == p["ids"] and len(r["ids"]) == 4 * r["n_tokens"]


def test_ties_empty_table_and_other_files(session):
    shared = packing.share_tokenizer(session, FILE)
    same = session.createDataFrame([(None, "same text")] * 50, "doc_id long, text string")
    got = packing.pack(same, shared, keep=["doc_id"], capacity=8, least_cut=1).collect()
    total = sum(r["length"] for r in got)
    assert total == 50 * got[0]["doc_tokens"] and all(r["doc_id"] is None for r in got)
    assert packing.pack(same.limit(0), shared).collect() == []
    other = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(other)
    t.encode_special_tokens = True
    got = packing.pack(same.limit(1), packing.share_tokenizer(session, other), end_id=7, keep=[]).collect()
    ids = b"".join(r["ids"] for r in sorted(got, key=lambda r: r["start"]))
    assert np.frombuffer(ids, "<u4").tolist() == t.encode("same text", add_special_tokens=False).ids + [7]


def test_pieces_split_as_the_library_splits(library):
    encoder = packing.Encoder(open(FILE, encoding="utf-8").read(), 1, True)
    for c in range(0x10000):
        text = f"A{chr(c)}1{chr(c)} {chr(c)}" if not 0xD800 <= c < 0xE000 else ""
        if not packing._ELSEWHERE.search(text):
            want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert encoder.split(text) == want, hex(c)


def test_memory_is_bounded(monkeypatch):
    encoder = packing.Encoder(open(FILE, encoding="utf-8").read(), 1, True)
    want = encoder.encode(["one two three", "four five"])
    monkeypatch.setattr(packing, "MEMORY_BYTES", 200)
    assert encoder.encode(["one two three", "four five"]) == want and not encoder.known
    assert encoder.encode(["one two three", "four five"]) == want


def test_no_shuffle(session):
    docs = session.createDataFrame([(1, "a")], "doc_id long, text string")
    packed = packing.pack(docs, packing.share_tokenizer(session, FILE)).select(F.crc32("ids"))
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
