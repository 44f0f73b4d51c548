from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.llm import bpe
from sieveworks.llm.queries import QUERIES, TOKENIZER

RANKS = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
VOCABULARY = bpe.Vocabulary(RANKS)
CODEC = bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)
PEER = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_and_round_trip(text):
    ids = CODEC.encode(text).tolist()
    assert ids == PEER.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(max_size=30), st.data())
def test_append_and_edit_equal_a_fresh_table(first, more, data):
    grown = bpe.PrefixTable(VOCABULARY, first).append(more)
    assert grown.last == bpe.PrefixTable(VOCABULARY, first + more).last
    start = data.draw(st.integers(0, len(first)))
    stop = data.draw(st.integers(start, len(first)))
    edited = bpe.PrefixTable(VOCABULARY, first)
    edited.replace(start, stop, more)
    assert edited.data == first[:start] + more + first[stop:]
    assert edited.last == bpe.PrefixTable(VOCABULARY, edited.data).last


def test_edit_recomputes_near_the_edit_only():
    data = b"the quick brown fox jumps over the lazy dog " * 400
    table = bpe.PrefixTable(VOCABULARY, data)
    assert table.replace(9000, 9004, b"12345") < 300
    assert table.last == bpe.PrefixTable(VOCABULARY, data[:9000] + b"12345" + data[9004:]).last


def test_long_runs_and_unreachable_tokens():
    for text in ("a" * 50_000, "é" * 20_000, " " * 9_999, "ab" * 5_000 + "\n" * 77):
        assert CODEC.encode(text).tolist() == PEER.encode_ordinary(text)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xbcd": 301}
    peer = tiktoken.Encoding("p", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(bpe.Vocabulary(ranks), r"\S+")
    for text in ("abc", "xbcd", "xbcdx", "abcabc", "bcab", "aab bc abcd"):
        assert codec.encode(text).tolist() == peer.encode_ordinary(text)


def test_every_character_splits_alike():
    assert bpe.splitter(public_tokenizers.PATTERN).__name__ == "split"
    exact = regex.compile(public_tokenizers.PATTERN).findall
    for start in range(0, 0x10000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c} b{c}{c}1{c} {c}\n" for c in chars)
        assert CODEC.split(text) == exact(text)
    assert bpe.splitter(r"(?i)\w+")("Ab c") == ["Ab", "c"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=48), st.text("abé \0", min_size=1, max_size=12).map(str.encode)),
                min_size=1, max_size=40))
def test_many_tables_at_once_equal_single_ones(pieces):
    pieces = sorted(pieces)
    want = [b"".join(i.to_bytes(4, "little") for i in bpe.PrefixTable(VOCABULARY, p).ids()) for p in pieces]
    assert VOCABULARY.tables.codes(pieces) == want


def test_texts_together_and_tables_emptied(monkeypatch):
    texts = ["the quick brown fox", "", "quicker foxes jumped", "x" * 300 + " unbelievably", "der schnelle Fuchs", "the quick"] * 3
    monkeypatch.setattr(bpe, "TOGETHER", 30)
    monkeypatch.setattr(bpe, "PIECES_BYTES", 100)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 2)
    codec = bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)
    assert [ids.tolist() for ids in codec.encode_all(texts)] == [PEER.encode_ordinary(t) for t in texts]


def test_missing_byte_is_an_error():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def test_frames(session):
    ranks = bpe.share_ranks(session, public_tokenizers.path(TOKENIZER))
    rows = [(1, "a b", "x"), (None, None, "y"), (3, "", None), (3, "", None), (4, "long " * 30_000, "z")]
    df = session.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert [r["doc_id"] for r in out] == [1, None, 3, 3, 4]
    assert [bytes(r["decoded"]).decode() for r in out] == [r[1] or "" for r in rows]
    assert [r["ids"] for r in out] == [PEER.encode_ordinary(r[1] or "") for r in rows]
    empty = df.filter("doc_id > 99")
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_query_against_the_peer(session, small_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op1_byte_bpe"](session, small_dir).collect()}
    docs = session.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        ids = PEER.encode_ordinary(text)
        row = rows[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
