from __future__ import annotations

from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from sieveworks.llm import bpe
from sieveworks.llm.queries import TOKENIZER
from sieveworks.session import materialize

from . import test_lines, test_mixing, test_near_dup


def staged(session, docs, sf_dir):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(session, out[-1], sf_dir), "test-stage"))
    return out


def check_stages(frames):
    docs, clean, cut, single, mixed, coded = frames
    columns = docs.columns
    for df in (clean, cut, single, mixed):
        assert df.columns == columns

    def rows(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]
    before, after = rows(clean), rows(cut)
    assert sorted(after, key=repr) == sorted([(i, t) for i, t, _, _ in test_lines.brute(before)], key=repr)
    groups, kept = test_near_dup.brute(after), rows(single)
    assert len(kept) == len(groups) and Counter(kept) <= Counter(after)
    assert sorted((-1 if i is None else i) for i, _ in kept) == sorted(
        min(x for x in g if x >= 0 or max(g) < 0) for g in groups)
    times = Counter((r["doc_id"], r["source"]) for r in mixed.collect())
    assert set(times.values()) <= {1, 2}
    size = {(r["doc_id"], r["source"]): len((r["text"] or "").split()) for r in single.collect()}
    by = {}
    for (i, s), n in size.items():
        by[s] = by.get(s, 0) + n
    want = test_mixing.targets(by) if sum(by.values()) else {}
    for s in want:
        taken = sum(n * size[k] for k, n in times.items() if k[1] == s)
        assert abs(taken - want[s]) <= max(n for k, n in size.items() if k[1] == s) / 2 + 1
    peer = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.read_ranks(public_tokenizers.path(TOKENIZER)))
    for r in coded.collect():
        assert r["token_ids"] == peer.encode_ordinary(r["text"] or "")
    assert coded.count() == mixed.count()


def test_stages_on_the_small_tables(session, small_dir):
    docs = session.read.parquet(f"{small_dir}/documents.parquet")
    frames = staged(session, docs, small_dir)
    check_stages(frames)
    labels = dict(session.read.parquet(f"{small_dir}/labels.parquet").select("doc_id", "toxic").collect())
    left = {r["doc_id"] for r in frames[1].collect()}
    told = [(r["doc_id"] in left) == (labels[r["doc_id"]] == 0) for r in docs.collect() if r["doc_id"] in labels]
    assert sum(told) >= 0.95 * len(told)   # a dozen toxic rows to learn from


def test_odd_rows_pass_every_stage(session, small_dir):
    docs = session.read.parquet(f"{small_dir}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "a b c d e f", "en", None, 1), (90001, "", "en", "s", 0),
           (90002, None, "en", "s", 0), (90003, "word " * 50_000, "en", "s", 5), (90003, "word " * 50_000, "en", "s", 5)]
    more = docs.limit(60).unionByName(session.createDataFrame(odd, docs.schema))
    clash = {"lang": "score", "n_chars": "target"}
    more = materialize(more.withColumnsRenamed(clash), "odd-docs")
    check_stages(staged(session, more, small_dir))


def test_empty_table(session, small_dir):
    docs = session.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    assert [df.count() for df in staged(session, docs, small_dir)] == [0] * 6
