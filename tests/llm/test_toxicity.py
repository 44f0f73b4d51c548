from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from sieveworks.llm import toxicity
from sieveworks.llm.queries import QUERIES

SYLLABLES = ["ner", "to", "lan", "mi", "res", "cal", "ven", "dor", "ple", "sti"]


def corpus(n=600):
    rng = random.Random(2)
    bad = ["idiot", "worthless", "stupid", "trash"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "s", 0.5))
        labels.append((i, int(toxic)))
    return rows, labels


HIDDEN = {"idiot": ["1d10t", "i d i o t", "i.d.i.o.t", "idiiiiot", "!d!ot"], "worthless": ["w0rthl3ss", "wooooorthless"],
          "stupid": ["$tupid", "s t u p i d", "stuuuupid", "5tup1d"], "trash": ["tr4sh", "tr@sh", "t-r-a-s-h"]}


@pytest.fixture(scope="module")
def frames(session):
    rows, labels = corpus()
    return (session.createDataFrame(rows, "doc_id long, text string, score string, predicted double"),
            session.createDataFrame(labels, "doc_id long, toxic int"))


def test_restored_words(session, frames):
    restorer = toxicity.Restorer(toxicity.fit_char_model(frames[0], "text"))
    for word, forms in HIDDEN.items():
        for form in forms:
            assert word in restorer.words(f"ner tolan {form} mires, calven"), form
    assert restorer.words("mires calven a-b 12 34.5") >= {"mires", "calven"}
    assert restorer.words("") == set()


def test_look_alikes_at_the_ends_are_letters(session, frames):
    docs = frames[0].select("text").union(session.createDataFrame(
        [("ner asshole tolan loser mires idiot calven ass dorple " * 20,)], "text string"))
    restorer = toxicity.Restorer(toxicity.fit_char_model(docs, "text"))
    forms = {"stupid": ["$tupid", '"$tupid!"', "$$$tupid", "$.t.u.p.i.d"], "asshole": ["@sshole", "(@sshole)"],
             "loser": ["|oser"], "idiot": ["idio+", "idio+!", "!d!o+", "i d i o +", "i.d.i.o.+"],
             "ass": ["a$$", "a$$!", "(a$$)", "a $ $"]}
    for word, some in forms.items():
        for form in some:
            assert word in restorer.words(f"ner tolan {form}"), form
    assert {"mires", "calven", "dorple"} <= restorer.words("(mires) calven! |dorple|")
    assert "stupid" in restorer.words("!+!+!+!+$tupid!+!+!+!+") and restorer.words("$!" * 20_000 + "ner") >= {"ner"}


def test_long_spans_are_read_in_one_piece(frames):
    restorer = toxicity.Restorer(toxicity.fit_char_model(frames[0], "text"))
    for n in range(30):   # every place of the word in the span
        assert "worthless" in restorer.words(" ".join("m" * n + "worthless")), n
        assert "worthless" in restorer.words(".".join("stupid" * 5 + "m" * n) + ".w.o.r.t.h.l.e.s.s"), n
    assert "idiot" in restorer.words("s t u p i d " * 30_000 + "i d i o t")


def test_tokens_of_look_alikes_only(session):
    words = session.createDataFrame([("ner ass tolan losto mires ass calven " * 50,)], "text string")
    restorer = toxicity.Restorer(toxicity.fit_char_model(words, "text"))
    for form, word in {"455": "ass", "@$$": "ass", '"@55!"': "ass", "10570": "losto", "@ $ $": "ass"}.items():
        assert word in restorer.words(f"ner {form}"), form
    assert restorer.words("--- 34,5 ...") == set()
    numbers = words.union(session.createDataFrame([("ner 455 1234 77 2024 tolan 90 3 " * 200,)], "text string"))
    assert "ass" not in toxicity.Restorer(toxicity.fit_char_model(numbers, "text")).words("ner 455")


def test_every_part_of_a_long_run_is_evidence(session):
    assert not set(toxicity.features_of("x" * 5 + "a" * 20)) <= set(toxicity.features_of("x" * 5 + "a" * 11 + "b" * 9))
    assert toxicity.features_of("idiot") == ("idiot", "idio~")
    rng = random.Random(4)
    signs = [chr(c) for c in range(0x4e00, 0x4e40)]

    def sentence(*inside):
        return "".join([*rng.choices(signs, k=24), *inside, *rng.choices(signs, k=rng.randint(0, 9))])

    rows = [(i, sentence("白痴") if i % 4 == 0 else sentence()) for i in range(400)]
    docs = session.createDataFrame(rows, "doc_id long, text string")
    labels = session.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = [r for r in toxicity.score(docs, labels).collect() if r["doc_id"] >= 300]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got) >= 95


def test_hidden_words_are_scored(session, frames):
    docs, labels = frames
    forms = [f for x in HIDDEN.values() for f in x]
    hidden = [(1000 + i, f"ner tolan {f} mires calven {f} dorple", "s", 0.5) for i, f in enumerate(forms)]
    clean = [(2000 + i, f"ner tolan m1res 2nd calven (3) dorple {i} a.b.c ner-to", "s", 0.5) for i in range(20)]
    more = docs.unionByName(session.createDataFrame(hidden + clean, docs.schema))
    got = {r["doc_id"]: r for r in toxicity.score(more, labels).collect()}
    assert len(got) == 600 + len(hidden) + 20 and 0 <= min(r["score"] for r in got.values())
    assert sum(got[1000 + i]["predicted"] for i in range(len(hidden))) >= len(hidden) - 1
    assert sum(got[2000 + i]["predicted"] for i in range(20)) == 0


def test_odd_rows(session, frames):
    docs, labels = frames
    odd = session.createDataFrame([(None, None, "s", 1.0), (None, "idiot stupid", "s", 1.0), (5000, "", "s", None),
                                   (5001, "idi0t stup1d tr4sh " * 20_000, "s", None), (5002, "\x00😀 a b c d e", "s", None),
                                   (3, None, "s", None), (3, None, "s", None)], docs.schema)
    strange = labels.union(session.createDataFrame([(None, 1), (3, None), (4, 7), (0, 1)], labels.schema))
    got = toxicity.score(docs.union(odd), strange).collect()
    assert len(got) == 607 and all(0 <= r["score"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 5001)["predicted"] == 1
    only = toxicity.score(docs, labels.filter("toxic = 0")).agg(F.max("score")).first()[0]
    assert only == 0
    assert toxicity.score(docs.limit(0), labels.limit(0)).count() == 0


def test_query_held_out(session):
    path = "/root/testdata/sf0.01"
    rows = QUERIES["op4_toxicity"](session, path).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    labels = dict(session.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic").collect())
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
