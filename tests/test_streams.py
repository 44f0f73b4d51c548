"""Streams over several micro-batches: late clicks, bounded state, changed keys only."""

from __future__ import annotations

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from sieveworks.models.ngram import transitions
from sieveworks.streaming import streams as ST

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def add(spark, folder, name, rows, schema):
    """One file of rows; files are taken in order of their time."""
    part = f"{folder}/../{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
    os.makedirs(folder, exist_ok=True)
    [found] = glob.glob(part + "/part-*")
    target = f"{folder}/{name}.parquet"
    os.rename(found, target)
    n = len(os.listdir(folder))
    os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))


CLICKS = "user_id long, ts timestamp, event_id long, v string"


def fold(rows):
    out = {}
    for user, _, _, v in sorted(rows, key=lambda r: r[:3]):
        out[user] = None if out.get(user) == v else v
    return {(u, v) for u, v in out.items() if v}


def test_late_clicks_come_into_their_place(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    batches = [
        [(1, at(10), 1, "up"), (1, at(12), 2, "down"), (2, at(11), 3, "up"), (3, at(9), 4, "up")],
        # older than what came before: between the clicks of users 1 and 2, and before user 3's
        [(1, at(11), 5, "up"), (2, at(8), 6, "up"), (3, at(9), 0, "down")],
        # the watermark moves past all of these
        [(4, at(500), 7, "down")],
        [(1, at(501), 8, "down"), (2, at(502), 9, "up"), (4, at(499), 10, "up")],
    ]
    seen = []
    for i, rows in enumerate(batches):
        add(spark, src, f"b{i}", rows, CLICKS)
        seen += rows
        stream = spark.readStream.schema(CLICKS).parquet(src)
        got = ST.stream_toggle_ordered(stream, "30 minutes", state=state).collect()
        assert {tuple(r) for r in got} == fold(seen), i
    one = spark.readStream.schema(CLICKS).option("maxFilesPerTrigger", 1).parquet(src)
    assert {tuple(r) for r in ST.stream_toggle_ordered(one, "30 minutes").collect()} == fold(seen)


def test_watermark_keeps_the_state_small(spark, tmp_path):
    src = str(tmp_path / "in")
    kind = "k long, ts timestamp"
    for i in range(6):
        add(spark, src, f"b{i}", [(100 * i + j, at(600 * i)) for j in range(20)] + [(100 * i, at(600 * i + 1))], kind)
    add(spark, src, "b6", [(0, at(3600)), (500, at(3601))], kind)
    reports: dict[str, list] = {"exact": [], "within": []}
    exact = ST.stream_pipeline(spark, src, kind, [], ["k"], files_per_trigger=1, progress=reports["exact"])
    within = ST.stream_pipeline(spark, src, kind, [], ["k"], files_per_trigger=1, within=("ts", "10 minutes"),
                                progress=reports["within"])
    assert exact.count() == 120
    # key 0 comes back: the watermark had passed it; key 500 is of the batch before, whose times moved it only now
    assert within.count() == 121
    rows = {k: [p["stateOperators"][0]["numRowsTotal"] for p in v if p["stateOperators"]] for k, v in reports.items()}
    assert rows["exact"][-1] == 120 and max(rows["within"]) <= 60 and rows["within"][-1] < 40


DOCS = "id long, text string"


def written(folder):
    return sum(1 for f in glob.glob(folder + "/out/**/part-*.parquet", recursive=True))


@pytest.mark.parametrize("every", [2, 32])
def test_counts_write_what_changed(spark, tmp_path, every):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    texts = [" ".join(f"w{j}" for j in range(300)), "a b c d", "a b c e", "w1 w2 w3 a b c", "x y z", "a b c d"]
    for i, text in enumerate(texts):
        add(spark, src, f"b{i}", [(i, text)], DOCS)
        got = ST.stream_ngram_counts(spark.readStream.schema(DOCS).parquet(src), "text", "id", state=state,
                                     compact_every=every)
        docs = spark.createDataFrame(list(enumerate(texts[:i + 1])), DOCS)
        want = transitions(docs, F.col("text"), F.col("id")).groupBy("state", "next").agg(F.count(F.lit(1)).alias("cnt"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    epochs = spark.read.parquet(f"{state}/out").groupBy("full", "epoch").count().collect()
    sizes = {(r["full"], r["epoch"]): r["count"] for r in epochs}
    last = max(e for f, e in sizes if f == 0)
    assert sizes[0, last] == 2                      # of 300 and more
    if every == 2:
        assert min(e for _, e in sizes) > 0         # covered batches are gone
    assert ST.stream_ngram_counts(spark.readStream.schema(DOCS).parquet(src), "text", "id", state=state,
                                  compact_every=every).count() == got.count()


def test_job_states_in_steps(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    kind = "job long, status string, stage string, progress double, ts timestamp, seq long"
    batches = [[(j, "running", "s", float(j), at(j), j) for j in range(50)],
               [(3, "completed", None, 400.0, at(90), 60)], [(4, None, "t", None, at(91), 61), (99, "claimed", "s", 1.0, at(1), 2)]]
    rows = []
    for i, batch in enumerate(batches):
        add(spark, src, f"b{i}", batch, kind)
        rows += batch
        got = ST.stream_job_state(spark.readStream.schema(kind).parquet(src), state=state)
        want = ST.job_state_aggregate(spark.createDataFrame(rows, kind))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sizes = {r["epoch"]: r["count"] for r in spark.read.parquet(f"{state}/out").groupBy("epoch").count().collect()}
    assert sizes == {0: 50, 1: 1, 2: 2} and written(state) >= 3


def test_counts_keep_no_state_store(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    add(spark, src, "b0", [(i, "a b c d") for i in range(20)], DOCS)
    docs = spark.readStream.schema(DOCS).parquet(src)
    got = ST.stream_ngram_counts(docs, "text", "id", state=state)
    assert sorted(map(tuple, got.collect())) == [("a\x1fb", "c", 20), ("b\x1fc", "d", 20)]
    assert glob.glob(state + "/checkpoint/offsets/*") and not glob.glob(state + "/checkpoint/state")
    # a batch that runs again replaces its counts
    again = glob.glob(state + "/checkpoint/commits/*0")
    assert again and len(glob.glob(state + "/out/full=0/epoch=*")) == 1
    (tmp_path / "old/checkpoint/state").mkdir(parents=True)
    with pytest.raises(ValueError, match="new folder"):
        ST.stream_ngram_counts(docs, "text", "id", state=str(tmp_path / "old"))
