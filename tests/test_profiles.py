"""Kinds of open records, previews that stop early, and fingerprints."""

from __future__ import annotations

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sieveworks.plans import fingerprint as FP
from sieveworks.plans.prepare import _first_rows, preview, preview_removed
from sieveworks.plans.profile import infer_types, profile_columns, profile_records, recommend_cleanup, suggested_fields
from sieveworks.sources.readers import read_records

RECORDS = [{"a": 1, "b": None}, {"a": "t", "b": 1.5, "c": " "}, {"a": True}, {"a": 2 ** 70, "c": "é" * 4}, {"a": [1], "c": 1e300},
           {"a": {"x": 1}, "b": 1.0, "d": 0}]


def plain_profile(records):
    columns, out = [], {}
    for r in records:
        columns += [k for k in r if k not in columns]
        for k in columns:
            v = r.get(k)
            kind = next(n for n, t in (("null", type(None)), ("boolean", bool), ("integer", int), ("float", float),
                                       ("array", list), ("object", dict), ("string", str)) if isinstance(v, t))
            p = out.setdefault(k, {"types": set(), "nulls": 0, "empty": 0, "texts": []})
            p["types"].add(kind)
            p["nulls"] += v is None
            if isinstance(v, str):
                p["empty"] += not v.strip()
                p["texts"].append(len(v))
    return {k: (sorted(p["types"]), p["nulls"], p["empty"], min(p["texts"], default=None), max(p["texts"], default=None),
                round(sum(p["texts"]) / len(p["texts"]), 2) if p["texts"] else None) for k, p in out.items()}


def test_record_kinds_as_a_plain_loop_finds_them(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\ufeff" + "\n\n".join(json.dumps(r, ensure_ascii=False) for r in RECORDS) + "\n")
    records = read_records(spark, str(path))
    got = {r["column"]: (r["types"], r["null_count"], r["empty_count"], r["minimum_text_length"],
                         r["maximum_text_length"], r["average_text_length"]) for r in profile_records(records).collect()}
    assert got == plain_profile(RECORDS)
    assert {r["column"]: r["types"] for r in infer_types(records).collect()}["a"] == \
        "array,boolean,integer,object,string"


def test_mixed_column_and_bad_lines(spark, tmp_path):
    three = spark.createDataFrame([('{"x": 1}',), ('{"x": "t"}',), ('{"x": true}',)], "j string")
    column = three.select(F.variant_get(F.parse_json("j"), "$.x", "variant").alias("x"))
    assert profile_columns(column).first()["types"] == ["boolean", "integer", "string"]
    path = tmp_path / "bad.jsonl"
    path.write_text('{"a": 1}\n[1, 2]\n')
    with pytest.raises(Exception, match="Not a JSON object"):
        read_records(spark, str(path)).collect()
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n")
    assert profile_records(read_records(spark, str(empty))).collect() == []


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """40 files of 5 rows; all but the first 12 can't be read."""
    out = str(tmp_path_factory.mktemp("many files") / "t")
    rows = spark.range(0, 200, 1, 40).select(F.col("id"), F.concat(F.lit("text "), F.col("id") % 70).alias("text"))
    rows.write.parquet(out)
    schema = spark.read.parquet(out).schema
    for f in sorted(glob.glob(out + "/part-*"))[12:]:
        os.chmod(f, 0o644)
        open(f, "wb").write(b"no parquet")
    for f in glob.glob(out + "/.*.crc"):
        open(f, "wb").close()
        os.remove(f)
    return spark.read.schema(schema).parquet(out)


def test_preview_reads_the_first_files_only(spark, many_files):
    ops = [{"type": "filter_numeric", "config": {"field": "id", "minimum": 7}}]
    rows = preview(many_files, ops, "classification", {"text": "text", "label": "id"}).collect()
    assert [r["row"] for r in rows] == list(range(8, 28)) and rows[0]["output"]["label"] == 7
    assert rows[3]["source"]["text"] == "text 10" and rows[0]["findings"] == []
    assert preview_removed(many_files, ops).first()["removed"] == 7
    found = _first_rows(many_files, lambda run: run.withColumn("__sw_sn", F.col("id") % 5 + 1), False, 20)
    assert found.scanned <= 35


def test_preview_carries_what_it_has_seen(spark, tmp_path):
    out = str(tmp_path / "t")
    (spark.range(0, 60, 1, 12).select((F.col("id") % 7).cast("string").alias("text"), F.lit("x").alias("label"))
     .write.parquet(out))
    source = spark.read.parquet(out)
    ops = [{"type": "remove_duplicates"}]
    rows = preview(source, ops, "classification", {"text": "text", "label": "label"}, limit=6).collect()
    assert [(r["row"], r["output"]["text"]) for r in rows] == [(i + 1, str(i)) for i in range(6)]
    rows = preview(source, ops, "classification", {"text": "text", "label": "label"}, limit=20).collect()
    assert len(rows) == 7
    assert preview_removed(source, ops, 20, "classification", {"text": "text", "label": "label"}).first()[0] == 53
    assert preview_removed(source, ops, 7, "classification", {"text": "text", "label": "label"}).first()[0] == 0
    shown = preview(source, [], "classification", {"text": "nothing", "label": "label"}, limit=2).collect()
    assert [f["row"] for r in shown for f in r["findings"]] == [1, 2]


def plain_fingerprint(lines, digits):
    counts = {}
    for line in lines:
        h = hashlib.sha256(line.encode()).hexdigest()
        counts[h] = counts.get(h, 0) + 1
    buckets = {}
    for h in sorted(counts):
        buckets.setdefault(h[:digits], []).append(f"{h}:{counts[h]}")
    level = {b: hashlib.sha256(",".join(e).encode()).hexdigest() for b, e in buckets.items()}
    while digits > 0:
        digits -= 2
        above = {}
        for b in sorted(level):
            above.setdefault(b[:digits], []).append(f"{b}:{level[b]}")
        level = {b: hashlib.sha256(",".join(e).encode()).hexdigest() for b, e in above.items()}
    return level.get("", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("digits", [None, 0, 2, 4])
def test_fingerprint_of_a_multiset(spark, digits):
    lines = [f"line {i % 90}" for i in range(200)] + [""] * 50
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    want = plain_fingerprint(lines, 0 if digits is None else digits)
    assert FP.content_fingerprint(df, F.col("line"), digits) == want
    assert FP.content_fingerprint(df.orderBy(F.rand(3)).repartition(7), F.col("line"), digits) == want
    assert FP.content_fingerprint(df.limit(249), F.col("line"), digits) != want
    assert FP.content_fingerprint(df.limit(0), F.col("line"), digits) == hashlib.sha256(b"").hexdigest()


def test_fingerprint_follows_updates_by_bucket(spark):
    def lines(a, b):
        return spark.range(a, b).select(F.col("id").cast("string").alias("line"))

    counts = FP.line_counts(lines(0, 500), F.col("line"))
    buckets = FP.fingerprint_buckets(counts, 2)
    added = FP.line_counts(lines(490, 503), F.col("line"))
    removed = FP.line_counts(lines(0, 4), F.col("line")).withColumn("n", -F.col("n"))
    change = added.unionByName(removed)
    now = lines(4, 500).union(lines(490, 503))
    after = FP.update_buckets(buckets, counts, change, 2)
    assert FP.fingerprint_root(after, 2) == FP.content_fingerprint(now, F.col("line"), 2)
    assert after.agg(F.sum("lines")).first()[0] == 509


def looped_resize(img, width, height):
    """Bicubic resampling pixel by pixel, across and then down."""
    def kernel(x):
        x = abs(x)
        return 1.5 * x ** 3 - 2.5 * x ** 2 + 1 if x < 1 else -0.5 * x ** 3 + 2.5 * x ** 2 - 4 * x + 2 if x < 2 else 0

    def axis(line, target):
        out, scale = [], len(line) / target
        wide = max(scale, 1.0)
        for o in range(target):
            center = (o + 0.5) * scale
            at = range(max(0, int(center - 2 * wide + 0.5)), min(len(line), int(center + 2 * wide + 0.5)))
            w = [kernel((i - center + 0.5) / wide) for i in at]
            k = [int(x / sum(w) * 2 ** 22 + (0.5 if x >= 0 else -0.5)) for x in w]
            out.append(min(255, max(0, (sum(a * line[i] for a, i in zip(k, at)) + 2 ** 21) >> 22)))
        return out
    rows = [axis(r, width) for r in img] if len(img[0]) != width else img
    columns = [axis(c, height) for c in zip(*rows)] if len(rows) != height else list(zip(*rows))
    return [list(r) for r in zip(*columns)]


@pytest.mark.parametrize("size", [(7, 5, 3, 9), (13, 4, 4, 4), (1, 1, 6, 5), (9, 17, 2, 1), (16, 16, 16, 16), (3, 31, 31, 3)])
def test_bicubic_equals_a_double_loop(size):
    import numpy as np

    from sieveworks.sources.images import resize_bicubic

    h, w, width, height = size
    img = np.random.default_rng(h * w).integers(0, 256, (h, w, 3))
    img[0, 0] = [0, 255, 255]
    got = resize_bicubic(img.astype(np.uint8), width, height)
    for c in range(3):
        assert got[..., c].tolist() == looped_resize(img[..., c].tolist(), width, height)


def test_recommendations_tell_what_they_found(spark):
    df = spark.createDataFrame([("a <b>x</b>", 1), ("a <b>x</b>", 1), (None, 2)], "Story string, n int")
    images = spark.createDataFrame([(3,), (-1,), (None,)], "height int")
    got = {r["title"]: r for r in recommend_cleanup(df, images).collect()}
    assert got["Remove duplicate examples"]["affected"] == 1 and got["Remove duplicate examples"]["auto_applicable"]
    assert got["Strip markup"]["detail"] and got["Strip markup"]["affected"] is None
    assert got["Repair unreadable images"]["affected"] == 1 and not got["Repair unreadable images"]["auto_applicable"]
    assert got["Few rows"]["detail"].startswith("3 rows") and "Name the input columns" in got
    clean = spark.range(25).select(F.concat(F.lit("t"), "id").alias("text"))
    assert [r["title"] for r in recommend_cleanup(clean).collect()] == ["Nothing to clean up"]
    roles = {r["role"]: r["columns"] for r in suggested_fields(df).collect()}
    assert roles["response"] == ["Story"] and roles["text"] == []
