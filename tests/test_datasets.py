"""End-to-end dataset flows on the reference's small fixtures."""

from __future__ import annotations

import io
import json
import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import functions as F

from sieveworks.plans import ordering as O
from sieveworks.plans.prepare import auto_prepare
from sieveworks.plans.profile import duplicate_count, profile_columns, recommend_cleanup
from sieveworks.plans.schemas import map_to_schema, row_findings
from sieveworks.plans.version import save_version, validate_version
from sieveworks.sinks.writers import export_csv
from sieveworks.sources.readers import blank_cells_to_empty, read_csv, read_image_archive, read_json, read_jsonl

STORIES = 'prompt,story\nMoon prompt,Moon story\nRobot prompt,Robot story\nRobot prompt,Robot story\n,Missing prompt\n'


def _write(text: str, name: str) -> str:
    d = tempfile.mkdtemp(prefix="sw-test-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_stories_profile_and_version(spark):
    path = _write(STORIES, "stories.csv")
    df = blank_cells_to_empty(read_csv(spark, path))
    assert duplicate_count(df).first()["duplicate_count"] == 1
    prof = {r["column"]: r for r in profile_columns(df).collect()}
    assert prof["prompt"]["row_count"] == 4 and prof["prompt"]["empty_count"] == 1
    root = tempfile.mkdtemp(prefix="sw-versions-")
    ops = [{"type": "trim_whitespace"}, {"type": "remove_empty_records"}, {"type": "remove_duplicates"}]
    v1 = save_version(spark, read_csv(spark, path), root, "stories", ops, "prompt_response",
                      {"prompt": "prompt", "response": "story"})
    assert v1.valid_rows == 2 and v1.invalid_rows == 0 and v1.status == "warning"
    rows = [json.loads(line) for name in sorted(os.listdir(v1.path + "/data")) if name.endswith(".json")
            for line in open(os.path.join(v1.path, "data", name), encoding="utf-8")]
    assert rows[0] == {"prompt": "Moon prompt", "response": "Moon story"}
    v2 = save_version(spark, read_csv(spark, path), root, "stories", ops, "prompt_response",
                      {"prompt": "prompt", "response": "story"})
    assert v2.number == 2 and v2.path != v1.path and v2.sha256 == v1.sha256
    assert open(path, encoding="utf-8").read() == STORIES
    report = validate_version(spark, v1.path + "/data", "prompt_response")
    assert report["status"] == "valid" and report["row_count"] == 2


def test_health_recommendations_and_export(spark):
    path = _write('prompt,response\n" Hello ",World\n" Hello ",World\n,Missing prompt\n', "health.csv")
    df = read_csv(spark, path)
    titles = [r["title"] for r in recommend_cleanup(df).collect()]
    assert "Remove duplicate examples" in titles and "Remove incomplete examples" in titles
    out = tempfile.mkdtemp(prefix="sw-export-") + "/csv"
    export_csv(df, out)
    part = [f for f in os.listdir(out) if f.endswith(".csv")][0]
    assert open(os.path.join(out, part), encoding="utf-8").readline().strip() == "prompt,response"


def test_auto_prepare(spark):
    path = _write("prompt,response\nHello,World\nHello,World\n,Missing\n", "prepare.csv")
    rows = [r.asDict() for r in auto_prepare(read_csv(spark, path)).collect()]
    assert rows == [{"prompt": "Hello", "response": "World"}]


def test_tabular_mapping(spark):
    df = spark.createDataFrame([("120", "north", "1250")], "ad_spend string, region string, sales string")
    out = map_to_schema(df, "tabular_supervised", {"features": ["ad_spend", "region"], "target": "sales"}).first()
    assert out["features"].asDict() == {"ad_spend": "120", "region": "north"} and out["target"] == "1250"


def test_findings_and_chat(spark):
    df = spark.createDataFrame([("hi", "", "sys"), ("hi", "yo", None)], "p string, r string, s string") \
        .withColumn(O.SN, F.monotonically_increasing_id() + 1)
    chat = map_to_schema(df, "chat", {"system": "s", "prompt": "p", "response": "r"})
    codes = [[f["code"] for f in r[0]] for r in chat.select(row_findings(chat, "chat", F.col(O.SN))).collect()]
    assert codes == [["invalid_chat_message"], []]
    sizes = [r[0] for r in chat.select(F.size("messages")).collect()]
    assert sizes == [3, 2]


def test_readers(spark):
    p = _write('{"data": [{"a": 1}, {"a": 2}]}', "d.json")
    assert [r["a"] for r in read_json(spark, p).collect()] == [1, 2]
    p = _write('{"a": 1}\n\n{"a": 3}\n', "d.jsonl")
    assert sorted(r["a"] for r in read_jsonl(spark, p).collect()) == [1, 3]


def _png(width: int, height: int) -> bytes:
    import struct
    import zlib

    raw = b"".join(b"\x00" + b"\x80" * width for _ in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_archive(spark):
    d = tempfile.mkdtemp(prefix="sw-zip-")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for name in ["cats/one.png", "cats/two.png", "dogs/one.png", "dogs/two.png", "notes.txt"]:
            zf.writestr(name, _png(2, 2))
    with open(os.path.join(d, "images.zip"), "wb") as f:
        f.write(buf.getvalue())
    rows = read_image_archive(spark, d).select("image", "label")
    assert rows.count() == 4
    assert sorted(r["label"] for r in rows.collect()) == ["cats", "cats", "dogs", "dogs"]
    root = tempfile.mkdtemp(prefix="sw-versions-")
    v = save_version(spark, rows, root, "images", [], "image_classification", {"image": "image", "label": "label"})
    assert v.status == "warning" and v.valid_rows == 4


def test_small_images_share_tasks(spark, tmp_path):
    from sieveworks.sources import images as IM
    from sieveworks.suite.images import png_gray

    (tmp_path / "k").mkdir()
    for i in range(150):
        (tmp_path / "k" / f"{i}.png").write_bytes(png_gray(np.full((2, 2), i, np.uint8)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "4m")   # one file a split
        got = IM.decode_images(spark, str(tmp_path), 2, 2)
        assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
        assert sorted(round(r["vector"][0] * 255) for r in got.collect()) == list(range(150))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
