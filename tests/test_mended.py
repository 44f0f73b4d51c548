"""Cases that once gave silent wrong answers."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import pyregex as R
from sieveworks.functions import text as TX
from sieveworks.models import vectors as V
from sieveworks.operators.columns import fill_missing, map_labels
from sieveworks.operators.registry import apply_operations
from sieveworks.plans import catalog as K
from sieveworks.plans import chat as C
from sieveworks.plans import ordering as O
from sieveworks.plans.contracts import Field, validate_inputs
from sieveworks.plans.merge import weighted_merge
from sieveworks.plans.prepare import auto_prepare, preview, preview_removed, suggest_mapping
from sieveworks.plans.version import save_version
from sieveworks.sources import readers as RD
from sieveworks.streaming import streams as ST


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("pattern", "text"), [
    ("a.b", "a\rb a\nb a b"), (r"^x$", "x\n"), (r"(?i)é", "É"), (r"[a&&b]+", "a&b&&"), (r"(?a:k)", "k")])
def test_regex_dialect(spark, pattern, text):
    assert one(spark, text, lambda c: TX.regex_replace(c, pattern, "_")) == re.sub(pattern, "_", text)


def test_regex_reads_the_whole_text(spark):
    text = "a" * 250_000 + "b"
    assert one(spark, text, lambda c: TX.regex_replace(c, "b", "c")) == text[:-1] + "c"


@pytest.mark.parametrize("pattern", [r"(\w)\1", r"\w+", r"a(b+)", r"(?:x|y)z"])
def test_tokens_equal_findall(spark, pattern):
    text = "aabb xx abb xz yz a"
    assert one(spark, text, lambda c: TX.tokenize_regex(c, pattern)) == re.findall(pattern, text)


def test_mixed_types_become_text(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "n int, s string")
    assert [r["n"] for r in fill_missing(df, ["n"], "unknown").orderBy("s").collect()] == ["1", "unknown"]
    assert [r["n"] for r in fill_missing(df, ["n"], 7).orderBy("s").collect()] == [1, 7]
    assert [r["s"] for r in map_labels(df, "s", {"a": 5}).orderBy("s").collect()] == ["5", "b"]
    assert [r["n"] for r in map_labels(df, "n", {"1": 2.5}).orderBy("s").collect()] == [2.5, None]


def test_filters_on_untouched_columns_reach_the_scan(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = apply_operations(docs, [{"type": "add_constant", "config": {"name": "k", "value": 1}},
                                  {"type": "trim_whitespace", "config": {"fields": ["text"]}},
                                  {"type": "filter_numeric", "config": {"field": "n_chars", "minimum": 1000}}])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "n_chars" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert out.count() == docs.filter("n_chars >= 1000").count()


def test_source_numbers_are_dense(spark, small_dir, tmp_path):
    path = str(tmp_path / "many")
    spark.read.parquet(f"{small_dir}/documents.parquet").repartition(7).write.parquet(path)
    scan = spark.read.parquet(path)
    text_path = str(tmp_path / "lines")
    spark.range(500).selectExpr("cast(id as string) AS value").repartition(3).write.text(text_path)
    frames = [scan, scan.filter("n_chars > 1500"), spark.read.text(text_path),
              spark.read.text(text_path).filter("value like '%7%'"), spark.range(40).repartition(3), scan.limit(0)]
    for df in frames:
        numbers = sorted(r[O.SN] for r in O.with_source_number(df).select(O.SN).collect())
        assert numbers == list(range(1, df.count() + 1))


def test_stratified_split_keeps_null_labels(spark):
    rows = [(i, None if i % 4 == 0 else "ab"[i % 2]) for i in range(40)]
    out = O.split_stratified(spark.createDataFrame(rows, "id long, label string"), "id", "label")
    assert out.count() == 40
    assert {r["label"] for r in out.filter("split = 'test'").collect()} == {None, "a", "b"}


def test_preview_counts_duplicates(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("q", "a")] * 5 + [("r", "b")], "prompt string, response string").coalesce(1).write.parquet(path)
    ops = [{"type": "remove_duplicates"}]
    mapping = {"prompt": "prompt", "response": "response"}
    source = spark.read.parquet(path)
    assert preview_removed(source, ops, 20, "prompt_response", mapping).first()["removed"] == 4
    shown = preview(source, ops, "prompt_response", mapping).collect()
    assert [r["row"] for r in shown] == [1, 6]


def test_chat_with_a_prompt_only(spark):
    messages = spark.createDataFrame([(1, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    prompts = spark.createDataFrame([(1, "more"), (2, "new")], "conv_id long, prompt string")
    got = dict(C.chat_context(messages, prompts=prompts.withColumnRenamed("conv_id", "conv_id")).collect())
    assert got == {1: "User: hi\n\nUser: more\n\nAssistant:", 2: "User: new\n\nAssistant:"}


def test_override_and_history(spark):
    long = "x" * 70_000 + "{prompt}"
    assert one(spark, "P", lambda c: C.context_override(c, long, 64_000)) == ("x" * 70_000 + "P")[-64_000:]
    assert one(spark, "P", lambda c: C.context_override(c, " ", history=F.lit("H"))) == "H"
    assert one(spark, "P", lambda c: C.context_override(c, "", history=F.lit(""))) == "P"
    with pytest.raises(ValueError, match="response"):
        C.validate_output_pattern("{prompt}")


def test_merge_refuses_other_shapes(spark):
    kind = "name string, shape array<int>, values array<float>"
    a = spark.createDataFrame([("w", [2], [1.0, 2.0]), ("v", [1], [1.0])], kind)
    for other in ([("w", [2], [1.0, 2.0])], [("w", [2], [1.0]), ("v", [1], [1.0])], [("w", [3], [1.0, 2.0]), ("v", [1], [1.0])]):
        with pytest.raises(ValueError):
            weighted_merge(a, spark.createDataFrame(other, kind), 0.5, 0.5)


def test_csv_blank_and_absent_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,,3\n4\n5,"",\n"6, x",7,8,9\n"q ""z"" w",\n')
    rows = sorted((tuple(r) for r in RD.read_csv(spark, str(tmp_path / "x.csv")).collect()), key=repr)
    assert rows == sorted([("1", "", "3"), ("4", None, None), ("5", "", ""), ("6, x", "7", "8"), ('q "z" w', "", None)],
                          key=repr)


def test_auto_prepare_keeps_messages(spark):
    kind = "messages array<struct<role: string, content: string>>"
    df = spark.createDataFrame([([("user", "a"), ("assistant", "b")],), ([],)], kind)
    assert auto_prepare(df).collect() == df.limit(1).collect()
    assert suggest_mapping(["Question", "ANSWER", "x"])[0] == "prompt_response"
    assert suggest_mapping(["a", "sales"])[0] == "tabular_supervised" and suggest_mapping(["zzz"])[0] == ""


def test_saved_version_reports_its_size(spark, tmp_path):
    source = str(tmp_path / "s")
    spark.createDataFrame([("a",), ("b",), ("c",)], "text string").write.parquet(source)
    args = dict(schema="text_completion", mapping={"text": "text"})
    got = save_version(spark, spark.read.parquet(source), str(tmp_path / "r"), "d", [], **args)
    assert got.status == "warning" and got.codes == {"small_dataset": 1}
    drop = [{"type": "filter_length", "config": {"field": "text", "minimum": 9}}]
    got = save_version(spark, spark.read.parquet(source), str(tmp_path / "r"), "d", drop, **args)
    assert got.number == 2 and got.codes == {"no_valid_examples": 1}


def test_text_labels_and_penalty(spark):
    rows = [([float(x), 1.0], "cats" if x < 0 else "dogs") for x in (-3, -2, -1, 1, 2, 3)] + [(None, "cats"), ([1.0, 1.0], None)]
    labels, w, b = V.linear_softmax_fit(spark.createDataFrame(rows, "v array<double>, l string"), "v", "l")
    assert labels == ["cats", "dogs"] and w.shape[1] == 2
    numbers = [([float(i % 2), 1.0 - i % 2], 3 if i % 2 else 7) for i in range(8)]
    labels, w, _ = V.linear_softmax_fit(spark.createDataFrame(numbers, "v array<double>, l int"), "v", "l")
    assert labels == ["3", "7"] and abs(w).max() < 3


def test_centroid_slices_equal_one_pass(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)], "i int, v array<double>")
    centroids = [(chr(97 + j), [float(j), 1.0, 0.5 * j]) for j in range(7)]
    whole = V.centroid_classify(vectors, "v", centroids).orderBy("i").collect()
    monkeypatch.setattr(V, "MAX_INLINE_VALUES", 6)
    sliced = V.centroid_classify(vectors, "v", centroids).orderBy("i").collect()
    for a, b in zip(whole, sliced, strict=True):
        assert [p["label"] for p in a["predictions"]] == [p["label"] for p in b["predictions"]]
        assert [p["score"] for p in a["predictions"]] == pytest.approx([p["score"] for p in b["predictions"]])


def test_job_report_without_stage(spark):
    rows = [("j", "running", "load", 10, 1, 1), ("j", None, None, 120, 2, 2)]
    got = ST.job_state_aggregate(spark.createDataFrame(
        rows, "job string, status string, stage string, progress int, ts long, seq long")).first()
    assert (got["status"], got["stage"], got["progress"], got["heartbeat"]) == ("running", "load", 100, 2)


def test_recorded_fork_version(spark):
    items = spark.createDataFrame([(1, None, None), (2, 1, 1), (3, 9, 1)], "item long, src long, src_v long")
    versions = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "v_item long, v long, name string")
    got = K.latest_with_fallback(items, versions, item="item", fork_of="src", version_item="v_item", order=["v"],
                                 value=["name"], fork_version=["src_v"])
    assert sorted(map(tuple, got.collect())) == [(1, "new", "own"), (2, "old", "fork"), (3, None, None)]
    ready = K.runnable_items(items, versions, item="item", version_item="v_item", order=["v"],
                             usable=F.col("name") == "old", fork_of="src", fork_version=["src_v"])
    assert [r["item"] for r in ready.collect()] == [2]


def test_streams_resume(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    os.makedirs(src)

    def add(name, rows):
        spark.createDataFrame(rows, "user_id long, ts long, event_id long, v string").coalesce(1).write.mode(
            "append").json(f"{src}/{name}")

    kind = "user_id long, ts long, event_id long, v string"
    add("a", [(1, 1, 1, "up"), (2, 1, 2, "up"), (2, 2, 3, "up")])
    assert ST.stream_event_tail(spark, f"{src}/*", kind, state=state).count() == 3
    toggles = str(tmp_path / "toggles")
    stream = spark.readStream.schema(kind).json(f"{src}/*")
    assert ST.stream_toggle(stream, state=toggles).collect() == [(1, "up")]
    add("b", [(1, 5, 4, "up"), (2, 5, 5, "down"), (3, 1, 6, "up"), (3, 2, 7, "up"), (3, 3, 8, "up")])
    tail = ST.stream_event_tail(spark, f"{src}/*", kind, state=state)
    assert sorted(r["event_id"] for r in tail.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    again = ST.stream_toggle(spark.readStream.schema(kind).json(f"{src}/*"), state=toggles)
    assert sorted(map(tuple, again.collect())) == [(2, "down"), (3, "up")]


def test_contract(spark):
    contract = [Field("t", "float", default="0.5"), Field("n", "integer", required=True),
                Field("flag", "boolean"), Field("tags", "list"), Field("mode", choices=["a", "b"]),
                Field("rank", "integer", depends_on={"mode": "b"}), Field("raw", "json")]
    rows = [({"t": "0.75", "n": "32", "flag": "Yes", "tags": "x, y,,z", "mode": "a", "rank": "oops", "raw": '{"k": 1}'},),
            ({"t": "warm", "flag": "maybe", "mode": "c", "zz": "1", "raw": "{"},), (None,),
            ({"n": " 7 ", "mode": "b", "rank": "3", "tags": '["p", "q"]'},)]
    got = validate_inputs(spark.createDataFrame(rows, "s map<string,string>"), "s", contract).select("values", "errors").collect()
    assert tuple(got[0]["values"]) == (0.75, 32, True, ["x", "y", "z"], "a", None, '{"k": 1}') and got[0]["errors"] == {}
    assert set(got[1]["errors"]) == {"t", "n", "flag", "mode", "raw", "_unknown"}
    assert got[2]["values"]["t"] == 0.5 and got[2]["errors"] == {"n": "is required"}
    assert got[3]["values"]["rank"] == 3 and got[3]["values"]["tags"] == ["p", "q"] and got[3]["errors"] == {}
