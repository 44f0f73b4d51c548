"""Suite: readers, writers, versions on disk, manifests and streams.

Round-trip queries write data that Spark derives from the given tables to a
fresh folder under the shared checkpoint directory and read it back with
the library's readers, so the reader is checked against the table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import version as VS
from ..session import scratch_path
from ..sinks import writers as W
from ..sources import readers as RD
from ..streaming import streams as ST
from .common import email_sql, sql, strip_sql, table, trim_ws_sql
from .registry import register
from .versions import _FLAGSHIP_SQL, _PRIVACY_OPS

_DOCS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents"


@register("read_csv", _DOCS_SQL)
def q_read_csv(spark, sf):
    path = scratch_path(spark, "csv")
    (table(spark, sf, "documents").select("doc_id", "lang", "text").write.option("header", True)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    df = RD.read_csv(spark, path)
    return RD.blank_cells_to_empty(df)


@register("read_jsonl", "SELECT doc_id, lang, text FROM documents")
def q_read_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "lang", "text").write.json(path)
    return RD.read_jsonl(spark, path, T.StructType([T.StructField("doc_id", T.LongType()),
                                                    T.StructField("lang", T.StringType()),
                                                    T.StructField("text", T.StringType())]))


@register("read_json", "SELECT doc_id, lang, text FROM documents")
def q_read_json(spark, sf):
    path = scratch_path(spark, "json-arrays")
    W.export_json_arrays(table(spark, sf, "documents").select("doc_id", "lang", "text"), path).count()
    return RD.read_json(spark, path).select("doc_id", "lang", "text")


@register("read_text_lines", sql("SELECT " + strip_sql("line") + " AS text FROM (SELECT unnest(string_split(text, "
                                 "chr(10))) AS line FROM documents) WHERE NOT regexp_full_match(line, '[%SP%]*')"))
def q_read_text_lines(spark, sf):
    path = scratch_path(spark, "txt")
    table(spark, sf, "documents").select("text").write.text(path)
    return RD.read_text_lines(spark, path)


_K = T.StructType([T.StructField("k", T.LongType())])


def _props_log(spark, sf) -> str:
    path = scratch_path(spark, "log")
    table(spark, sf, "events").orderBy("event_id").select(F.col("props").alias("value")).write.text(path)
    return path


@register("read_event_log", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS message "
                            "FROM events")
def q_read_event_log(spark, sf):
    return RD.read_event_log(spark, _props_log(spark, sf), _K).select("k", "message")


@register("read_error_events", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id + 1 AS line "
                               "FROM events ORDER BY event_id DESC LIMIT 5000")
def q_read_error_events(spark, sf):
    return RD.read_error_events(spark, _props_log(spark, sf), _K, limit=5000).select("k", "line")


def _name_files(names, folder: str) -> None:
    """One small text file per row (relative, content), written by the tasks."""
    def run(batches):
        from ..sinks.files import write_once

        for pdf in batches:
            for relative, content in zip(pdf["relative"], pdf["content"]):
                write_once(f"{folder}/{relative}", [content.encode("utf-8")])
            yield pdf[["relative"]]

    names.select("relative", "content").mapInPandas(run, "relative string").count()


def _supplier_files(spark, sf):
    place = F.format_string("n%d/s%d.txt", F.col("s_nationkey"), F.col("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", place.alias("relative"), F.col("s_name").alias("content"))


_SUPPLIER_FILE = "'n' || s_nationkey || '/s' || s_suppkey || '.txt'"


@register("file_manifest", f"SELECT {_SUPPLIER_FILE} AS relative, octet_length(encode(s_name)) AS size, "
          "sha256(s_name) AS sha256 FROM supplier")
def q_file_manifest(spark, sf):
    """A folder tree with one file per supplier."""
    folder = scratch_path(spark, "supplier-files")
    _name_files(_supplier_files(spark, sf), folder)
    return RD.file_manifest(spark, folder, "*.txt").select("relative", "size", "sha256")


@register("verify_manifest", f"WITH f AS (SELECT s_suppkey, {_SUPPLIER_FILE} AS relative FROM supplier) "
          "SELECT relative, CASE s_suppkey % 10 WHEN 0 THEN 'changed' WHEN 1 THEN 'missing' ELSE 'ok' END AS status "
          "FROM f UNION ALL SELECT relative || '.new', 'extra' FROM f WHERE s_suppkey % 10 = 2")
def q_verify_manifest(spark, sf):
    """The tree against an earlier manifest: files changed, missing and added."""
    before, after = scratch_path(spark, "files-before"), scratch_path(spark, "files-after")
    files = _supplier_files(spark, sf)
    _name_files(files, before)
    changed = files.withColumn("content", F.when(F.col("s_suppkey") % 10 == 0, F.concat("content", F.lit("!")))
                               .otherwise(F.col("content"))).filter("s_suppkey % 10 <> 1")
    added = files.filter("s_suppkey % 10 = 2").withColumn("relative", F.concat("relative", F.lit(".new")))
    _name_files(changed.unionAll(added), after)
    return RD.verify_manifest(RD.file_manifest(spark, before), RD.file_manifest(spark, after)).select("relative", "status")


def _saved_version(spark, sf):
    root = scratch_path(spark, "versions")
    return VS.save_version(spark, table(spark, sf, "documents"), root, "documents", _PRIVACY_OPS, "text_completion",
                           {"text": "text"})


@register("save_version", "SELECT text FROM (" + _FLAGSHIP_SQL + ")")
def q_save_version(spark, sf):
    result = _saved_version(spark, sf)
    return spark.read.json(result.path + "/data")


@register("validate_version", "SELECT 'valid' AS status, count(*) AS row_count FROM (" + _FLAGSHIP_SQL + ")")
def q_validate_version(spark, sf):
    result = _saved_version(spark, sf)
    report = VS.validate_version(spark, result.path + "/data", "text_completion")
    return spark.createDataFrame([(report["status"], report["row_count"])], "status string, row_count long")


_FINGERPRINT_SQL = (
    "WITH l AS (SELECT to_json({'text': text})::VARCHAR AS line FROM (" + _FLAGSHIP_SQL + ")), "
    "c AS (SELECT sha256(line) AS h, count(*) AS n FROM l GROUP BY 1), "
    "d AS (SELECT CASE WHEN count(*) <= 256 THEN 0 WHEN count(*) <= 65536 THEN 2 END AS digits FROM c), "
    "b AS (SELECT substring(h, 1, digits) AS bucket, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS digest "
    "FROM c, d GROUP BY 1), "
    "r AS (SELECT CASE WHEN any_value(digits) = 0 THEN any_value(digest) ELSE "
    "sha256(string_agg(bucket || ':' || digest, ',' ORDER BY bucket)) END AS sha256 FROM b, d) "
    "SELECT any_value(sha256) AS sha256, count(*) AS rows, sum(greatest(1, (octet_length(encode(line)) + 1) // 4))::BIGINT "
    "AS token_estimate, sum(octet_length(encode(line)) + 1)::BIGINT AS output_bytes, 'valid' AS status FROM l, r")


@register("content_fingerprint", _FINGERPRINT_SQL)
def q_content_fingerprint(spark, sf):
    r = _saved_version(spark, sf)
    return spark.createDataFrame([(r.sha256, r.valid_rows, r.token_estimate, r.output_bytes, r.status)],
                                 "sha256 string, rows long, token_estimate long, output_bytes long, status string")


@register("write_invalid_rows", "SELECT doc_id + 1 AS row, 'missing_required_field' AS code FROM documents WHERE "
                                "doc_id NOT IN (SELECT doc_id FROM labels)")
def q_write_invalid_rows(spark, sf):
    from ..plans.ordering import with_source_number

    root = scratch_path(spark, "versions")
    docs = with_source_number(table(spark, sf, "documents"))
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    rows = VS.prepare_rows(labelled, [], "classification", {"text": "text", "label": "quality"}, numbered=True)
    errors = F.filter(F.col(VS.FINDINGS), lambda f: f["severity"] == "error")
    path = root + "/invalid_rows"
    (rows.filter(F.size(errors) > 0).select(F.col("__sw_sn").alias("row"), errors.alias("findings"),
                                            F.col(VS.SOURCE).alias("source")).write.json(path))
    back = spark.read.json(path)
    return back.select("row", F.col("findings")[0]["code"].alias("code"))


@register("read_parquet", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def q_read_parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    table(spark, sf, "part").repartition(3).write.parquet(path)
    return RD.read_parquet(spark, path).select("p_partkey", "p_name", "p_size", "p_retailprice")


@register("export_csv", "SELECT text FROM (" + _FLAGSHIP_SQL + ")")
def q_export_csv(spark, sf):
    path = scratch_path(spark, "export-csv")
    rows = VS.prepare_rows(table(spark, sf, "documents"), _PRIVACY_OPS, "text_completion", {"text": "text"},
                           keep_source=False)
    W.export_csv(rows.select("text"), path)
    return RD.blank_cells_to_empty(RD.read_csv(spark, path))


@register("export_json", "SELECT text FROM (" + _FLAGSHIP_SQL + ")")
def q_export_json(spark, sf):
    path = scratch_path(spark, "export-json")
    rows = VS.prepare_rows(table(spark, sf, "documents"), _PRIVACY_OPS, "text_completion", {"text": "text"},
                           keep_source=False)
    W.export_json(rows.select("text"), path)
    return spark.read.json(path)


@register("export_txt", "SELECT to_json({'text': text})::VARCHAR AS record FROM (" + _FLAGSHIP_SQL + ")")
def q_export_txt(spark, sf):
    path = scratch_path(spark, "export-txt")
    rows = VS.prepare_rows(table(spark, sf, "documents"), _PRIVACY_OPS, "text_completion", {"text": "text"},
                           keep_source=False)
    W.export_txt(rows.select(F.to_json(F.struct("text")).alias("record")), path)
    back = spark.read.option("lineSep", "\n\n").text(path)
    return back.filter("value <> ''").withColumnRenamed("value", "record")


_PART_FILES = ("CASE p_size % 6 WHEN 0 THEN 'predictor.json' WHEN 1 THEN 'notes.txt' WHEN 2 THEN "
               "'model-' || p_partkey || '.safetensors' WHEN 3 THEN 'sub/metadata.json' WHEN 4 THEN "
               "'Checkpoint-' || p_size || '/predictor.json' ELSE 'words.tiktoken' END")


@register("filter_manifest", f"WITH m AS (SELECT p_partkey, p_brand || '/' || {_PART_FILES} AS relative FROM part) "
          "SELECT p_partkey, relative FROM m WHERE NOT regexp_matches(relative, '(^|/)[Cc]heckpoint') "
          "AND NOT relative LIKE '%notes.txt'")
def q_filter_manifest(spark, sf):
    """A manifest with one artifact per part: final files pass, files of
    checkpoint folders and other names do not."""
    name = F.expr(_PART_FILES)
    manifest = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), name).alias("relative"))
    return W.filter_manifest(manifest).select("p_partkey", "relative")


# --- streams ----------------------------------------------------------------------

def _glob(sf: str, name: str) -> str:
    return f"{sf.rstrip('/')}/{name}[.]parquet"


@register("stream_pipeline", sql("SELECT DISTINCT " + email_sql(trim_ws_sql("text")) + " AS text FROM documents "
                                 "WHERE NOT regexp_full_match(" + trim_ws_sql("text") + ", '[%SP%]*')"))
def q_stream_pipeline(spark, sf):
    schema = table(spark, sf, "documents").schema
    ops = [{"type": "trim_whitespace", "config": {"fields": ["text"]}},
           {"type": "redact_emails", "config": {"fields": ["text"]}},
           {"type": "remove_empty_records", "config": {"fields": ["text"]}},
           {"type": "select_columns", "config": {"columns": ["text"]}}]
    return ST.stream_pipeline(spark, _glob(sf, "documents"), schema, ops, dedupe_on=["text"])


@register("stream_pipeline_watermark", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'error'")
def q_stream_pipeline_watermark(spark, sf):
    """Kinds of events by user, each once within the watermark's span: the
    given table is one micro-batch, which has no watermark before it."""
    schema = table(spark, sf, "events").schema
    ops = [{"type": "filter_regex", "config": {"field": "event_type", "pattern": "^error$", "exclude": True}}]
    return ST.stream_pipeline(spark, _glob(sf, "events"), schema, ops, dedupe_on=["user_id", "event_type"],
                              within=("ts", "1 day")).select("user_id", "event_type")


@register("stream_event_tail", "SELECT event_id, event_type, value FROM events")
def q_stream_event_tail(spark, sf):
    path = scratch_path(spark, "events-log")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return ST.stream_event_tail(spark, path, "event_id long, event_type string, value double")


def _status():
    return (F.when(F.col("event_type") == "signup", "claimed").when(F.col("event_type") == "purchase", "completed")
            .when(F.col("event_type") == "error", "failed").otherwise("running"))


_STATUS_SQL = ("CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN "
               "'failed' ELSE 'running' END")


@register("stream_job_state", "WITH u AS (SELECT user_id AS job, " + _STATUS_SQL + " AS status, event_type AS stage, "
          "value AS progress, ts, event_id AS seq FROM events) SELECT job, arg_max(status, (ts, seq)) AS status, "
          "arg_max(stage, (ts, seq)) AS stage, arg_max(least(100, greatest(0, CAST(trunc(progress) AS INTEGER))), "
          "(ts, seq)) AS progress, epoch_us(max(ts)) AS heartbeat, epoch_us(min(ts) FILTER (WHERE status = 'running')) "
          "AS started_at, epoch_us(max(ts) FILTER (WHERE status IN ('completed', 'failed', 'cancelled'))) AS finished_at "
          "FROM u GROUP BY job")
def q_stream_job_state(spark, sf):
    out = _job_state(spark, sf)
    return out.select("job", "status", "stage", "progress",
                      *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("heartbeat", "started_at",
                                                                                      "finished_at")])


def _job_state(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(_glob(sf, "events"))
    updates = stream.select(F.col("user_id").alias("job"), _status().alias("status"), F.col("event_type").alias("stage"),
                            F.col("value").alias("progress"), "ts", F.col("event_id").alias("seq"))
    return ST.stream_job_state(updates)


_TOGGLE_SQL = ("WITH c AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'up' "
          "ELSE 'down' END AS v FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT *, row_number() "
          "OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) "
          "AS n FROM c), last AS (SELECT user_id, v AS lv, n FROM r WHERE rn = 1), brk AS (SELECT r.user_id, "
          "min(r.rn) AS first_other FROM r JOIN last USING (user_id) WHERE r.v <> last.lv GROUP BY r.user_id) "
          "SELECT last.user_id, last.lv AS state FROM last LEFT JOIN brk USING (user_id) "
          "WHERE (coalesce(brk.first_other - 1, last.n)) % 2 = 1")


@register("stream_toggle_state", _TOGGLE_SQL)
def q_stream_toggle_state(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = (spark.readStream.schema(schema).parquet(_glob(sf, "events"))
              .filter(F.col("event_type").isin("click", "view"))
              .select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", "up").otherwise("down")
                      .alias("v")))
    return ST.stream_toggle(stream)


@register("stream_toggle_ordered", _TOGGLE_SQL)
def q_stream_toggle_ordered(spark, sf):
    """The toggles with clicks put into time order across micro-batches."""
    schema = table(spark, sf, "events").schema
    stream = (spark.readStream.schema(schema).parquet(_glob(sf, "events"))
              .filter(F.col("event_type").isin("click", "view"))
              .select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", "up").otherwise("down")
                      .alias("v")))
    return ST.stream_toggle_ordered(stream, "1 hour")
