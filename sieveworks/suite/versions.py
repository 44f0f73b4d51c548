"""Suite: schema mapping, findings, de-duplication, ordering and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.registry import apply_operations, recipe
from ..plans import ordering as O
from ..plans.schemas import row_findings, version_report
from ..plans.version import FINDINGS, KEY, apply_limit, prepare_rows
from .common import email_sql, phone_sql, sql, strip_sql, table, trim_ws_sql
from .registry import register


def _errors(df: DataFrame):
    return F.filter(F.col(FINDINGS), lambda f: f["severity"] == "error")


def conversation_pairs(spark, sf) -> DataFrame:
    """User turn followed by the assistant's answer, plus the conversation's
    first system message.  The join key is (conv_id, turn), so one huge
    conversation does not land in one task."""
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", F.col("turn"), F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                       F.col("text").alias("response"))
    system = (c.filter(F.col("role") == "system").groupBy("conv_id")
              .agg(F.min_by("text", "turn").alias("system")))
    return u.join(a, ["conv_id", "turn"]).join(system, "conv_id", "left")


PAIRS_SQL = ("(SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response, s.system FROM conversations u "
             "JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' "
             "LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' "
             "GROUP BY conv_id) s ON s.conv_id = u.conv_id WHERE u.role = 'user')")

_PRIVACY_OPS = [{"type": "trim_whitespace"}, {"type": "redact_emails"}, {"type": "redact_phone_numbers"},
                {"type": "remove_empty_records"}, {"type": "remove_duplicates"}]


def _clean(col: str) -> str:
    return phone_sql(email_sql(trim_ws_sql(col)))


_FLAGSHIP_SQL = sql(
    "WITH t AS (SELECT doc_id + 1 AS row, " + _clean("text") + " AS text, " + _clean("lang") + " AS lang, "
    + _clean("source") + " AS source, n_chars FROM documents), "
    "f AS (SELECT * FROM t WHERE NOT regexp_full_match(text, '[%SP%]*') AND NOT regexp_full_match(lang, '[%SP%]*') "
    "AND NOT regexp_full_match(source, '[%SP%]*') AND n_chars IS NOT NULL) "
    "SELECT CAST(min(row) AS BIGINT) AS row, text, text <> '' AS valid FROM f GROUP BY text")


@register("prepare_version", _FLAGSHIP_SQL)
def q_prepare_version(spark, sf):
    rows = prepare_rows(table(spark, sf, "documents"), _PRIVACY_OPS, "text_completion", {"text": "text"},
                        keep_source=False)
    return rows.select(F.col(O.SN).alias("row"), "text", (F.size(_errors(rows)) == 0).alias("valid"))


@register("remove_duplicates", "SELECT CAST(min(doc_id) + 1 AS BIGINT) AS row, text FROM documents GROUP BY text")
def q_remove_duplicates(spark, sf):
    rows = prepare_rows(table(spark, sf, "documents"), [{"type": "remove_duplicates"}], "text_completion",
                        {"text": "text"}, keep_source=False)
    return rows.select(F.col(O.SN).alias("row"), "text")


@register("duplicate_count", "SELECT count(*) AS rows, count(DISTINCT (text, lang, source)) AS distinct_rows, "
                             "count(*) - count(DISTINCT (text, lang, source)) AS duplicate_count FROM documents")
def q_duplicate_count(spark, sf):
    from ..plans.profile import duplicate_count

    return duplicate_count(table(spark, sf, "documents").select("text", "lang", "source"))


@register("with_source_number", "SELECT doc_id, CAST(doc_id + 1 AS BIGINT) AS source_number FROM documents")
def q_with_source_number(spark, sf):
    return O.with_source_number(table(spark, sf, "documents")).select("doc_id", F.col(O.SN).alias("source_number"))


@register("map_text_completion", "SELECT CAST(doc_id + 1 AS BIGINT) AS row, "
                                 "'[' || lang || '] ' || text AS text FROM documents")
def q_map_text_completion(spark, sf):
    rows = prepare_rows(table(spark, sf, "documents"), [], "text_completion", {}, template="[{lang}] {text}")
    return rows.select(F.col(O.SN).alias("row"), "text")


@register("map_prompt_response", f"SELECT prompt, response FROM {PAIRS_SQL}")
def q_map_prompt_response(spark, sf):
    from ..plans.schemas import map_to_schema

    return map_to_schema(conversation_pairs(spark, sf), "prompt_response", {"prompt": "prompt", "response": "response"})


@register("map_instruction", f"SELECT prompt AS instruction, CAST(NULL AS VARCHAR) AS input, response AS output, "
                             f"'missing_required_field' AS code FROM {PAIRS_SQL}")
def q_map_instruction(spark, sf):
    from ..plans.schemas import map_to_schema

    pairs = conversation_pairs(spark, sf).withColumn(O.SN, F.lit(1).cast("long"))
    mapped = map_to_schema(pairs, "instruction", {"instruction": "prompt", "input": "context", "output": "response"})
    f = row_findings(mapped, "instruction", F.col(O.SN))
    return mapped.select("instruction", "input", "output", F.array_join(F.transform(f, lambda x: x["code"]), ",")
                         .alias("code"))


@register("map_classification", "SELECT d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id)")
def q_map_classification(spark, sf):
    from ..plans.schemas import map_to_schema

    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return map_to_schema(df, "classification", {"text": "text", "label": "quality"})


_IMG_SUFFIX = ("lower(regexp_extract(regexp_extract(regexp_replace(" + strip_sql("url") + ", '/+$', ''), '([^/]*)$', 1), "
               "'^.+(\\.[^.]+)$', 1))")


@register("map_image_classification", "SELECT CAST(page_id + 1 AS BIGINT) AS row, url AS image, "
          "regexp_extract(url, '/([a-z]{2})/', 1) AS label, "
          f"CASE WHEN {_IMG_SUFFIX} IN ('.png', '.jpg', '.jpeg', '.webp', '.bmp') THEN '' "
          "ELSE 'invalid_image_format' END AS code FROM pages")
def q_map_image_classification(spark, sf):
    df = table(spark, sf, "pages").withColumn("lang_label", F.regexp_extract("url", "/([a-z]{2})/", 1))
    rows = prepare_rows(df, [], "image_classification", {"image": "url", "label": "lang_label"})
    return rows.select(F.col(O.SN).alias("row"), "image", "label",
                       F.array_join(F.transform(F.col(FINDINGS), lambda x: x["code"]), ",").alias("code"))


@register("map_chat", "SELECT CASE WHEN system IS NOT NULL AND system <> '' THEN 'system: ' || system || chr(10) "
                      "ELSE '' END || 'user: ' || prompt || chr(10) || 'assistant: ' || response AS dialog, "
                      "CASE WHEN system IS NOT NULL AND system <> '' THEN 3 ELSE 2 END AS n_messages "
                      f"FROM {PAIRS_SQL}")
def q_map_chat(spark, sf):
    from ..plans.schemas import map_to_schema

    mapped = map_to_schema(conversation_pairs(spark, sf), "chat",
                           {"system": "system", "prompt": "prompt", "response": "response"})
    return mapped.select(
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
        .alias("dialog"), F.size("messages").alias("n_messages"))


@register("map_tabular_supervised", "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_extendedprice AS target "
                                    "FROM lineitem")
def q_map_tabular_supervised(spark, sf):
    from ..plans.schemas import map_to_schema

    mapped = map_to_schema(table(spark, sf, "lineitem"), "tabular_supervised",
                           {"features": "l_quantity, l_discount, l_tax, l_returnflag", "target": "l_extendedprice"})
    return mapped.select("features.*", "target")


@register("row_findings", "SELECT CAST(doc_id + 1 AS BIGINT) AS row, 'missing_required_field' AS code, "
                          "'label' AS field FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_row_findings(spark, sf):
    # number the documents before the join, which does not keep file order
    docs = O.with_source_number(table(spark, sf, "documents"))
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    rows = prepare_rows(labelled, [], "classification", {"text": "text", "label": "quality"}, numbered=True)
    return rows.select(F.explode(FINDINGS).alias("f")).select(F.col("f.row").alias("row"), F.col("f.code").alias("code"),
                                                              F.col("f.field").alias("field"))


@register("version_report", "SELECT CASE WHEN count(*) FILTER (WHERE l.doc_id IS NULL) > 0 THEN 'invalid' "
                            "WHEN count(*) FILTER (WHERE l.doc_id IS NOT NULL) < 5 THEN 'warning' ELSE 'valid' END "
                            "AS status, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS valid_rows, "
                            "count(*) FILTER (WHERE l.doc_id IS NULL) AS invalid_rows, "
                            "count(*) FILTER (WHERE l.doc_id IS NULL) AS finding_count "
                            "FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_version_report(spark, sf):
    docs = O.with_source_number(table(spark, sf, "documents"))
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    rows = prepare_rows(labelled, [], "classification", {"text": "text", "label": "quality"}, numbered=True)
    return version_report(rows, FINDINGS)


@register("auto_prepare_report", "WITH r AS (SELECT " + strip_sql("prompt") + " AS prompt, " + strip_sql("response")
          + " AS response FROM " + PAIRS_SQL + "), v AS (SELECT prompt, response, count(*) AS n FROM r WHERE prompt <> '' "
          "AND response <> '' GROUP BY 1, 2) SELECT (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM r) - sum(n)::BIGINT "
          "AS invalid, sum(n - 1)::BIGINT AS duplicates, count(*) AS kept FROM v")
def q_auto_prepare_report(spark, sf):
    from ..plans.prepare import auto_prepare_report

    return auto_prepare_report(conversation_pairs(spark, sf).select("prompt", "response"), schema="prompt_response")


@register("auto_prepare", "SELECT DISTINCT " + strip_sql("prompt") + " AS prompt, " + strip_sql("response")
          + " AS response FROM " + PAIRS_SQL + " WHERE " + strip_sql("prompt") + " <> '' AND "
          + strip_sql("response") + " <> ''")
def q_auto_prepare(spark, sf):
    from ..plans.prepare import auto_prepare

    return auto_prepare(conversation_pairs(spark, sf).select("prompt", "response"), schema="prompt_response").drop(O.SN)


@register("apply_operations", sql(
    "WITH t AS (SELECT doc_id, nfc_normalize(" + trim_ws_sql("text") + ") AS text FROM documents) "
    "SELECT doc_id, regexp_replace(text, '[\\x{0}-\\x{8}\\x{B}-\\x{1F}\\x{7F}-\\x{9F}]', '', 'g') AS text FROM t "
    "WHERE NOT regexp_full_match(text, '[%SP%]*')"))
def q_apply_operations(spark, sf):
    ops = [{"type": t["type"], "config": {"fields": ["text"]} if t["type"] != "remove_empty_records" else {}}
           for t in recipe("quality")]
    ops[1]["config"]["form"] = "NFC"
    return apply_operations(table(spark, sf, "documents").select("doc_id", "text"), ops)


@register("limit_examples", "SELECT CAST(doc_id + 1 AS BIGINT) AS row, text FROM documents "
                            "WHERE length(text) >= 300 ORDER BY doc_id LIMIT 100")
def q_limit_examples(spark, sf):
    rows = prepare_rows(table(spark, sf, "documents"), [{"type": "filter_length", "config": {
        "field": "text", "minimum": 300}}], "text_completion", {"text": "text"})
    limited = apply_limit(rows, 100)
    return limited.select(F.col(O.SN).alias("row"), "text")


@register("number_filtered_scan", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS source_number "
          "FROM documents WHERE n_chars >= 1000")
def q_number_filtered_scan(spark, sf):
    """Source numbers stay dense and unique on a scan that was filtered first."""
    long = table(spark, sf, "documents").filter("n_chars >= 1000")
    return O.with_source_number(long).select("doc_id", F.col(O.SN).alias("source_number"))


@register("preview_removed_duplicates", "WITH d AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) "
          "AS nth FROM documents) SELECT count(*) AS removed FROM d WHERE nth > 1")
def q_preview_removed_duplicates(spark, sf):
    """Languages only: all but the first row of each are duplicates, and fewer
    than the preview's rows survive."""
    from ..plans.prepare import preview_removed

    return preview_removed(table(spark, sf, "documents"), [
        {"type": "select_columns", "config": {"columns": ["lang"]}}, {"type": "remove_duplicates"}], limit=20)


@register("shuffle", "SELECT doc_id, sha256('42:' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM documents")
def q_shuffle(spark, sf):
    return O.shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", seed=42)


@register("head_examples", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def q_head_examples(spark, sf):
    df = O.with_source_order(table(spark, sf, "documents"))
    return O.head_examples(df, [F.col(O.ORDER)], 50).select("doc_id", "lang")


@register("preview", "SELECT CAST(doc_id + 1 AS BIGINT) AS row, lang, n_chars FROM documents "
                     "WHERE n_chars >= 1000 ORDER BY doc_id LIMIT 20")
def q_preview(spark, sf):
    from ..plans.prepare import preview

    return preview(table(spark, sf, "documents"), [{"type": "filter_numeric", "config": {
        "field": "n_chars", "minimum": 1000}}], "classification", {"text": "lang", "label": "n_chars"}, limit=20) \
        .select(F.col("row"), F.col("output.text").alias("lang"), F.col("output.label").alias("n_chars"))


@register("preview_removed", "SELECT count(*) AS removed FROM documents WHERE n_chars < 1000 AND doc_id <= "
          "(SELECT doc_id FROM documents WHERE n_chars >= 1000 ORDER BY doc_id LIMIT 1 OFFSET 19)")
def q_preview_removed(spark, sf):
    from ..plans.prepare import preview_removed

    return preview_removed(table(spark, sf, "documents"), [{"type": "filter_numeric", "config": {
        "field": "n_chars", "minimum": 1000}}], limit=20)


@register("sample_rows", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '…' "
                         "ELSE text END AS text, lang FROM documents ORDER BY doc_id LIMIT 20")
def q_sample_rows(spark, sf):
    df = O.with_source_order(table(spark, sf, "documents"))
    return O.sample_rows(df.select("doc_id", "text", "lang", O.ORDER), [F.col(O.ORDER)], 20).drop(O.ORDER)


@register("split_train_validation", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || "
          "CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER () AS n FROM documents) "
          "SELECT doc_id, CASE WHEN rn <= greatest(1, least(n - 2, CAST(round_even(n * 0.2, 0) AS BIGINT))) "
          "THEN 'validation' ELSE 'train' END AS split FROM r")
def q_split_train_validation(spark, sf):
    return O.split_train_validation(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2, 42)


@register("split_stratified", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), "
          "t AS (SELECT sum(n) AS n, count(*) AS c, least(sum(n) - count(*), greatest(count(*), "
          "round_even(sum(n) * 0.2, 0))) AS n_test FROM c), "
          "q AS (SELECT c.quality, c.n, t.n_test * c.n / t.n AS raw, t.n_test, "
          "least(greatest(1, floor(t.n_test * c.n / t.n)), c.n - 1) AS base FROM c, t), "
          "f AS (SELECT *, n_test - sum(base) OVER () AS spare, row_number() OVER (ORDER BY raw - floor(raw) DESC, "
          "CAST(quality AS VARCHAR)) AS turn FROM q), "
          "p AS (SELECT quality, base + CASE WHEN turn <= spare AND base < n - 1 THEN 1 ELSE 0 END AS quota FROM f), "
          "r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || "
          "CAST(doc_id AS VARCHAR)), doc_id) AS nth FROM labels) "
          "SELECT doc_id, r.quality, CASE WHEN nth <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN p "
          "ON r.quality IS NOT DISTINCT FROM p.quality")
def q_split_stratified(spark, sf):
    """Per-quality test quota over the labelled documents."""
    return O.split_stratified(table(spark, sf, "labels"), "doc_id", "quality", 0.2, 42).select("doc_id", "quality",
                                                                                              "split")


@register("top_n_recent", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def q_top_n_recent(spark, sf):
    return O.top_n_recent(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", 30,
                          tie="event_id").drop("ts")


@register("top_k_ranked_lines", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY place) AS parts FROM (SELECT *, "
          "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS place "
          "FROM lineitem) WHERE place <= 3 GROUP BY l_orderkey")
def q_top_k_ranked_lines(spark, sf):
    """The three lines of each order with the largest quantities; of equal ones
    the earlier first."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    scores = F.transform(lines, lambda x: F.struct(x["l_partkey"].alias("label"), x["l_quantity"].alias("score")))
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(scores.alias("scores"))
    top = O.top_k_ranked(F.col("scores"), 3)
    return orders.select("l_orderkey", F.array_join(F.transform(top, lambda x: x["label"].cast("string")), ",").alias("parts"))
