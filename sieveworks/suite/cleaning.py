"""Suite: column, string and filter operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.registry import apply_operations
from .common import email_sql, phone_sql, sql, strip_sql, table, trim_ws_sql
from .registry import register


def _ops(spark, sf, name, ops, cols):
    return apply_operations(table(spark, sf, name), ops).select(*cols)


# --- 2.3 projections -------------------------------------------------------

@register("select_columns", "SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS missing FROM documents")
def q_select_columns(spark, sf):
    return apply_operations(table(spark, sf, "documents"),
                            [{"type": "select_columns", "config": {"columns": ["doc_id", "lang", "missing"]}}])


@register("rename_columns", "SELECT doc_id, lang AS language, source AS lang FROM documents")
def q_rename_columns(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return apply_operations(df, [{"type": "rename_columns",
                                  "config": {"mapping": {"lang": "language", "source": "lang"}}}])


@register("remove_columns", "SELECT doc_id, lang, source FROM documents")
def q_remove_columns(spark, sf):
    return apply_operations(table(spark, sf, "documents"),
                            [{"type": "remove_columns", "config": {"columns": ["text", "n_chars", "absent"]}}])


@register("join_columns", "SELECT c_custkey, concat_ws(' | ', c_name, CAST(c_nationkey AS VARCHAR), "
                          "CAST(c_acctbal AS VARCHAR), c_mktsegment, '') AS joined FROM customer")
def q_join_columns(spark, sf):
    return _ops(spark, sf, "customer", [{"type": "join_columns", "config": {
        "columns": ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "absent"],
        "separator": " | ", "target": "joined"}}], ["c_custkey", "joined"])


@register("split_column", "SELECT p_partkey, split_part(p_name, ' ', 1) AS name_head, "
                          "CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END "
                          "AS name_rest FROM part")
def q_split_column(spark, sf):
    return _ops(spark, sf, "part", [{"type": "split_column", "config": {
        "field": "p_name", "separator": " ", "targets": ["name_head", "name_rest"]}}],
        ["p_partkey", "name_head", "name_rest"])


@register("add_constant", "SELECT doc_id, 'train' AS split FROM documents")
def q_add_constant(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "add_constant", "config": {"name": "split", "value": "train"}}],
                ["doc_id", "split"])


@register("fill_missing", "SELECT conv_id, turn, CASE WHEN text = '' OR text IS NULL THEN 'unknown' ELSE text END "
                          "AS text, 'unknown' AS owner FROM conversations")
def q_fill_missing(spark, sf):
    return _ops(spark, sf, "conversations", [{"type": "fill_missing", "config": {
        "fields": ["text", "owner"], "value": "unknown"}}], ["conv_id", "turn", "text", "owner"])


@register("map_labels", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END "
                        "AS lang FROM documents")
def q_map_labels(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "map_labels", "config": {
        "field": "lang", "mapping": {"en": "English", "fr": "French"}}}], ["doc_id", "lang"])


@register("convert_type", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice, "
                          "CAST(p_size AS DOUBLE) AS p_size, p_brand, "
                          "lower(p_type) IN ('1', 'true', 'yes', 'on') AS p_type FROM part")
def q_convert_type(spark, sf):
    return _ops(spark, sf, "part", [
        {"type": "convert_type", "config": {"field": "p_retailprice", "target": "integer"}},
        {"type": "convert_type", "config": {"field": "p_size", "target": "float"}},
        {"type": "convert_type", "config": {"field": "p_brand", "target": "string"}},
        {"type": "convert_type", "config": {"field": "p_type", "target": "boolean"}},
    ], ["p_partkey", "p_retailprice", "p_size", "p_brand", "p_type"])


@register("hash_field", "SELECT c_custkey, sha256('pepper:' || c_name) AS c_name, "
                        "sha256('pepper:' || CAST(c_acctbal AS VARCHAR)) AS c_acctbal FROM customer")
def q_hash_field(spark, sf):
    return _ops(spark, sf, "customer", [
        {"type": "hash_field", "config": {"field": "c_name", "salt": "pepper:"}},
        {"type": "hash_field", "config": {"field": "c_acctbal", "salt": "pepper:"}},
    ], ["c_custkey", "c_name", "c_acctbal"])


# --- 2.4 string operators ----------------------------------------------------

@register("trim_whitespace", f"SELECT doc_id, {trim_ws_sql('text')} AS text, {trim_ws_sql('lang')} AS lang, "
                             f"{trim_ws_sql('source')} AS source FROM documents")
def q_trim_whitespace(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "trim_whitespace"}], ["doc_id", "text", "lang", "source"])


@register("normalize_unicode", "SELECT conv_id, turn, nfc_normalize(text) AS text, role FROM conversations")
def q_normalize_unicode(spark, sf):
    return _ops(spark, sf, "conversations", [{"type": "normalize_unicode", "config": {"form": "NFC"}}],
                ["conv_id", "turn", "text", "role"])


_UNESCAPE_SQL = ("replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), "
                 "'&amp;', '&')")


@register("remove_html", "SELECT page_id, " + _UNESCAPE_SQL.format(
    x="regexp_replace(html, '<[^>]{0,1000}[^>]{0,1000}>', ' ', 'g')") + " AS html FROM pages")
def q_remove_html(spark, sf):
    return _ops(spark, sf, "pages", [{"type": "remove_html", "config": {"fields": ["html"]}}], ["page_id", "html"])


_URL_SQL = "regexp_replace({x}, '(?i)https?://[^%SP%]+|www\\.[^%SP%]+', '', 'g')"


@register("remove_urls", sql("SELECT page_id, " + _URL_SQL.format(x="url") + " AS url, "
                             + _URL_SQL.format(x="html") + " AS html FROM pages"))
def q_remove_urls(spark, sf):
    return _ops(spark, sf, "pages", [{"type": "remove_urls"}], ["page_id", "url", "html"])


@register("remove_control_characters", "SELECT doc_id, regexp_replace(text, "
          "'[\\x{0}-\\x{8}\\x{B}-\\x{1F}\\x{7F}-\\x{9F}]', '', 'g') AS text FROM documents")
def q_remove_control_characters(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "remove_control_characters", "config": {"fields": ["text"]}}],
                ["doc_id", "text"])


@register("replace_text", "SELECT doc_id, replace(text, 'the', 'THE') AS text, replace(lang, 'the', 'THE') AS lang "
                          "FROM documents")
def q_replace_text(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "replace_text", "config": {
        "fields": ["text", "lang"], "old": "the", "new": "THE"}}], ["doc_id", "text", "lang"])


@register("regex_replace", sql("SELECT doc_id, regexp_replace(substring(text, 1, 200000), '([%D%]+)', '<\\1>', 'g') "
                               "AS text FROM documents"))
def q_regex_replace(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "regex_replace", "config": {
        "fields": ["text"], "pattern": r"(\d+)", "replacement": r"<\1>"}}], ["doc_id", "text"])


@register("lowercase", "SELECT doc_id, lower(text) AS text FROM documents")
def q_lowercase(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "lowercase", "config": {"fields": ["text"]}}], ["doc_id", "text"])


@register("strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def q_strip_accents(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "strip_accents", "config": {"fields": ["text"]}}],
                ["doc_id", "text"])


@register("redact_emails", f"SELECT doc_id, {email_sql('text')} AS text FROM documents")
def q_redact_emails(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "redact_emails", "config": {"fields": ["text"]}}],
                ["doc_id", "text"])


@register("redact_phone_numbers", f"SELECT doc_id, {phone_sql('text')} AS text FROM documents")
def q_redact_phone_numbers(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "redact_phone_numbers", "config": {"fields": ["text"]}}],
                ["doc_id", "text"])


@register("truncate_text", "SELECT doc_id, substring(text, 1, 120) AS text, lang FROM documents")
def q_truncate_text(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "truncate_text", "config": {"fields": ["text", "lang"],
                                                                             "maximum": 120}}],
                ["doc_id", "text", "lang"])


@register("prepend_text", "SELECT conv_id, turn, '>> ' || text AS text FROM conversations")
def q_prepend_text(spark, sf):
    return _ops(spark, sf, "conversations", [{"type": "prepend_text", "config": {"fields": ["text"], "value": ">> "}}],
                ["conv_id", "turn", "text"])


@register("append_text", "SELECT conv_id, turn, text || ' <eos>' AS text, role || ' <eos>' AS role FROM conversations")
def q_append_text(spark, sf):
    return _ops(spark, sf, "conversations", [{"type": "append_text", "config": {"value": " <eos>"}}],
                ["conv_id", "turn", "text", "role"])


_STOP = ("CASE WHEN instr(text, '. ') > 0 AND (instr(text, chr(10)) = 0 OR instr(text, '. ') < instr(text, chr(10))) "
         "THEN substring(text, 1, instr(text, '. ') - 1) "
         "WHEN instr(text, chr(10)) > 0 THEN substring(text, 1, instr(text, chr(10)) - 1) ELSE text END")


@register("stop_truncate", f"SELECT conv_id, turn, {strip_sql(_STOP)} AS text FROM conversations")
def q_stop_truncate(spark, sf):
    df = table(spark, sf, "conversations")
    return df.select("conv_id", "turn", X.stop_truncate(F.col("text"), ["\n", ". "]).alias("text"))


@register("tokenize_regex", sql("SELECT doc_id, len(regexp_extract_all(lower(text), '[%W%]+|[^%W%%SP%]')) AS n_tokens, "
                                "array_to_string(regexp_extract_all(lower(text), '[%W%]+|[^%W%%SP%]'), ' ') AS tokens "
                                "FROM documents"))
def q_tokenize_regex(spark, sf):
    df = table(spark, sf, "documents")
    toks = X.tokenize_regex(F.col("text"), lowercase=True)
    return df.select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


@register("token_estimate", "SELECT lang, CAST(sum(greatest(1, (strlen(CAST(to_json({'text': text}) AS VARCHAR)) + 1)"
                            " // 4)) AS BIGINT) AS tokens, count(*) AS rows FROM documents GROUP BY lang")
def q_token_estimate(spark, sf):
    df = table(spark, sf, "documents")
    line = F.to_json(F.struct(F.col("text")))
    return df.groupBy("lang").agg(F.sum(X.token_estimate(line)).alias("tokens"), F.count(F.lit(1)).alias("rows"))


# --- 2.5 filters -------------------------------------------------------------

@register("remove_empty_records", sql("SELECT conv_id, turn FROM conversations WHERE NOT regexp_full_match(text, "
                                      "'[%SP%]*') AND role IS NOT NULL"))
def q_remove_empty_records(spark, sf):
    return _ops(spark, sf, "conversations", [{"type": "remove_empty_records", "config": {"fields": ["text", "role"]}}],
                ["conv_id", "turn"])


@register("filter_length", "SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 100 AND 5000")
def q_filter_length(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "filter_length", "config": {
        "field": "text", "minimum": 100, "maximum": 5000}}], ["doc_id", "n_chars"])


@register("filter_numeric", "SELECT event_id, value FROM events WHERE value >= 5 AND value <= 50")
def q_filter_numeric(spark, sf):
    return _ops(spark, sf, "events", [{"type": "filter_numeric", "config": {
        "field": "value", "minimum": 5, "maximum": 50}}], ["event_id", "value"])


@register("filter_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}[-. ][0-9]{4}')")
def q_filter_regex(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "filter_regex", "config": {
        "field": "text", "pattern": r"[0-9]{3}[-. ][0-9]{4}"}}], ["doc_id"])


@register("filter_regex_exclude", "SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(lang, '^(en|de)$')")
def q_filter_regex_exclude(spark, sf):
    return _ops(spark, sf, "documents", [{"type": "filter_regex", "config": {
        "field": "lang", "pattern": "^(en|de)$", "exclude": True}}], ["doc_id", "lang"])


@register("filter_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' "
                           "AND o_orderstatus IN ('F', 'O')")
def q_filter_lookup(spark, sf):
    from ..operators.filters import filter_lookup

    df = filter_lookup(table(spark, sf, "orders"), equals={"o_orderpriority": "1-URGENT"},
                       within={"o_orderstatus": ["F", "O"]})
    return df.select("o_orderkey", "o_orderstatus")
