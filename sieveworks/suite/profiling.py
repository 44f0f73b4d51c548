"""Suite: whole-table profiling and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.profile import RULES, infer_types, profile_columns, profile_records, recommend_cleanup
from .common import sql, table
from .registry import register

_PROFILE_SQL = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"count(*) FILTER (WHERE regexp_full_match({c}, '[%SP%]*')) AS empty_count, "
    f"min(length({c})) AS minimum_text_length, max(length({c})) AS maximum_text_length, "
    f"round(avg(length({c})), 2) AS average_text_length, count(*) AS row_count FROM conversations"
    for i, c in [(2, "role"), (3, "text")]) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', {i}, count(*) FILTER (WHERE {c} IS NULL), 0, NULL, NULL, NULL, count(*) FROM conversations"
    for i, c in [(0, "conv_id"), (1, "turn")]))


@register("profile_columns", _PROFILE_SQL)
def q_profile_columns(spark, sf):
    return profile_columns(table(spark, sf, "conversations")).drop("types")


def _types_sql(column: str) -> str:
    kind = (f"CASE WHEN {column} IS NULL THEN 'null' WHEN typeof({column}) IN ('BIGINT', 'INTEGER') THEN 'integer' "
            f"WHEN typeof({column}) IN ('DOUBLE', 'FLOAT') THEN 'float' ELSE 'string' END")
    return f"SELECT '{column}' AS \"column\", string_agg(DISTINCT {kind}, ',' ORDER BY {kind}) AS types FROM events"


@register("infer_types", " UNION ALL ".join(_types_sql(c) for c in (
    "event_id", "ts", "user_id", "event_type", "value", "props")))
def q_infer_types(spark, sf):
    return infer_types(table(spark, sf, "events"))


# records whose fields change their kind from row to row; some lack ``late``
_RECORD = ("'{\"k\": ' || (props::JSON->>'k') || ', \"v\": ' || CASE event_id % 5 WHEN 0 THEN event_id::VARCHAR "
           "WHEN 1 THEN '\"' || event_type || '\"' WHEN 2 THEN 'true' WHEN 3 THEN '[1]' ELSE props END || "
           "CASE WHEN event_id % 3 = 0 AND event_id > 10 THEN ', \"late\": ' || "
           "CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '0.5' END ELSE '' END || '}'")
_RECORDS_SQL = (
    f"WITH r AS (SELECT event_id, {_RECORD} AS line, row_number() OVER (ORDER BY event_id) AS sn FROM events), "
    "f AS (SELECT sn, unnest(json_keys(line)) AS key, line FROM r), "
    "t AS (SELECT sn, key, json_type(json_extract(line, '$.' || key)) AS t, "
    "json_extract_string(line, '$.' || key) AS s FROM f), "
    "k AS (SELECT sn, key, CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'float' "
    "WHEN t = 'VARCHAR' THEN 'string' ELSE lower(t) END AS kind, CASE WHEN t = 'VARCHAR' THEN s END AS s FROM t), "
    "firsts AS (SELECT key, min(sn) AS first_row, (SELECT count(*) FROM r) - min(sn) + 1 - count(*) AS missing FROM k "
    "GROUP BY key), "
    "every AS (SELECT key, kind, s FROM k UNION ALL SELECT key, 'null', NULL FROM firsts, range(missing)) "
    "SELECT key AS \"column\", string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, "
    "count(*) FILTER (kind = 'null') AS null_count, min(length(s)) AS minimum_text_length, "
    "max(length(s)) AS maximum_text_length, round(avg(length(s)), 2) AS average_text_length, any_value(first_row) AS "
    "first_row FROM every JOIN firsts USING (key) GROUP BY key")


@register("profile_records", _RECORDS_SQL)
def q_profile_records(spark, sf):
    """Fields of mixed kinds, read back from JSON lines."""
    from ..session import scratch_path
    from ..sources.readers import read_records

    kind = F.col("event_id") % 5
    value = (F.when(kind == 0, F.col("event_id").cast("string")).when(kind == 1, F.concat(F.lit('"'), "event_type", F.lit('"')))
             .when(kind == 2, "true").when(kind == 3, "[1]").otherwise(F.col("props")))
    late = F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") > 10), F.concat(
        F.lit(', "late": '), F.when(F.col("event_id") % 2 == 0, "null").otherwise("0.5"))).otherwise("")
    line = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "v": '), value, late, F.lit("}"))
    path = scratch_path(spark, "records")
    table(spark, sf, "events").orderBy("event_id").select(line.alias("value")).write.text(path)
    found = profile_records(read_records(spark, path))
    return found.select("column", F.array_join("types", ",").alias("types"), "null_count", "minimum_text_length",
                        "maximum_text_length", "average_text_length", "first_row")


def _rule(name: str, found: str, affected: str = "CAST(NULL AS BIGINT)", table: str = "pages") -> str:
    operation, title, severity, detail = RULES[name]
    text = detail.replace("'", "''").replace("{n}", "' || n || '")
    return (f"SELECT operation, title, '{text}' AS detail, severity, n AS affected, operation IS NOT NULL AS auto_applicable "
            f"FROM (SELECT {'NULL::VARCHAR' if operation is None else repr(operation)} AS operation, '{title}' AS title, "
            f"'{severity}' AS severity, CAST({affected} AS BIGINT) AS n, {found} AS found FROM {table}) WHERE found")


def _any(pattern: str) -> str:
    return f"bool_or(regexp_matches(url, '{pattern}') OR regexp_matches(html, '{pattern}'))"


_EMPTY = "sum(" + " + ".join(
    ["CASE WHEN page_id IS NULL THEN 1 ELSE 0 END"] + [
        f"CASE WHEN {c} IS NULL OR regexp_full_match({c}, '[%SP%]*') THEN 1 ELSE 0 END" for c in ("url", "html")]) + ")"
_DUPLICATES = "count(*) - count(DISTINCT (page_id, url, html))"
_LONGEST = "max(greatest(length(url), length(html)))"


@register("recommend_cleanup", sql(" UNION ALL ".join([
    _rule("duplicates", f"{_DUPLICATES} > 0", _DUPLICATES), _rule("empty", f"{_EMPTY} > 0", _EMPTY),
    _rule("spacing", _any("^[%SP%]|[%SP%]$|  ")), _rule("html", _any("<[^>]+>")),
    _rule("urls", _any("(?i)https?://|www\\.")), _rule("control", _any("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")),
    _rule("emails", _any("[%W%.+\\-]+@[%W%.\\-]+\\.[A-Za-z]{2,}")), _rule("long", f"{_LONGEST} > 16000", _LONGEST),
    _rule("small", "count(*) BETWEEN 1 AND 19", "count(*)"), _rule("fields", "count(*) >= 0"),
])))
def q_recommend_cleanup(spark, sf):
    return recommend_cleanup(table(spark, sf, "pages"))


_SPACED = " OR ".join(f"regexp_matches({c}, '^[%SP%]|[%SP%]$') OR contains({c}, '  ')" for c in ("text", "lang", "source"))


@register("recommend_cleanup_documents", sql(" UNION ALL ".join([
    _rule("duplicates", "n > 0", "n", "(SELECT count(*) - count(DISTINCT (doc_id, text, lang, source, n_chars)) AS n "
          "FROM documents)"),
    _rule("spacing", f"bool_or({_SPACED})", table="documents"),
    _rule("emails", "bool_or(regexp_matches(text, '[%W%.+\\-]+@[%W%.\\-]+\\.[A-Za-z]{2,}'))", table="documents"),
    _rule("long", "max(length(text)) > 16000", "max(length(text))", "documents"),
])))
def q_recommend_cleanup_documents(spark, sf):
    return recommend_cleanup(table(spark, sf, "documents"))


@register("sample_profile", "SELECT lang, count(*) AS rows, round(avg(length(text)), 2) AS avg_len, "
                            "max(length(text)) AS max_len FROM documents GROUP BY lang")
def q_sample_profile(spark, sf):
    """Per-language text-length profile (the profile aggregate grouped)."""
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.length("text")), 2).alias("avg_len"),
                                 F.max(F.length("text")).cast("long").alias("max_len"))
