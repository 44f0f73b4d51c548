"""Suite: training-text serialisation and chat context on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import chat as C
from ..plans.schemas import map_to_schema
from .common import strip_sql, table
from .registry import register
from .versions import PAIRS_SQL, conversation_pairs

_PATTERN = "### Prompt: {prompt}$sep### Response: {response}{history}"
_CHAT_PATTERN = "<s>{history}[INST] {prompt} [/INST]{response}</s>"
_NL2 = "chr(10) || chr(10)"


def _str(col: str) -> str:
    return strip_sql(f"coalesce({col}, 'None')")


@register("format_prompt_response", "SELECT replace(replace(replace(replace('" + _PATTERN + "', '{prompt}', "
          + _str("prompt") + "), '{response}', " + _str("response") + "), '{history}', ''), '$sep', " + _NL2
          + ") AS example FROM " + PAIRS_SQL)
def q_format_prompt_response(spark, sf):
    p = conversation_pairs(spark, sf)
    return p.select(C.format_prompt_response(F.col("prompt"), F.col("response"), _PATTERN).alias("example"))


@register("format_text_completion", "SELECT doc_id, " + strip_sql("text") + " || '</s>' AS example FROM documents")
def q_format_text_completion(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", C.format_text_completion(F.col("text"), "</s>").alias("example"))


@register("format_instruction", "SELECT 'Instruction: ' || " + _str("prompt") + " || chr(10) || 'Input: ' || "
          + _str("system") + " || chr(10) || 'Response: ' || " + _str("response") + " || '</s>' AS example FROM "
          + PAIRS_SQL)
def q_format_instruction(spark, sf):
    p = conversation_pairs(spark, sf)
    return p.select(C.format_instruction(F.col("prompt"), F.col("system"), F.col("response"), "</s>").alias("example"))


@register("format_chat", "SELECT CASE WHEN system IS NOT NULL AND system <> '' THEN 'System: ' || system || chr(10) "
          "ELSE '' END || 'User: ' || prompt || chr(10) || 'Assistant: ' || response || '</s>' AS example FROM "
          + PAIRS_SQL)
def q_format_chat(spark, sf):
    mapped = map_to_schema(conversation_pairs(spark, sf), "chat",
                           {"system": "system", "prompt": "prompt", "response": "response"})
    return mapped.select(C.format_chat(F.col("messages"), "</s>").alias("example"))


@register("inference_prefix", "SELECT conv_id, turn, replace(replace(replace('<s>{history}[INST] {prompt} [/INST]', "
          "'{prompt}', 'Be brief.' || " + _NL2 + " || text), '{history}', ''), '$sep', " + _NL2 + ") AS prefix, "
          "'</s>' AS suffix FROM conversations WHERE role = 'user'")
def q_inference_prefix(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", C.inference_prefix(F.col("text"), _CHAT_PATTERN, "  Be brief. ").alias("prefix"),
                    F.lit(C.pattern_suffix(_CHAT_PATTERN)).alias("suffix"))


@register("chat_context", "SELECT conv_id, right(string_agg(CASE WHEN role = 'assistant' THEN 'Assistant: ' "
          "ELSE 'User: ' END || " + strip_sql("text") + ", " + _NL2 + " ORDER BY turn) || " + _NL2
          + " || 'Assistant:', 16000) AS context FROM conversations GROUP BY conv_id")
def q_chat_context(spark, sf):
    return C.chat_context(table(spark, sf, "conversations"), maximum_characters=16_000)


@register("chat_context_prompt", "WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'Assistant: ' "
          "ELSE 'User: ' END || " + strip_sql("text") + " AS line FROM conversations), "
          "p AS (SELECT conv_id, 1e18 AS turn, 'User: ' || " + strip_sql("'  What next?  '") + " AS line "
          "FROM conversations GROUP BY conv_id) "
          "SELECT conv_id, right(string_agg(line, " + _NL2 + " ORDER BY turn) || " + _NL2
          + " || 'Assistant:', 2000) AS context FROM (SELECT * FROM m UNION ALL SELECT * FROM p) GROUP BY conv_id")
def q_chat_context_prompt(spark, sf):
    conv = table(spark, sf, "conversations")
    prompts = conv.select("conv_id").distinct().withColumn("prompt", F.lit("  What next?  "))
    return C.chat_context(conv, prompts=prompts, maximum_characters=2_000)


@register("context_override", "SELECT conv_id, turn, right(replace('Context:' || chr(10) || '{prompt}', '{prompt}', "
          "text), 1000) AS model_input FROM conversations WHERE role = 'user'")
def q_context_override(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", C.context_override(F.col("text"), "Context:\n{prompt}", 500)
                    .alias("model_input"))
