"""Shared helpers of the registered query suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import pyregex as R

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# RE2 spellings of the Python classes for the DuckDB oracles.
_SQL_TOKENS = {
    "%SP%": R.SPACE_BODY,
    "%W%": R.WORD_BODY,
    "%D%": R.DIGIT_BODY,
}


def sql(text: str) -> str:
    """Substitute the class placeholders in an oracle SQL string."""
    for k, v in _SQL_TOKENS.items():
        text = text.replace(k, v)
    return text


def email_sql(col: str, repl: str = "[EMAIL]") -> str:
    """RE2 form of the e-mail redaction: the look-arounds become captured
    boundary characters, and a second pass catches addresses whose leading
    boundary was consumed by the previous match."""
    pat = "(^|[^%W%.+\\-])([%W%.+\\-]+@[%W%.\\-]+\\.[A-Za-z]{2,})([^%W%.\\-]|$)"
    one = f"regexp_replace({col}, '{pat}', '\\1{repl}\\3', 'g')"
    return sql(f"regexp_replace({one}, '{pat}', '\\1{repl}\\3', 'g')")


def phone_sql(col: str, repl: str = "[PHONE]") -> str:
    pat = "(^|[^%W%])(\\+?%DC%[%D%%SP%().\\-]{7,}%DC%)([^%W%]|$)".replace("%DC%", "[%D%]")
    one = f"regexp_replace({col}, '{pat}', '\\1{repl}\\3', 'g')"
    return sql(f"regexp_replace({one}, '{pat}', '\\1{repl}\\3', 'g')")


def trim_ws_sql(col: str) -> str:
    return sql(f"trim(regexp_replace({col}, '[%SP%]+', ' ', 'g'))")


def strip_sql(col: str) -> str:
    """Python ``str.strip()``."""
    return sql(f"regexp_replace({col}, '^[%SP%]+|[%SP%]+$', '', 'g')")
