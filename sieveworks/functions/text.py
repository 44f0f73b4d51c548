"""String scalar functions of the cleaning operators, as Spark Columns.

All but four are JVM expressions (regexp_replace / replace / lower /
substring / concat) and stay inside whole-stage codegen.  Unicode
normalisation, accent stripping, HTML unescaping and Python-dialect regex
have no JVM built-in with the same semantics; they are Arrow-batched pandas
UDFs.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pyregex as R


def collapse_whitespace(c: Column) -> Column:
    """``" ".join(value.strip().split())``."""
    return F.trim(F.regexp_replace(c, f"{R.SPACE}+", " "))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFD", v))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


_NORMALIZERS = {"NFC": _nfc, "NFD": _nfd, "NFKC": _nfkc, "NFKD": _nfkd}


def normalize_unicode(c: Column, form: str = "NFKC") -> Column:
    if form not in _NORMALIZERS:
        raise ValueError("Unsupported Unicode normalization form.")
    return _NORMALIZERS[form](c)


def _strip_one(v: str | None) -> str | None:
    if v is None:
        return None
    if v.isascii():
        return v
    return "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch))


@F.pandas_udf(T.StringType())
def _strip_accents(s: pd.Series) -> pd.Series:
    return s.map(_strip_one)


def strip_accents(c: Column) -> Column:
    return _strip_accents(c)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else (html.unescape(v) if "&" in v else v))


def html_unescape(c: Column) -> Column:
    return _unescape(c)


def remove_html(c: Column) -> Column:
    return html_unescape(F.regexp_replace(c, R.HTML_TAG, " "))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, R.URL, "")


def remove_control_characters(c: Column) -> Column:
    return F.regexp_replace(c, R.CONTROL_NO_NL_TAB, "")


def replace_text(c: Column, old: str, new: str) -> Column:
    if not old:
        return c
    return F.replace(c, F.lit(old), F.lit(new))


MAX_REGEX_PATTERN = 300


def regex_replace(c: Column, pattern: str, replacement: str = "", dialect: str = "java") -> Column:
    """``re.sub(pattern, replacement, value)`` over the whole text.

    ``dialect="java"`` rewrites the Python pattern and template for the JVM
    engine (the fast path); ``dialect="python"`` evaluates with ``re`` in a
    pandas UDF for constructs the JVM engine lacks.
    """
    if len(pattern) > MAX_REGEX_PATTERN:
        raise ValueError("Regular-expression patterns are limited to 300 characters.")
    re.compile(pattern)
    if dialect == "python":
        compiled_pattern, repl = pattern, replacement

        @F.pandas_udf(T.StringType())
        def _sub(s: pd.Series) -> pd.Series:
            rx = re.compile(compiled_pattern)
            return s.map(lambda v: None if v is None else rx.sub(repl, v))

        return _sub(c)
    return F.regexp_replace(c, R.to_java(pattern), R.replacement_to_java(replacement))


def redact_emails(c: Column, replacement: str = "[EMAIL]") -> Column:
    return F.regexp_replace(c, R.EMAIL, R.replacement_to_java(replacement))


def redact_phone_numbers(c: Column, replacement: str = "[PHONE]") -> Column:
    return F.regexp_replace(c, R.PHONE, R.replacement_to_java(replacement))


def truncate_text(c: Column, maximum: int) -> Column:
    return c if maximum <= 0 else F.substring(c, 1, maximum)


def prepend_text(c: Column, value: str) -> Column:
    return F.concat(F.lit(value), c)


def append_text(c: Column, value: str) -> Column:
    return F.concat(c, F.lit(value))


def stop_truncate(c: Column, stops: list[str]) -> Column:
    """Cut at the earliest occurrence of any stop string, then strip."""
    stops = [s for s in stops if s]
    if not stops:
        return c
    positions = [F.when(F.locate(s, c) > 0, F.locate(s, c)) for s in stops]
    first = F.least(*positions) if len(positions) > 1 else positions[0]
    cut = F.when(first.isNotNull(), F.substring(c, F.lit(1), first - 1)).otherwise(c)
    return F.regexp_replace(cut, f"^{R.SPACE}+|{R.SPACE}+$", "")


def tokenize_regex(c: Column, pattern: str = R.TOKEN_PY, lowercase: bool = False) -> Column:
    """``re.findall(pattern, text)``: whole matches, or the group's text when
    the pattern has one group."""
    groups = re.compile(pattern).groups
    if groups > 1:
        raise ValueError("Token patterns may have one capture group at most.")
    text = F.lower(c) if lowercase else c
    return F.regexp_extract_all(text, F.lit(R.to_java(pattern)), groups)


def token_estimate(json_line: Column) -> Column:
    """``max(1, utf8_bytes(line + "\\n") // 4)`` per written line."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(json_line) + 1) / 4)).cast("long")
