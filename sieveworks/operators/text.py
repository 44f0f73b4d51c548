"""String operators: apply a text function to the configured fields.

``fields`` defaults to every string column, as the reference defaults to
every string-valued key of the row.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions import text as X


def string_fields(df: DataFrame, fields: list[str] | None) -> list[str]:
    strings = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.StringType) and not f.name.startswith("__sw_")]
    if fields:
        return [f for f in fields if f in strings]
    return strings


def _each(df: DataFrame, fields: list[str] | None, fn: Callable[[Column], Column]) -> DataFrame:
    targets = string_fields(df, fields)
    if not targets:
        return df
    from pyspark.sql import functions as F

    replaced = {name: fn(F.col(name)) for name in targets}
    return df.withColumns(replaced)


def trim_whitespace(df, fields=None, **_):
    return _each(df, fields, X.collapse_whitespace)


def normalize_unicode(df, fields=None, form="NFKC", **_):
    if form not in {"NFC", "NFD", "NFKC", "NFKD"}:
        raise ValueError("Unsupported Unicode normalization form.")
    return _each(df, fields, lambda c: X.normalize_unicode(c, form))


def remove_html(df, fields=None, **_):
    return _each(df, fields, X.remove_html)


def remove_urls(df, fields=None, **_):
    return _each(df, fields, X.remove_urls)


def remove_control_characters(df, fields=None, **_):
    return _each(df, fields, X.remove_control_characters)


def replace_text(df, fields=None, old="", new="", **_):
    old, new = str(old or ""), str(new or "")
    if not old:
        return df
    return _each(df, fields, lambda c: X.replace_text(c, old, new))


def regex_replace(df, fields=None, pattern="", replacement="", dialect="java", **_):
    pattern, replacement = str(pattern or ""), str(replacement or "")
    return _each(df, fields, lambda c: X.regex_replace(c, pattern, replacement, dialect))


def lowercase(df, fields=None, **_):
    from pyspark.sql import functions as F

    return _each(df, fields, F.lower)


def strip_accents(df, fields=None, **_):
    return _each(df, fields, X.strip_accents)


def redact_emails(df, fields=None, replacement="[EMAIL]", **_):
    return _each(df, fields, lambda c: X.redact_emails(c, str(replacement)))


def redact_phone_numbers(df, fields=None, replacement="[PHONE]", **_):
    return _each(df, fields, lambda c: X.redact_phone_numbers(c, str(replacement)))


def truncate_text(df, fields=None, maximum=0, **_):
    maximum = max(0, int(maximum or 0))
    if not maximum:
        return df
    return _each(df, fields, lambda c: X.truncate_text(c, maximum))


def prepend_text(df, fields=None, value="", **_):
    value = str(value or "")
    return _each(df, fields, lambda c: X.prepend_text(c, value))


def append_text(df, fields=None, value="", **_):
    value = str(value or "")
    return _each(df, fields, lambda c: X.append_text(c, value))
