"""Row filters.  All are deterministic predicates, so Catalyst pushes the
parts that touch only source columns down toward the scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pyregex as R
from ..functions.pysem import dtype_of, is_blank, py_float, py_str_field


def remove_empty_records(df: DataFrame, fields: list[str] | None = None, **_: object) -> DataFrame:
    required = fields or [c for c in df.columns if not c.startswith("__sw_")]
    cond = F.lit(False)
    for name in required:
        dtype = dtype_of(df, name)
        if dtype is None:
            cond = F.lit(True)  # absent key: row.get() is None
            break
        c = F.col(name)
        empty = c.isNull() | is_blank(c) if isinstance(dtype, T.StringType) else c.isNull()
        cond = cond | empty
    return df.filter(~cond)


def filter_length(df: DataFrame, field: str | None = None, minimum=None, maximum=None, **_: object) -> DataFrame:
    length = F.length(py_str_field(df, str(field)))
    cond = F.lit(True)
    if minimum is not None:
        cond = cond & (length >= int(minimum))
    if maximum is not None:
        cond = cond & (length <= int(maximum))
    return df.filter(cond)


def filter_numeric(df: DataFrame, field: str | None = None, minimum=None, maximum=None, **_: object) -> DataFrame:
    number = py_float(F.col(field), dtype_of(df, field)) if field in df.columns else F.lit(None).cast("double")
    # Python compares NaN as neither smaller nor larger: NaN passes both bounds.
    cond = number.isNotNull()
    nan = F.isnan(number)
    if minimum is not None:
        cond = cond & (nan | (number >= float(minimum)))
    if maximum is not None:
        cond = cond & (nan | (number <= float(maximum)))
    return df.filter(cond)


def filter_regex(df: DataFrame, field: str | None = None, pattern: str = "", exclude: bool = False,
                 **_: object) -> DataFrame:
    pattern = str(pattern or "")
    if len(pattern) > 300:
        raise ValueError("Regular-expression patterns are limited to 300 characters.")
    re.compile(pattern)
    matched = py_str_field(df, str(field or "")).rlike(R.to_java(pattern))
    return df.filter(~matched if exclude else matched)


def filter_lookup(df: DataFrame, equals: dict | None = None, within: dict | None = None, **_: object) -> DataFrame:
    """Equality and IN filters (owner = x, status IN (...))."""
    cond = F.lit(True)
    for name, value in (equals or {}).items():
        cond = cond & (F.col(name) == F.lit(value))
    for name, values in (within or {}).items():
        cond = cond & F.col(name).isin(list(values))
    return df.filter(cond)
