"""Column expressions that reproduce Python's ``str()`` and ``float()``.

The reference works on Python dicts, so ``str(value)`` and ``float(value)``
decide the outcome of joins, hashes, length filters and numeric filters.
These helpers keep that behaviour inside Catalyst expressions (no UDF).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pyregex import SPACE, SPACE_BODY

NONE_TEXT = "None"


def dtype_of(df: DataFrame, name: str) -> T.DataType | None:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    return None


@F.pandas_udf(T.StringType())
def _float_repr(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else repr(float(v)))


def py_float_repr(c: Column) -> Column:
    """``repr(float)`` for a double column.

    Python's shortest round-trip digits and layout are the definition, and
    the JVM's ``toString`` is not always shortest (JDK 17), so this is a
    small Arrow-batched pandas UDF; it only runs where a double is turned
    into text (joins of columns, hashes, templates, string conversion)."""
    x = c.cast("double")
    return F.when(x.isNotNull(), _float_repr(x))


def py_str(c: Column, dtype: T.DataType | None, null_text: str = NONE_TEXT) -> Column:
    """``str(value)`` for a present column (``None`` for null by default)."""
    if dtype is None or isinstance(dtype, T.StringType):
        out = c
    elif isinstance(dtype, T.BooleanType):
        out = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        out = F.when(c.isNotNull(), py_float_repr(c.cast("double")))
    elif isinstance(dtype, T.TimestampType) or isinstance(dtype, T.TimestampNTZType):
        out = F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
            .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        # documented deviation: JSON text instead of Python repr
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(null_text)) if null_text is not None else out


def py_str_field(df: DataFrame, name: str, absent_text: str = "") -> Column:
    """``str(row.get(name, absent_text))``: absent columns give ``absent_text``."""
    dtype = dtype_of(df, name)
    if dtype is None:
        return F.lit(absent_text)
    return py_str(F.col(name), dtype)


_FLOAT_TEXT = (
    "^[+-]?(?:(?:[0-9](?:_?[0-9])*)?\\.?[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\\.)"
    "(?:[eE][+-]?[0-9](?:_?[0-9])*)?$"
)


def py_float(c: Column, dtype: T.DataType | None) -> Column:
    """``float(value)``; null where Python raises (TypeError/ValueError)."""
    if dtype is None:
        return F.lit(None).cast("double")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit(1.0)).when(~c, F.lit(0.0))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("double")
    s = F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    low = F.lower(s)
    special = (F.when(low.rlike("^[+]?(inf|infinity)$"), F.lit(float("inf")))
               .when(low.rlike("^-(inf|infinity)$"), F.lit(float("-inf")))
               .when(low.rlike("^[+-]?nan$"), F.lit(float("nan"))))
    numeric = F.when(s.rlike(_FLOAT_TEXT), F.regexp_replace(s, "_", "").try_cast("double"))
    return F.coalesce(special, numeric)


_INT_TEXT = "^[+-]?[0-9](?:_?[0-9])*$"


def py_int(c: Column, dtype: T.DataType | None) -> Column:
    """``int(value)``; null where Python raises."""
    if dtype is None:
        return F.lit(None).cast("long")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit(1)).when(~c, F.lit(0)).cast("long")
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.when(~F.isnan(c.cast("double")), c.cast("long"))
    if isinstance(dtype, T.IntegralType):
        return c.cast("long")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("long")
    s = F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(s.rlike(_INT_TEXT), F.regexp_replace(s, "_", "").try_cast("long"))


def is_blank(c: Column) -> Column:
    """``not value.strip()`` for a string column (Python whitespace)."""
    return c.rlike(f"^[{SPACE_BODY}]*$")
