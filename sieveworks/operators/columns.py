"""Column-shaping operators (row-local projections).

Each operator is ``op(df, **config) -> DataFrame`` and only adds a
Project node, so a chain of them collapses into one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pyregex import SPACE
from ..functions.pysem import dtype_of, py_float, py_int, py_str, py_str_field


class OperationError(ValueError):
    """Raised for an invalid operator configuration."""


def select_columns(df: DataFrame, columns: list[str] | None = None, **_: object) -> DataFrame:
    names = set(df.columns)
    cols = [F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in (columns or [])]
    reserved = [F.col(c) for c in df.columns if c.startswith("__sw_") and c not in (columns or [])]
    return df.select(*cols, *reserved)


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None, **_: object) -> DataFrame:
    for old, new in (mapping or {}).items():
        if old in df.columns and new:
            if old == new:
                continue
            if new in df.columns:
                df = df.drop(new)
            df = df.withColumnRenamed(old, new)
    return df


def remove_columns(df: DataFrame, columns: list[str] | None = None, **_: object) -> DataFrame:
    present = [c for c in (columns or []) if c in df.columns]
    return df.drop(*present) if present else df


def join_columns(df: DataFrame, columns: list[str] | None = None, separator: str = " ",
                 target: str = "joined", **_: object) -> DataFrame:
    parts = [py_str_field(df, c) for c in (columns or [])]
    value = F.concat_ws(separator, *parts) if parts else F.lit("")
    return df.withColumn(target, value)


def split_column(df: DataFrame, field: str | None = None, separator: str = ",",
                 targets: list[str] | None = None, **_: object) -> DataFrame:
    targets = [str(t) for t in (targets or []) if str(t)]
    if not targets:
        return df
    source = py_str_field(df, str(field))
    sep = str(separator)
    if sep == "":
        raise OperationError("empty separator")
    # Python str.split(sep, n-1): at most n pieces, remainder kept whole.
    pieces = F.split(source, "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", len(targets))
    tmp = "__split_pieces"
    df = df.withColumn(tmp, pieces)
    for i, t in enumerate(targets):
        df = df.withColumn(t, F.coalesce(F.get(F.col(tmp), i), F.lit("")))
    return df.drop(tmp)


def add_constant(df: DataFrame, name: str = "constant", value: object = "", **_: object) -> DataFrame:
    return df.withColumn(str(name), F.lit(value))


def fill_missing(df: DataFrame, fields: list[str] | None = None, value: object = "", **_: object) -> DataFrame:
    for f in fields or []:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(value))
            continue
        c = F.col(f)
        dtype = dtype_of(df, f)
        text = isinstance(dtype, T.StringType)
        missing = c.isNull() | (c == "") if text else c.isNull()
        if text or not isinstance(value, str):
            filler, kept = F.lit(str(value) if text and value is not None else value), c
        else:  # a text among other values: the column becomes text
            filler, kept = F.lit(value), py_str(c, dtype)
        df = df.withColumn(f, F.when(missing, filler).otherwise(kept))
    return df


def map_labels(df: DataFrame, field: str | None = None, mapping: dict | None = None, **_: object) -> DataFrame:
    if not field or field not in df.columns or not mapping:
        return df
    key = py_str(F.col(field), dtype_of(df, field))
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(str(k)), F.lit(v)]
    looked_up = F.create_map(*pairs)[key]
    value_type, own_type = dtype_of(df.select(looked_up.alias("v")), "v"), dtype_of(df, field)
    source = F.col(field)
    if value_type != own_type and not (isinstance(value_type, T.NumericType) and isinstance(own_type, T.NumericType)):
        # unmatched rows keep their value, so a mixture becomes text
        source, looked_up = py_str(source, own_type, null_text=None), py_str(looked_up, value_type, null_text=None)
    return df.withColumn(field, F.when(F.map_contains_key(F.create_map(*pairs), key), looked_up).otherwise(source))


def convert_type(df: DataFrame, field: str | None = None, target: str | None = None, **_: object) -> DataFrame:
    if target not in {"string", "integer", "float", "boolean"}:
        raise OperationError("convert_type target must be string, integer, float, or boolean.")
    dtype = dtype_of(df, field) if field else None
    c = F.col(field) if dtype is not None else F.lit(None)
    fail = F.raise_error(F.lit(f"Could not convert field {field!r} to {target}."))
    if target == "string":
        value = py_str(c, dtype, null_text="") if dtype is not None else F.lit("")
    elif target == "boolean":
        text = py_str(c, dtype) if dtype is not None else F.lit("None")
        value = F.lower(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")).isin("1", "true", "yes", "on")
    elif target == "integer":
        parsed = py_int(c, dtype)
        value = F.coalesce(parsed, fail.cast("long"))
    else:
        parsed = py_float(c, dtype)
        value = F.coalesce(parsed, fail.cast("double"))
    return df.withColumn(field, value)


def hash_field(df: DataFrame, field: str | None = None, salt: str | None = None, **_: object) -> DataFrame:
    field = str(field or "")
    if field not in df.columns:
        return df
    text = F.concat(F.lit(str(salt or "")), py_str(F.col(field), dtype_of(df, field)))
    return df.withColumn(field, F.sha2(text, 256))
