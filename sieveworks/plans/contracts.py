"""Typed input contracts checked as column expressions.

A row submits a map of texts.  ``validate_inputs`` checks it against a list
of fields (name, type, required, default, choices, allow_custom,
depends_on) and adds the typed values and a map of error sentences; nothing
runs row by row in Python.

Types: number (or float), integer, boolean, json, list, string; image and
file values pass as text.  A field whose ``depends_on`` values do not hold is
ignored.  Blank values take the default; a value that does not parse, or is not
among the choices, is an error of its field; names that no field has are
reported together under ``_unknown``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pyregex import SPACE
from ..functions.pysem import py_float, py_int

# Texts that read as true and as false.
TRUE_TEXTS = ("1", "true", "yes", "on")
FALSE_TEXTS = ("0", "false", "no", "off")

_TYPES = {"number": T.DoubleType(), "float": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(),
          "list": T.ArrayType(T.StringType())}


@dataclass
class Field:
    name: str
    type: str = "string"
    required: bool = False
    default: Any = None
    choices: list | None = None
    allow_custom: bool = False
    depends_on: dict[str, Any] = field(default_factory=dict)

    @property
    def spark_type(self) -> T.DataType:
        return _TYPES.get(self.type, T.StringType())


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def _parsed(c: Column, kind: str) -> tuple[Column, str]:
    """Typed value (null where the text does not parse) and what it must be."""
    text = T.StringType()
    if kind in ("number", "float"):
        return py_float(c, text), "must be a number"
    if kind == "integer":
        return py_int(c, text), "must be a whole number"
    if kind == "boolean":
        low = F.lower(_strip(c))
        return F.when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False), "must be true or false"
    if kind == "json":
        return F.when(F.try_parse_json(c).isNotNull(), c), "must be JSON"
    if kind == "list":
        items = F.filter(F.transform(F.split(_strip(c), ","), _strip), lambda x: x != "")
        is_json = _strip(c).startswith("[")
        return F.when(is_json, F.from_json(c, T.ArrayType(T.StringType()))).otherwise(items), "must be a list"
    return c, "must be text"


def _value(submitted: Column, f: Field) -> tuple[Column, Column]:
    """(typed value, error or null) of one field."""
    raw = F.element_at(submitted, F.lit(f.name))
    default = None if f.default is None else str(f.default).lower() if isinstance(f.default, bool) else str(f.default)
    raw = F.coalesce(F.nullif(raw, F.lit("")), F.lit(default).cast("string"))
    value, rule = _parsed(raw, f.type)
    absent = raw.isNull()
    error = F.when(~absent & value.isNull(), F.lit(rule))
    if f.required:
        error = F.when(absent, F.lit("is required")).otherwise(error)
    if f.choices and not f.allow_custom:
        allowed = [F.lit(x).cast(f.spark_type) for x in f.choices]
        named = "must be one of: " + ", ".join(map(str, f.choices))
        error = F.coalesce(error, F.when(value.isNotNull() & ~value.isin(*allowed), F.lit(named)))
    return value.cast(f.spark_type), error


def validate_inputs(df: DataFrame, submitted: str, contract: list[Field], values: str = "values",
                    errors: str = "errors") -> DataFrame:
    """Adds ``values`` (a struct with one typed member per field, null where the
    field is in error or inactive) and ``errors`` (field -> sentence)."""
    got = F.coalesce(F.col(submitted), F.create_map().cast("map<string,string>"))
    by_name = {f.name: f for f in contract}
    typed, problems = [], []
    for f in contract:
        value, error = _value(got, f)
        active = F.lit(True)
        for other, wanted in f.depends_on.items():
            controller = by_name.get(other)
            held = _value(got, controller)[0] if controller else F.lit(None)
            active = active & F.coalesce(held == F.lit(wanted), F.lit(False))
        error = F.when(active, error)
        typed.append(F.when(active & error.isNull(), value).alias(f.name))
        problems.append(F.struct(F.lit(f.name).alias("key"), error.alias("value")))
    names = F.array(*[F.lit(f.name) for f in contract]) if contract else F.array().cast("array<string>")
    unknown = F.array_sort(F.array_except(F.map_keys(got), names))
    problems.append(F.struct(F.lit("_unknown").alias("key"), F.when(F.size(unknown) > 0, F.concat(
        F.lit("not part of the contract: "), F.array_join(unknown, ", "))).alias("value")))
    found = F.map_from_entries(F.filter(F.array(*problems), lambda p: p["value"].isNotNull()))
    return df.withColumns({values: F.struct(*typed) if typed else F.lit(None), errors: found})
