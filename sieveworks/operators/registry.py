"""Operator registry and the ordered fold over a DataFrame.

An operation list ``[{"type": name, "config": {...}}, ...]`` becomes a chain
of lazy DataFrame transformations; Catalyst then collapses the projections,
pushes filters down and compiles the chain into whole-stage code.
"""

from __future__ import annotations

from typing import Any, Callable

from pyspark.sql import DataFrame

from . import columns as C
from . import filters as Fl
from . import text as Tx

OperationError = C.OperationError

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "select_columns": C.select_columns,
    "rename_columns": C.rename_columns,
    "remove_columns": C.remove_columns,
    "join_columns": C.join_columns,
    "split_column": C.split_column,
    "add_constant": C.add_constant,
    "fill_missing": C.fill_missing,
    "map_labels": C.map_labels,
    "convert_type": C.convert_type,
    "hash_field": C.hash_field,
    "trim_whitespace": Tx.trim_whitespace,
    "normalize_unicode": Tx.normalize_unicode,
    "remove_html": Tx.remove_html,
    "remove_urls": Tx.remove_urls,
    "remove_control_characters": Tx.remove_control_characters,
    "replace_text": Tx.replace_text,
    "regex_replace": Tx.regex_replace,
    "lowercase": Tx.lowercase,
    "strip_accents": Tx.strip_accents,
    "redact_emails": Tx.redact_emails,
    "redact_phone_numbers": Tx.redact_phone_numbers,
    "truncate_text": Tx.truncate_text,
    "prepend_text": Tx.prepend_text,
    "append_text": Tx.append_text,
    "remove_empty_records": Fl.remove_empty_records,
    "filter_length": Fl.filter_length,
    "filter_numeric": Fl.filter_numeric,
    "filter_regex": Fl.filter_regex,
}

# Whole-dataset steps: listed in an operation list they do nothing in place;
# dedupe, shuffle and limit act as separate arguments of save_version.
DEFERRED = {"remove_duplicates", "shuffle", "limit_examples"}

# The named clean-up recipes (operation names, in order).
RECIPES: dict[str, list[str]] = {
    "quality": ["trim_whitespace", "normalize_unicode", "remove_control_characters", "remove_empty_records", "remove_duplicates"],
    "web": ["trim_whitespace", "normalize_unicode", "remove_html", "remove_urls", "remove_control_characters", "remove_empty_records", "remove_duplicates"],
    "privacy": ["trim_whitespace", "normalize_unicode", "redact_emails", "redact_phone_numbers", "remove_control_characters", "remove_empty_records", "remove_duplicates"],
    "minimal": ["trim_whitespace", "remove_empty_records"],
}


def recipe(name: str) -> list[dict[str, Any]]:
    if name not in RECIPES:
        raise OperationError(f"Unknown recipe: {name!r}")
    return [{"type": op, "config": {}} for op in RECIPES[name]]


def validate_operations(operations: list[dict[str, Any]]) -> None:
    for op in operations:
        kind = op.get("type")
        if kind not in OPERATORS and kind not in DEFERRED:
            raise OperationError(f"Unsupported transformation operation: {kind!r}.")


def apply_operation(df: DataFrame, operation: dict[str, Any]) -> DataFrame:
    kind = operation.get("type")
    if kind in DEFERRED:
        return df
    if kind not in OPERATORS:
        raise OperationError(f"Unsupported transformation operation: {kind!r}.")
    return OPERATORS[kind](df, **(operation.get("config") or {}))


FILTERS = {"remove_empty_records", "filter_length", "filter_numeric", "filter_regex"}


def apply_operations(df: DataFrame, operations: list[dict[str, Any]]) -> DataFrame:
    """Fold the ordered operation list over ``df`` (row order preserved).

    A filter that reads a rewritten column is anchored on a
    ``spark_partition_id()`` column: Catalyst does not push predicates
    through a projection with a non-deterministic column, so the rewritten
    values (regex chains) are computed once instead of once in the pushed
    filter and again in the projection.  A filter on columns that no operator
    before it has changed is pushed down to the scan."""
    from pyspark.sql import functions as F

    validate_operations(operations)
    rewritten: set[str] = set()
    for op in operations:
        kind = op.get("type")
        if kind in FILTERS and rewritten & _read_by(op, df):
            df = df.withColumn("__sw_anchor", F.spark_partition_id())
            df = apply_operation(df, op)
            df = df.filter(F.col("__sw_anchor") >= 0).drop("__sw_anchor")
            continue
        before = df
        df = apply_operation(df, op)
        if kind not in FILTERS and kind not in DEFERRED:
            rewritten |= _changed_by(op, before, df)
    return df


def _read_by(op: dict[str, Any], df: DataFrame) -> set[str]:
    """Columns that a filter reads."""
    config = op.get("config") or {}
    if op.get("type") == "remove_empty_records":
        return set(config.get("fields") or df.columns)
    return {str(config.get("field"))}


def _changed_by(op: dict[str, Any], before: DataFrame, after: DataFrame) -> set[str]:
    """Columns that an operator may have changed: those it names or adds; all
    when it names none."""
    config = op.get("config") or {}
    if op.get("type") in {"select_columns", "remove_columns"}:
        return set()
    if op.get("type") == "rename_columns":
        return set(after.columns)
    added = set(after.columns) - set(before.columns)
    if op.get("type") in {"add_constant", "join_columns", "split_column"}:
        named = [config.get("name"), config.get("target"), *(config.get("targets") or [])]
        return added | {str(n) for n in named if n}
    named = [*(config.get("fields") or []), config.get("field")]
    named = {str(n) for n in named if n}
    return added | (named or set(after.columns))


def wants_dedupe(operations: list[dict[str, Any]]) -> bool:
    return any(op.get("type") == "remove_duplicates" for op in operations)
