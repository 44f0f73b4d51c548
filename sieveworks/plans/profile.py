"""Profiling, duplicate counting and clean-up recommendations.

The whole table is profiled in one aggregate pass (no row cap): every
statistic of every column is a conditional sum / min / max inside a single
``agg``, then unpivoted to one row per column.  Duplicates are counted by
grouping on a SHA-256 of the canonical row, so only 32-byte keys and counts
cross the shuffle and a hot duplicate group collapses map-side.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pyregex as R
from ..functions.pysem import is_blank
from .ordering import user_columns


def value_type(dtype: T.DataType) -> str:
    """The reference's type name for a column's values."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    return "string"


# The reference's names of value kinds.
KINDS = ("array", "boolean", "float", "integer", "null", "object", "string")


def kind_of(value: Column) -> Column:
    """The kind of each variant value, as the reference names it; JSON null and
    a missing value are ``null``.  Whole numbers beyond 64 bits, which variants
    hold as decimals without digits behind the point, are integers."""
    kind = F.schema_of_variant(value)
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1)
    return (F.when(value.isNull() | (kind == "VOID"), "null").when(kind == "BOOLEAN", "boolean")
            .when((kind == "BIGINT") | (F.nullif(digits, F.lit("")).cast("int") >= 19), "integer")
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
            .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("string"))


def text_of(value: Column) -> Column:
    """The text of a variant that holds one, else null."""
    return F.when(kind_of(value) == "string", F.try_variant_get(value, "$", "string"))


def profile_records(records: DataFrame, record: str = "record") -> DataFrame:
    """The profile of open records, one variant object per row (``read_records``
    reads JSON lines as such): ``(column, types, null_count, empty_count,
    minimum_text_length, maximum_text_length, average_text_length, row_count)``
    for every key that occurs.

    A key's values may be of several kinds; ``types`` is the set of them.  A
    row without the key counts as null from the key's first row on.  Every key
    of a row is one small row of the scan, summed per task before the shuffle;
    nothing is collected per key."""
    from .ordering import SN, with_source_number

    numbered = records if SN in records.columns else with_source_number(records)
    total = numbered.agg(F.count(F.lit(1))).first()[0]
    cells = (numbered.select(SN, record).lateralJoin(records.sparkSession.tvf.variant_explode(F.col(record).outer()))
             .select(SN, "key", kind_of(F.col("value")).alias("kind"), text_of(F.col("value")).alias("text"))
             .filter(F.col("key").isNotNull()))
    length = F.length("text")
    found = cells.groupBy("key").agg(
        F.min(SN).alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "null").alias("nulls"),
        *[F.max(F.col("kind") == kind).alias(f"is_{kind}") for kind in KINDS if kind != "null"],
        F.count_if(is_blank(F.col("text"))).alias("empty_count"), F.min(length).cast("long").alias("low"),
        F.max(length).cast("long").alias("high"), F.round(F.avg(length), 2).alias("mean"))
    nulls = (F.lit(total) - F.col("first") + 1 - F.col("n") + F.col("nulls")).cast("long")
    flags = [F.when(nulls > 0 if kind == "null" else F.col(f"is_{kind}"), F.lit(kind)) for kind in KINDS]
    return found.select(F.col("key").alias("column"), F.filter(F.array(*flags), lambda x: x.isNotNull()).alias("types"),
                        nulls.alias("null_count"), "empty_count", F.col("low").alias("minimum_text_length"),
                        F.col("high").alias("maximum_text_length"), F.col("mean").alias("average_text_length"),
                        F.lit(total).cast("long").alias("row_count"), F.col("first").alias("first_row"))


def profile_columns(df: DataFrame) -> DataFrame:
    """``(column, position, types, null_count, empty_count, minimum_text_length,
    maximum_text_length, average_text_length, row_count)``, one row per column.
    A variant column has the kinds of its values as types."""
    cols = user_columns(df)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, name in enumerate(cols):
        c = F.col(name)
        dtype = df.schema[name].dataType
        absent = kind_of(c) == "null" if isinstance(dtype, T.VariantType) else c.isNull()
        aggs.append(F.count_if(absent).alias(f"n{i}"))
        aggs.append(F.count_if(~absent).alias(f"v{i}"))
        if isinstance(dtype, T.VariantType):
            aggs += [F.max(kind_of(c) == kind).alias(f"k{i}_{kind}") for kind in KINDS]
            c = text_of(c)
        if isinstance(dtype, (T.StringType, T.VariantType)):
            ln = F.length(c)
            aggs += [F.count_if(is_blank(c)).alias(f"e{i}"), F.min(ln).alias(f"lo{i}"), F.max(ln).alias(f"hi{i}"),
                     F.avg(ln).alias(f"av{i}")]
        else:
            aggs += [F.lit(0).cast("long").alias(f"e{i}"), F.lit(None).cast("int").alias(f"lo{i}"),
                     F.lit(None).cast("int").alias(f"hi{i}"), F.lit(None).cast("double").alias(f"av{i}")]
    wide = df.agg(*aggs)
    entries = []
    for i, name in enumerate(cols):
        t = value_type(df.schema[name].dataType)
        seen = [F.when(F.col(f"n{i}") > 0, F.lit("null")), F.when(F.col(f"v{i}") > 0, F.lit(t))]
        if isinstance(df.schema[name].dataType, T.VariantType):
            seen = [F.when(F.col(f"k{i}_{kind}"), F.lit(kind)) for kind in KINDS]
        types = F.array_sort(F.filter(F.array(*seen), lambda x: x.isNotNull()))
        entries.append(F.struct(F.lit(name).alias("column"), F.lit(i).alias("position"), types.alias("types"),
                                F.col(f"n{i}").cast("long").alias("null_count"),
                                F.col(f"e{i}").cast("long").alias("empty_count"),
                                F.col(f"lo{i}").cast("long").alias("minimum_text_length"),
                                F.col(f"hi{i}").cast("long").alias("maximum_text_length"),
                                F.round(F.col(f"av{i}"), 2).alias("average_text_length")))
    return wide.select(F.col("__rows").alias("row_count"), F.inline(F.array(*entries))) \
        .select("column", "position", "types", "null_count", "empty_count", "minimum_text_length",
                "maximum_text_length", "average_text_length", "row_count")


def infer_types(df: DataFrame) -> DataFrame:
    """``(column, types)`` — the set of value types seen per column; for records
    (a single variant column ``record``) per key."""
    if user_columns(df) == ["record"] and isinstance(df.schema["record"].dataType, T.VariantType):
        return profile_records(df).select("column", F.array_join("types", ",").alias("types"))
    return profile_columns(df).select("column", F.array_join("types", ",").alias("types"))


def row_hash(df: DataFrame) -> F.Column:
    cols = sorted(user_columns(df))
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}), 256)


def duplicate_count(df: DataFrame) -> DataFrame:
    """``rows − distinct rows`` by canonical row hash (one row)."""
    per = df.groupBy(row_hash(df).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
                   (F.sum("n") - F.count(F.lit(1))).cast("long").alias("duplicate_count"))


# Roles and the column names suggested for them.
POSSIBLE_FIELDS: dict[str, list[str]] = {
    "prompt": ["prompt", "instruction", "question", "input"],
    "response": ["response", "story", "completion", "output", "answer"],
    "text": ["text", "content", "body"],
    "label": ["label", "category", "class", "target"],
    "image": ["image", "image_path", "file"],
    "caption": ["caption", "description"],
}


def possible_fields(columns: list[str]) -> dict[str, list[str]]:
    lowered = {c.lower(): c for c in columns}
    return {role: [lowered[n] for n in names if n in lowered] for role, names in POSSIBLE_FIELDS.items()}


def _evidence(df: DataFrame) -> DataFrame:
    """One aggregate pass with every number behind the rules: empty/null
    cells, longest text, rows, and the five whole-table text flags."""
    fields = [f for f in df.schema.fields if not f.name.startswith("__sw_")]
    texts = [F.col(f.name) for f in fields if isinstance(f.dataType, T.StringType)]

    def any_of(pred) -> F.Column:
        if not texts:
            return F.lit(False)
        hits = [F.coalesce(pred(c), F.lit(False)).cast("int") for c in texts]
        return F.max(F.greatest(*hits) if len(hits) > 1 else hits[0]) > 0

    empties = [F.when(F.col(f.name).isNull(), 1).otherwise(0) for f in fields] + \
        [F.when(is_blank(c), 1).otherwise(0) for c in texts]
    longest = F.greatest(*[F.length(c) for c in texts]) if len(texts) > 1 else (
        F.length(texts[0]) if texts else F.lit(None).cast("int"))
    return df.agg(
        F.sum(sum(empties[1:], empties[0]) if empties else F.lit(0)).alias("empty"),
        F.max(longest).alias("longest"), F.count(F.lit(1)).alias("rows"),
        # a plain search first: most texts hold none of these and skip the pattern
        any_of(lambda c: c.contains("  ") | c.rlike(f"^{R.SPACE}|{R.SPACE}\\z")).alias("spacing"),
        any_of(lambda c: c.contains("<") & c.rlike("<[^>]+>")).alias("html"),
        any_of(lambda c: c.contains("://") & c.rlike("(?i)https?://") | c.rlike("(?i)www\\.")).alias("urls"),
        any_of(lambda c: c.rlike("[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}]")).alias("control"),
        any_of(lambda c: c.contains("@") & c.rlike(R.to_java(r"[\w.+-]@[\w.-]+\.[A-Za-z]{2,}"))).alias("emails"),
    )


# Recommendations: operation, title, severity and detail ({n}: what is counted).
RULES = {
    "duplicates": ("remove_duplicates", "Remove duplicate examples", "warning", "{n} rows repeat an earlier one."),
    "empty": ("remove_empty_records", "Remove incomplete examples", "warning", "{n} cells are null or blank."),
    "spacing": ("trim_whitespace", "Tidy white space", "suggestion", "Texts begin, end or go on with surplus blanks."),
    "html": ("remove_html", "Strip markup", "suggestion", "Tags would be learned as if they were language."),
    "urls": ("remove_urls", "Check links", "suggestion", "Links stay useful only where links are the task."),
    "control": ("remove_control_characters", "Drop control characters", "warning", "Invisible characters upset parsers."),
    "emails": ("redact_emails", "Check e-mail addresses", "privacy", "Addresses name people: hide those not needed."),
    "long": (None, "Long texts", "warning", "The longest text has {n} characters: filter by length or cut."),
    "small": (None, "Few rows", "warning", "{n} rows are little to learn from."),
    "fields": (None, "Name the input columns", "warning", "No column is named like a text, a prompt or an image."),
    "images": (None, "Repair unreadable images", "warning", "{n} images can't be decoded."),
    "none": (None, "Nothing to clean up", "ready", "No rule found anything."),
}
RECOMMENDATION = ("operation string, title string, detail string, severity string, affected long, "
                  "auto_applicable boolean")


def recommend_cleanup(df: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """``(operation, title, detail, severity, affected, auto_applicable)`` from
    whole-table evidence; with decoded ``images`` also about those.

    Two passes: one aggregate for every count and flag, one hash aggregate
    for duplicates.  The text rules are evaluated over every row (the
    reference looks at a 20-row sample; scanning all rows finds a superset).
    """
    roles = possible_fields(user_columns(df))
    evidence = _evidence(df).first()
    found: dict[str, int | None] = {"duplicates": duplicate_count(df).first()["duplicate_count"], "empty": evidence["empty"]}
    found |= {flag: None for flag in ("spacing", "html", "urls", "control", "emails") if evidence[flag]}
    found["long"] = evidence["longest"] if (evidence["longest"] or 0) > 16_000 else 0
    found["small"] = evidence["rows"] if evidence["rows"] < 20 else 0
    if not (roles["text"] or roles["prompt"] or roles["image"]):
        found["fields"] = None
    if images is not None:
        found["images"] = images.agg(F.count_if(~(F.col("height") > 0))).first()[0]
    names = [name for name, n in found.items() if n is None or n > 0] or ["none"]
    out: list[tuple[Any, ...]] = []
    for name in names:
        operation, title, severity, detail = RULES[name]
        n = found.get(name)
        out.append((operation, title, detail.format(n=n), severity, n, operation is not None))
    return df.sparkSession.createDataFrame(out, RECOMMENDATION)


def suggested_fields(df: DataFrame) -> DataFrame:
    """``(role, columns)``: the columns whose names suggest each role."""
    rows = [(role, names) for role, names in possible_fields(user_columns(df)).items()]
    return df.sparkSession.createDataFrame(rows, "role string, columns array<string>")
