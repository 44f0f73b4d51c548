"""Dataset readers: CSV, JSON Lines, JSON, text, Parquet, image archives,
event logs and file manifests, each returning a DataFrame.

All readers are plain ``spark.read`` scans, so splits, column pruning and
filter push-down come from the data source.  Multi-line CSV and JSON arrays
are one task per file (the formats are not splittable); line formats split
freely.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pyregex import SPACE, SPACE_BODY

CORRUPT = "_corrupt_record"

# File-extension → format and MIME → format lookups.
EXTENSION_FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".txt": "txt",
                     ".parquet": "parquet", ".zip": "zip"}
MIME_FORMATS = {"text/csv": "csv", "application/json": "json", "application/x-ndjson": "jsonl",
                "text/plain": "txt", "application/vnd.apache.parquet": "parquet"}
IMAGE_SUFFIXES = {".png", ".jpg", ".jpeg", ".webp", ".bmp"}


class SourceError(ValueError):
    pass


def detect_format(filename: str, content_type: str | None = None) -> str:
    """Format by file name, else by MIME type (parameters ignored)."""
    media = (content_type or "").partition(";")[0].strip().lower()
    known = (EXTENSION_FORMATS.get(posixpath.splitext(filename)[1].lower()), MIME_FORMATS.get(media))
    for fmt in known:
        if fmt:
            return fmt
    raise SourceError(f"No reader for {filename!r}; known formats: {', '.join(sorted(set(EXTENSION_FORMATS.values())))}.")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header required, all columns strings, quoted multi-line cells.

    A blank cell is ``''``; a cell that a short row does not have is null;
    surplus cells are dropped; the reader strips the BOM.  Spark reads both
    blank and absent cells as null, but hands out the raw record of rows with
    a wrong number of cells; the number of separators outside quotes tells the
    two apart there."""
    reader = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
              .option("inferSchema", False).option("mode", "PERMISSIVE").option("encoding", "UTF-8"))
    columns = reader.csv(path).columns
    if not columns:
        raise SourceError("The CSV has no header row.")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    df = reader.option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).schema(schema).csv(path)
    cells = F.length(F.regexp_replace(F.regexp_replace(F.col(CORRUPT), '"(?:[^"]|"")*"', ""), "[^,]", "")) + 1
    return df.select(*[F.when(F.col(f"`{c}`").isNull() & (F.col(CORRUPT).isNull() | (cells > i)), F.lit(""))
                       .otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(columns)])


def blank_cells_to_empty(df: DataFrame) -> DataFrame:
    """Every null text as ``''``, for callers that do not tell absent cells from
    blank ones."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None,
               strict: bool = True) -> DataFrame:
    """One object per non-blank line.  ``strict`` fails on the first bad line
    (FAILFAST); otherwise bad lines land in ``_corrupt_record``."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as variant objects in the one column ``record``: keys may hold
    values of different kinds from row to row, where ``read_jsonl`` would widen
    a column to text.  Blank lines are left out; a line that is not a JSON
    object raises when it is read."""
    line = F.regexp_replace("value", "^\uFEFF", "")
    parsed = F.try_parse_json(line)
    bad = parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT")
    record = F.when(bad, F.raise_error(F.concat(F.lit("Not a JSON object: "), F.substring(line, 1, 200)))
                    .cast("variant")).otherwise(parsed)
    return spark.read.text(path).filter(F.col("value").rlike(r"\S")).select(record.alias("record"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, ``{"data": [...]}`` or one object."""
    df = spark.read.option("multiLine", True).json(path)
    data = [f for f in df.schema.fields if f.name == "data"]
    if data and isinstance(data[0].dataType, T.ArrayType) and isinstance(data[0].dataType.elementType, T.StructType):
        return df.select(F.inline("data"))
    return df


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One ``{text}`` row per non-blank line, stripped."""
    raw = spark.read.text(path)
    text = F.regexp_replace(F.regexp_replace(F.col("value"), "^\\x{FEFF}", ""), f"^{SPACE}+|{SPACE}+$", "")
    return raw.select(text.alias("text")).filter(F.col("text") != "")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or detect_format(path)
    return {"csv": read_csv, "jsonl": read_jsonl, "json": read_json, "txt": read_text_lines,
            "parquet": read_parquet, "zip": read_image_archive}[fmt](spark, path)


_ARCHIVE_SCHEMA = T.StructType([T.StructField("archive", T.StringType()), T.StructField("image", T.StringType()),
                                T.StructField("label", T.StringType()), T.StructField("content", T.BinaryType()),
                                T.StructField("error", T.StringType())])


def _member_label(name: str) -> str | None:
    """Parent folder of an image member (``unlabeled`` at the top); None for
    members that are not images; an error for paths that leave the archive."""
    steps = name.replace("\\", "/").split("/")
    if steps[0] == "" or ".." in steps:
        raise SourceError(f"{name!r} points outside the archive.")
    folders = [s for s in steps[:-1] if s not in ("", ".")]
    if posixpath.splitext(steps[-1])[1].lower() not in IMAGE_SUFFIXES:
        return None
    return folders[-1] if folders else "unlabeled"


def _archive_rows(path: str, content: bytes, with_bytes: bool) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            labelled = [(m, _member_label(m.filename)) for m in archive.infolist() if not m.is_dir()]
            for member, label in labelled:
                if label is not None:
                    yield path, member.filename, label, archive.read(member) if with_bytes else None, None
    except (zipfile.BadZipFile, SourceError) as exc:
        yield path, None, None, None, str(exc)


def _list_members(batches: Iterator[pd.DataFrame], with_bytes: bool, rows: int = 64) -> Iterator[pd.DataFrame]:
    columns = ["archive", "image", "label", "content", "error"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            out = []
            for row in _archive_rows(path, content, with_bytes):
                out.append(row)
                if len(out) >= rows:   # members leave in small batches
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)


def read_image_archive(spark: SparkSession, path: str, with_bytes: bool = False) -> DataFrame:
    """ZIP members with an image suffix → ``(archive, image, label, error)``,
    with ``with_bytes`` also their ``content``; label = parent folder or
    ``unlabeled``.  An archive that cannot be read is one row with its
    ``error``.  One task per archive (the format limit); members stream out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    out = files.select("path", "content").mapInPandas(lambda it: _list_members(it, with_bytes), _ARCHIVE_SCHEMA)
    return out if with_bytes else out.drop("content")


def read_image_folders(spark: SparkSession, path: str) -> DataFrame:
    """Images stored as files in label folders → ``(image, label, content)``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))
    return (files.filter(suffix.isin(*sorted(IMAGE_SUFFIXES)))
            .select(F.col("path").alias("image"), F.element_at(F.split("path", "/"), -2).alias("label"), "content"))


def read_event_log(spark: SparkSession, path: str, schema: T.StructType, limit: int = 0) -> DataFrame:
    """Every JSONL entry with its line position; malformed lines are kept as
    ``message = raw line``.  ``limit`` keeps the last N entries (0 = all)."""
    from ..plans.ordering import SN, with_source_number

    lines = with_source_number(spark.read.text(path))
    parsed = F.from_json(F.col("value"), schema, {"mode": "PERMISSIVE"})
    is_object = F.try_parse_json(F.col("value")).isNotNull() & F.regexp_replace("value", f"^[{SPACE_BODY}]+", "").startswith("{")
    out = lines.select(F.col(SN).alias("line"), F.when(is_object, parsed).alias("entry"),
                       F.when(~is_object, F.col("value")).alias("message"))
    out = out.select("line", "entry.*", "message")
    if limit:
        out = out.orderBy(F.col("line").desc()).limit(int(limit))
    return out


def read_error_events(spark: SparkSession, path: str, schema: T.StructType, limit: int = 100) -> DataFrame:
    """The valid object lines among the last ``limit`` lines, newest first."""
    log = read_event_log(spark, path, schema, limit=max(1, int(limit)))
    return log.filter(F.col("message").isNull()).drop("message").orderBy(F.col("line").desc())


def file_manifest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, relative, size, sha256)`` per file; one task per file split of
    the listing, content read by the binary source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    base = path.rstrip("/")
    rel = F.regexp_replace(F.col("path"), "^.*?" + base.replace(".", "\\.") + "/", "")
    return files.select("path", rel.alias("relative"), F.col("length").alias("size"),
                        F.sha2(F.col("content"), 256).alias("sha256"))


def verify_manifest(expected: DataFrame, actual: DataFrame, key: str = "relative") -> DataFrame:
    """Full outer join on path → status ok / missing / extra / changed."""
    e = expected.select(F.col(key).alias("k"), F.col("sha256").alias("expected_sha256"))
    a = actual.select(F.col(key).alias("k"), F.col("sha256").alias("actual_sha256"))
    j = e.join(a, "k", "full_outer")
    status = (F.when(F.col("actual_sha256").isNull(), "missing")
              .when(F.col("expected_sha256").isNull(), "extra")
              .when(F.col("actual_sha256") != F.col("expected_sha256"), "changed")
              .otherwise("ok"))
    return j.select(F.col("k").alias(key), "expected_sha256", "actual_sha256", status.alias("status"))


def directory_fingerprint(manifest: DataFrame, fanout: int = 4096) -> str:
    """One hash over (relative path, file hash) in path order (bounded Merkle)."""
    from ..plans.ordering import with_global_position
    from ..plans.version import merkle_fingerprint

    pos = with_global_position(manifest.select("relative", "sha256"), [F.col("relative")], "pos")
    return merkle_fingerprint(pos, F.col("pos"), F.concat_ws("\u0000", "relative", "sha256"), fanout)
