"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

__all__ = ["materialize", "free_name", "row_key", "slices", "arrow_append", "spark_schema_with"]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not use (names
    compare without case, as Spark resolves them)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: Column, text_col: Column) -> Column:
    """Identity of a document row: its id together with a digest of its text.

    Rows that share both are the same document repeated and always get the
    same decision; rows that share only the id stay apart.  Null ids and null
    texts have a key of their own.
    """
    return F.sha2(F.concat_ws("\x01", F.coalesce(id_col.cast("string"), F.lit("\x02")),
                              F.coalesce(text_col, F.lit("\x02"))), 256)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a task holds the
    derived columns of a few hundred texts only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spark_schema_with(df: DataFrame, added: list[tuple[str, T.DataType]]) -> T.StructType:
    """Schema of ``df`` after ``arrow_append``: a column of the same name is
    replaced, the others keep their place."""
    new = {n.lower() for n, _ in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    return T.StructType(kept + [T.StructField(n, t, True) for n, t in added])


def arrow_append(batch: pa.RecordBatch, added: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    """``batch`` with columns added; one of the same name is replaced."""
    new = {n.lower() for n, _ in added}
    names = [n for n in batch.schema.names if n.lower() not in new]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays(arrays + [a for _, a in added], names=names + [n for n, _ in added])
