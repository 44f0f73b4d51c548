"""What the two vector searches share: valid rows, blocks of bounded size and
the merge of partial rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """A vector that is present and holds numbers only (no null, NaN or
    infinity)."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def valid_rows(df: DataFrame, id_col: str, vec_col: str, vec: Column | None = None) -> DataFrame:
    """(id, vec, dim) of the rows that take part: an id and a finite vector.
    A row repeated with the same id and vector counts once."""
    source = F.col(vec_col)
    return (df.filter(F.col(id_col).isNotNull() & finite(source))
            .select(F.col(id_col).cast("long").alias("id"), (source if vec is None else vec).alias("vec"),
                    F.size(source).alias("dim"))
            .dropDuplicates(["id", "vec"]))


def packs(queries: DataFrame, rows: int) -> DataFrame:
    """Adds ``pack``: queries of one dimension in groups of about ``rows``, so
    that a task holds one pack, however many queries there are."""
    n = queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    sized = n.select("dim", F.greatest(F.lit(1), F.ceil(F.col("n") / rows)).cast("int").alias("n_packs"))
    return (queries.join(sized, "dim")
            .withColumn("pack", F.pmod(F.xxhash64("key"), F.col("n_packs")).cast("int")).drop("n_packs"))


def merge_top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all its partial rankings (each task
    passes on at most k rows a query)."""
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
