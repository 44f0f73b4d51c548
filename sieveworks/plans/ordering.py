"""Source order, global positions, seeded shuffles and splits.

The reference numbers rows by their position in the source file and cuts
"first N" prefixes in that order.  Spark has no row order, so order is made
explicit:

* ``with_source_order`` keys every row by (file, position in file) from the
  scan's hidden ``_metadata`` columns: exact file order, no shuffle.
* ``with_global_position`` turns any unique sort key into a dense 1-based
  position with one range shuffle, one stored table and a per-partition count
  (the zipWithIndex idea, kept in the DataFrame API).  It never funnels
  rows through a single partition.
* Seeded shuffles and splits order by ``sha2(seed:id)``: the same hash is
  available in SQL engines, so results can be cross-checked.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SN = "__sw_sn"          # 1-based source number
ORDER = "__sw_order"    # sortable key of the row's position
RESERVED_PREFIX = "__sw_"


MAXIMUM_CLASSES = 100_000  # of a stratified split: one count each comes to the driver
BROADCAST_SPANS = 100_000  # input splits whose offsets are sent to every executor


def is_file_scan(df: DataFrame) -> bool:
    """Whether the frame still has its files' hidden metadata."""
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(RESERVED_PREFIX)]


def with_source_order(scan: DataFrame, name: str = ORDER) -> DataFrame:
    """Attach ``struct(file, block, row)`` in file order.

    For a plain file-source DataFrame (``spark.read...``) this is file order:
    Parquet exposes the row index inside the file; other formats use the
    split start plus the row's ordinal inside its task, which is ordered
    because a task reads each split sequentially.  Any other DataFrame is
    ordered by partition, then by position inside the partition.
    """
    if not is_file_scan(scan):  # partition order, then row order in it
        return scan.withColumn(name, F.struct(F.lit("").alias("f"), F.spark_partition_id().cast("long").alias("b"),
                                              F.monotonically_increasing_id().alias("r")))
    names = {f.name for f in scan.select("_metadata").schema.fields[0].dataType.fields}
    if "row_index" in names:
        row = F.col("_metadata.row_index")
        block = F.lit(0).cast("long")
    else:
        row = F.monotonically_increasing_id()
        block = F.col("_metadata.file_block_start")
    return scan.withColumn(name, F.struct(F.col("_metadata.file_path").alias("f"),
                                          block.alias("b"), row.alias("r")))


def with_source_number(scan: DataFrame, order: str = ORDER, name: str = SN) -> DataFrame:
    """Dense 1-based source number in file order (``enumerate(rows, 1)``).

    Pass 1 counts rows per (file, block): one row per input split, kept as a
    table.  A bare scan has every row of each split, so a row's number is its
    split's offset plus its place in the split, one narrow join.  A scan that
    was filtered before has gaps; its order keys are then ranked by one range
    shuffle.  Anything that is not a file scan is written first, because
    its order (partition, place) must not change between the passes.
    """
    from ..session import materialize

    if order not in scan.columns:
        if not is_file_scan(scan):
            scan = materialize(with_source_order(scan, order), "ordered")
        else:
            scan = with_source_order(scan, order)
    at = F.col(f"{order}.r")
    spans = (scan.groupBy(F.col(f"{order}.f").alias("__sw_f"), F.col(f"{order}.b").alias("__sw_b"))
             .agg(F.count(F.lit(1)).alias("__sw_n"), F.min(at).alias("__sw_r0"), F.max(at).alias("__sw_r1")))
    spans = materialize(spans, "spans")
    if not spans.filter("__sw_r1 - __sw_r0 + 1 <> __sw_n").isEmpty():
        # rows are missing inside a split (a filtered scan): rank them
        narrow = scan.select(F.col(order).alias("__sw_o"))
        dense = with_global_position(narrow, [F.col("__sw_o")], "__sw_p")
        return scan.join(dense, F.col(order) == F.col("__sw_o")).withColumn(name, F.col("__sw_p")).drop("__sw_o", "__sw_p")
    running = Window.orderBy("__sw_f", "__sw_b").rowsBetween(Window.unboundedPreceding, -1)
    table = materialize(spans.withColumn("__sw_off", F.coalesce(F.sum("__sw_n").over(running), F.lit(0)))
                        .select("__sw_f", "__sw_b", "__sw_off", "__sw_r0"), "offsets")
    if table.count() <= BROADCAST_SPANS:  # else shuffled, with the same result
        table = F.broadcast(table)
    joined = scan.join(table, (F.col(f"{order}.f") == F.col("__sw_f")) & (F.col(f"{order}.b") == F.col("__sw_b")))
    number = F.col("__sw_off") + at - F.col("__sw_r0") + 1
    return joined.withColumn(name, number).drop("__sw_f", "__sw_b", "__sw_off", "__sw_r0")


def with_global_position(df: DataFrame, keys: list[Column], name: str = "position",
                         partitions: int | None = None) -> DataFrame:
    """Dense 1-based position of each row under the order ``keys``.

    ``keys`` must be unique per row (add an id as tie-breaker).  Rows are
    range-partitioned and sorted per partition, and each row's partition id
    and ordinal are stored with it in a table written once under the shared
    checkpoint directory: the range bounds come from sampling, so a
    recomputed shuffle could place rows differently, while the stored
    columns pin one placement for both the per-partition count (one number
    per partition) and the numbering.
    """
    from ..session import materialize

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pid = "__sw_pid"
    ordered = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                          .withColumn(pid, F.spark_partition_id())
                          .withColumn("__sw_mono", F.monotonically_increasing_id()), "positions")
    counts = dict(ordered.groupBy(pid).count().collect())  # <= n rows
    offsets, total = [], 0
    for p in range(n):
        offsets.append(total)
        total += int(counts.get(p, 0))
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col(pid) + 1)
    local = F.col("__sw_mono") - F.shiftleft(F.col(pid).cast("long"), 33)
    return ordered.withColumn(name, off + local + 1).drop(pid, "__sw_mono")


def seeded_key(seed: int, ident: Column) -> Column:
    """Deterministic pseudo-random order key for a row id."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), ident.cast("string")), 256)


def shuffle(df: DataFrame, id_col: str, seed: int = 42, key: str = "shuffle_key") -> DataFrame:
    """Seeded permutation: rows ordered by ``sha2(seed:id)`` (a global sort,
    range-partitioned, so no single-task bottleneck)."""
    return df.withColumn(key, seeded_key(seed, F.col(id_col))).orderBy(key, id_col)


def head_examples(df: DataFrame, order: list[Column], n: int = 0) -> DataFrame:
    """First ``n`` rows in order (0 = all).  Bounded ``n`` only: the top-k
    operator keeps at most ``n`` rows per task."""
    if not n:
        return df
    return df.orderBy(*order).limit(int(n))


def kth_row(df: DataFrame, keys: list[str], k: int):
    """The row of ``df.select(keys)`` at 1-based position ``k`` under ``keys``
    (unique).  Only the narrow key projection is ranked and stored."""
    narrow = df.select(*keys)
    pos = with_global_position(narrow, [F.col(c) for c in keys], "__sw_pos")
    return pos.filter(F.col("__sw_pos") == k).select(*keys).first()


def at_or_before(keys: list[str], row) -> Column:
    """Lexicographic ``(keys) <= row`` as a column predicate."""
    cond = None
    for i in range(len(keys) - 1, -1, -1):
        c, v = F.col(keys[i]), F.lit(row[keys[i]])
        here = (c <= v) if cond is None else ((c < v) | ((c == v) & cond))
        cond = here
    return cond


def split_train_validation(df: DataFrame, id_col: str, fraction: float = 0.2, seed: int = 42,
                           total: int | None = None) -> DataFrame:
    """Adds ``split`` in {train, validation}:
    ``n_val = max(1, min(n-2, round(n * fraction)))`` (half-even rounding).
    The n_val-th smallest ``(sha2(seed:id), id)`` is found by histogram
    narrowing (scans and small aggregates, no row shuffle); every row is
    then labelled by one comparison, no join."""
    from .select import kth_hex

    keyed = df.withColumn("__sw_key", seeded_key(seed, F.col(id_col)))
    n = total if total is not None else df.count()
    n_val = max(1, min(n - 2, int(round(n * fraction))))
    boundary = kth_hex(keyed, "__sw_key", id_col, n_val)
    # keys are fixed-width (64 hex), so (key, id) order is the order of key || id
    joint = F.concat(F.col("__sw_key"), F.col(id_col).cast("string"))
    is_val = joint <= F.lit(boundary["__sw_key"] + str(boundary[id_col]))
    return keyed.withColumn("split", F.when(is_val, "validation").otherwise("train")).drop("__sw_key")


def split_stratified(df: DataFrame, id_col: str, label_col: str, fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Per-class test quota: ``n_test = min(n - C, max(C, round(n * f)))``
    spread over classes proportionally (largest remainder), at least one
    test and one train row per class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("__sw_nc"))
    stats = counts.limit(MAXIMUM_CLASSES + 1).collect()
    if len(stats) > MAXIMUM_CLASSES:
        raise ValueError(f"a stratified split takes at most {MAXIMUM_CLASSES} classes")
    n = sum(int(r["__sw_nc"]) for r in stats)
    c = len(stats)
    n_test = min(n - c, max(c, int(round(n * fraction))))
    quotas = _class_quotas({r[label_col]: int(r["__sw_nc"]) for r in stats}, n_test)
    quota_df = df.sparkSession.createDataFrame(
        [(k, v) for k, v in quotas.items()],
        T.StructType([T.StructField(label_col, df.schema[label_col].dataType), T.StructField("__sw_q", T.LongType())]))
    # rank inside each class from one global range-partitioned order, so a
    # dominant class is spread over all partitions instead of one window task
    keyed = df.withColumn("__sw_key", seeded_key(seed, F.col(id_col)))
    pos = with_global_position(keyed, [F.col(label_col), F.col("__sw_key"), F.col(id_col)], "__sw_pos")
    first = pos.groupBy(F.col(label_col).alias("__sw_l")).agg(F.min("__sw_pos").alias("__sw_first"))
    quota_df = quota_df.withColumnRenamed(label_col, "__sw_ql")
    # null is a class of its own
    ranked = pos.join(first, F.col(label_col).eqNullSafe(F.col("__sw_l"))) \
        .join(F.broadcast(quota_df), F.col(label_col).eqNullSafe(F.col("__sw_ql"))).drop("__sw_l", "__sw_ql") \
        .withColumn("__sw_r", F.col("__sw_pos") - F.col("__sw_first") + 1)
    return (ranked.withColumn("split", F.when(F.col("__sw_r") <= F.col("__sw_q"), "test").otherwise("train"))
            .drop("__sw_r", "__sw_q", "__sw_pos", "__sw_first", "__sw_key"))


def _class_quotas(counts: dict, n_test: int) -> dict:
    n = sum(counts.values())
    raw = {k: n_test * v / n for k, v in counts.items()}
    quota = {k: min(max(1, int(r)), counts[k] - 1) for k, r in raw.items()}
    left = n_test - sum(quota.values())
    for k in sorted(counts, key=lambda k: (-(raw[k] - int(raw[k])), str(k))):
        if left <= 0:
            break
        if quota[k] < counts[k] - 1:
            quota[k] += 1
            left -= 1
    return quota


def sample_rows(df: DataFrame, order: list[Column], n: int = 20, width: int = 500) -> DataFrame:
    """First ``n`` rows with strings cut to ``width`` characters plus "…"."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)
        cols.append(c.alias(f.name))
    return df.orderBy(*order).limit(n).select(*cols)


def top_k_ranked(scores: Column, k: int = 3) -> Column:
    """``sorted(items, key=score, reverse=True)[:k]`` on an array of
    ``struct(label, score)`` (stable for ties, as Python's sort)."""
    indexed = F.transform(scores, lambda x, i: F.struct(x["label"].alias("label"), x["score"].alias("score"),
                                                        i.alias("i")))
    ordered = F.array_sort(indexed, lambda a, b: F.when(a["score"] > b["score"], -1)
                           .when(a["score"] < b["score"], 1)
                           .otherwise(F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)))
    return F.slice(F.transform(ordered, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))),
                   1, k)


def top_n_recent(df: DataFrame, ts_col: str, n: int, tie: str | None = None) -> DataFrame:
    """``ORDER BY ts DESC LIMIT n`` (TakeOrderedAndProject: n rows per task)."""
    order = [F.col(ts_col).desc()] + ([F.col(tie).desc()] if tie else [])
    return df.orderBy(*order).limit(n)
