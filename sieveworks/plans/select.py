"""Exact k-th smallest by histogram narrowing.

Finding one order statistic (a median, the n-th row of a seeded shuffle,
the limit boundary) must not shuffle every row.  Each pass scans the input
once and counts rows per bucket with a partial aggregate (at most 4096
groups leave each task); the bucket holding rank k is kept and
split again.  Once a bucket holds at most ``final_rows`` rows they are
collected, sorted and indexed.  Pass count is logarithmic in the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINAL_ROWS = 100_000  # (key, id) pairs that the last step brings to the driver


def kth_hex(df: DataFrame, key: str, tie: str, k: int, width: int = 3, final_rows: int = FINAL_ROWS):
    """Row ``(key, tie)`` at 1-based rank ``k`` of ``df`` ordered by
    (key, tie), for uniformly distributed hex-string keys (SHA digests)."""
    base = df.select(key, tie)
    before = 0
    prefix = ""
    cond = F.lit(True)
    while True:
        depth = len(prefix) + width
        counts = sorted(base.filter(cond).groupBy(F.substring(key, 1, depth).alias("b"))
                        .agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["b"])
        total = sum(r["n"] for r in counts)
        if total <= final_rows or depth >= 64:
            rows = sorted(base.filter(cond).collect(), key=lambda r: (r[key], r[tie]))
            return rows[k - before - 1]
        for r in counts:
            if before + r["n"] >= k:
                prefix = r["b"]
                break
            before += r["n"]
        cond = F.substring(key, 1, len(prefix)) == F.lit(prefix)


def kth_value(df: DataFrame, col: str, k: int, buckets: int = 4096, final_rows: int = FINAL_ROWS):
    """Value at 1-based rank ``k`` of the non-null numeric column ``col``."""
    base = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    before = 0
    lo, hi = None, None
    while True:
        scope = base if lo is None else base.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        if lo is None:
            stats = scope.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
            lo, hi, total = stats["lo"], stats["hi"], stats["n"]
        else:
            total = scope.count()
        if lo == hi:
            return lo
        if total <= final_rows:
            vals = sorted(r["v"] for r in scope.collect())
            return vals[k - before - 1]
        bucket = F.width_bucket(F.col("v"), F.lit(lo), F.lit(hi), F.lit(buckets))
        counts = sorted(scope.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                                             F.max("v").alias("hi")).collect(), key=lambda r: r["b"])
        for r in counts:
            if before + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            before += r["n"]


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], bounds: dict[str, tuple[float, float]],
                     buckets: int = 4096) -> dict[str, list[float]]:
    """The values at the 1-based ``ranks`` of several double columns (nulls do
    not count), all columns narrowed in the same passes.

    ``bounds`` are each column's least and largest value.  A pass counts the
    rows of every open bracket in parts with one aggregate and keeps each
    part's own least and largest value.  Parts are equal in value and, where a
    bracket spans orders of magnitude, in logarithm as well, so a task sends at
    most two times ``buckets`` groups per bracket.  A rank that is the first or last of its part,
    or whose part holds one value, is found; the others go on with their part.
    The number of passes grows with the logarithm of the rows and not with the
    number of columns; no row reaches the driver."""
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, float, float, int], set[int]] = {}
    for name, wanted in ranks.items():
        low, high = bounds[name]
        if low == high:
            found.update({(name, k): low for k in wanted})
        else:
            open_[name, low, high, 0] = set(wanted)
    while open_:
        brackets = list(open_)
        entries = []
        for i, (name, low, high, _) in enumerate(brackets):
            v = F.col(name)
            entries.append(F.when((v >= low) & (v <= high), F.struct(
                F.lit(i).alias("i"), F.array(*_parts(v, low, high, buckets)).alias("part"), v.alias("v"))))
        seen = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
        parts: dict[int, list] = {}
        for row in sorted(seen.groupBy("i", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"),
                                                        F.max("v").alias("high")).collect()):
            parts.setdefault(row["i"], []).append(row)
        onward: dict[tuple[str, float, float, int], set[int]] = {}
        for i, bracket in enumerate(brackets):
            name, before = bracket[0], bracket[3]
            wanted = open_[bracket]
            for row in parts.get(i, []):
                for k in [k for k in wanted if before < k <= before + row["n"]]:
                    if k == before + 1 or row["low"] == row["high"]:
                        found[name, k] = row["low"]
                    elif k == before + row["n"]:
                        found[name, k] = row["high"]
                    else:
                        onward.setdefault((name, row["low"], row["high"], before), set()).add(k)
                before += row["n"]
        open_ = onward
    return {name: [found[name, k] for k in wanted] for name, wanted in ranks.items()}


def _parts(v: Column, low: float, high: float, buckets: int) -> list[Column]:
    """Numbers that grow with ``v`` over the bracket."""
    def cut(share: Column) -> Column:
        return F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")

    # the width of the widest brackets is beyond the largest double
    half = 0.5 if high - low == float("inf") else 1.0
    parts = [cut((v * half - low * half) / (high * half - low * half))]
    most = max(abs(low), abs(high))
    if high - low <= most / 2:
        return parts
    if low > 0:
        scale, least, largest = F.log(v), math.log(low), math.log(high)
    elif high < 0:
        scale, least, largest = -F.log(-v), -math.log(-low), -math.log(-high)
    else:
        unit = most * 1e-18
        if unit == 0:
            return parts
        scale = F.signum(v) * F.log1p(F.abs(v) / unit)
        least, largest = (math.copysign(math.log1p(abs(x) / unit), x) for x in (low, high))
    return [*parts, F.greatest(F.lit(0), cut((scale - least) / (largest - least)))]
