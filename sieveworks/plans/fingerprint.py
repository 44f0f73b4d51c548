"""Order-free fingerprint of a table of lines: a tree of digest buckets.

A line's SHA-256 puts it into the bucket of its first hex digits.  A bucket's
digest covers its distinct line digests with their counts, in digest order; the
digests of 256 neighbouring buckets make the digest of the bucket two digits
up, and so on to the root.  Equal multisets of lines have equal roots in
whatever order and partitioning they lie; copies are counted before they are
shuffled, and no row is ever sorted among all others.

The bucket table is the index for updates: when lines are added or removed,
only the buckets they fall into are computed again (``update_buckets``), and
the root follows from the table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_LINES = 256   # distinct lines that a bucket holds on average
STEP = 2             # hex digits between two levels of the tree


def line_counts(df: DataFrame, line: Column) -> DataFrame:
    """``(h, n)``: the distinct line digests and how often each occurs."""
    return df.groupBy(F.sha2(line, 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))


def digits_for(lines: int) -> int:
    """Digits of a bucket, so that it holds at most ``BUCKET_LINES`` of so many
    distinct lines on average."""
    digits = 0
    while lines > BUCKET_LINES * 16 ** digits:
        digits += STEP
    return digits


def fingerprint_buckets(counts: DataFrame, digits: int) -> DataFrame:
    """``(bucket, digest, lines)`` of line counts; ``lines`` with copies."""
    entry = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "n"))),
                                     lambda x: F.concat(x["h"], F.lit(":"), x["n"].cast("string"))), ",")
    return (counts.groupBy(F.substring("h", 1, digits).alias("bucket"))
            .agg(F.sha2(entry, 256).alias("digest"), F.sum("n").alias("lines")))


def fingerprint_root(buckets: DataFrame, digits: int) -> str:
    """Digest over the buckets, level by level; that of no lines is the SHA-256
    of an empty text."""
    level = buckets.select("bucket", "digest")
    while digits > STEP:
        digits -= STEP
        level = _raised(level, digits)
    # at most 256 rows
    rows = sorted((r["bucket"], r["digest"]) for r in level.collect())
    if digits == 0 and rows:
        return rows[0][1]
    return hashlib.sha256(",".join(f"{b}:{d}" for b, d in rows).encode()).hexdigest()


def _raised(level: DataFrame, digits: int) -> DataFrame:
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))),
                                      lambda x: F.concat(x["bucket"], F.lit(":"), x["digest"])), ",")
    return level.groupBy(F.substring("bucket", 1, digits).alias("bucket")).agg(F.sha2(inside, 256).alias("digest"))


def content_fingerprint(df: DataFrame, line: Column, digits: int | None = None) -> str:
    """Root digest of the lines of ``df``; ``digits`` (a multiple of ``STEP``)
    follow from the number of distinct lines unless given."""
    from ..session import materialize

    counts = materialize(line_counts(df, line), "line-counts")
    digits = digits_for(counts.count()) if digits is None else digits
    if digits % STEP:
        raise ValueError(f"digits must be a multiple of {STEP}")
    return fingerprint_root(fingerprint_buckets(counts, digits), digits)


def update_buckets(buckets: DataFrame, counts: DataFrame, added: DataFrame, digits: int) -> DataFrame:
    """The bucket table after ``added`` line counts (negative ones remove
    lines) have come to ``counts``: only the buckets that they fall into are
    computed again, the others are copied."""
    bucket = F.substring("h", 1, digits)
    touched = added.select(bucket.alias("bucket")).distinct()
    old = counts.withColumn("bucket", bucket).join(touched, "bucket", "left_semi").select("h", "n")
    now = old.unionByName(added.select("h", "n")).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 0")
    return buckets.join(touched, "bucket", "left_anti").unionByName(fingerprint_buckets(now, digits))
