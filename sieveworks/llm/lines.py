"""Line de-duplication over overlapping three-line windows.

Each text is cut at line feeds; every three consecutive lines form a window
that is hashed.  Windows that occur more than once anywhere in the corpus
(within one document too) are found by one aggregate; their first occurrence
in document order stays and the lines covered by any later occurrence go.
Overlapping windows merge: a repeated passage of any length of three lines or
more goes as a whole, and shorter repeats stay.

DataFrame functions only.  The windows cross a shuffle as 128-bit hashes,
summed per task first, so that a window held by a third of all documents
arrives as one row per task; only repeated windows go on, and the text itself
meets the few positions to remove once.

Defined cases: documents are ordered by id (null first), then by a hash of
their text; rows that repeat both id and text are one document and lose the
same lines; a null text stays null with no lines, an empty text has one empty
line; windows whose lines are all blank are not compared, so spacing stays;
columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import materialize

WINDOW = 3


def _hash128(seed: int, *cols: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), *cols), F.xxhash64(F.lit(seed + 1), *cols)


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            window: int = WINDOW, counts: bool = True) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, and with
    ``counts`` also ``n_lines`` and ``n_removed`` (lines before, removed)."""
    key = dict(zip(("__k1", "__k2"), _hash128(7, F.col(id_col), F.col(text_col)), strict=True))
    lines = F.split(F.col(text_col), "\n", -1)

    # windows are hashed inside the row and only the hashes are unnested: a line
    # is never copied for the windows it is part of
    rows = docs.select(F.col(id_col).alias("id"), key["__k1"].alias("k1"), key["__k2"].alias("k2"), lines.alias("lines"))
    n = F.greatest(F.size("lines") - (window - 1), F.lit(0))
    names = [f"l{i}" for i in range(window)]
    zipped = F.arrays_zip(*[F.slice("lines", i + 1, n).alias(c) for i, c in enumerate(names)])

    def digest(z):
        held = [z[c] for c in names]
        blank = F.lit(True)
        for line in held:
            blank = blank & (F.trim(line) == "")
        h1, h2 = _hash128(3, *held)
        return F.struct(blank.alias("blank"), h1.alias("h1"), h2.alias("h2"))

    windows = rows.select("id", "k1", "k2", F.posexplode(F.transform(zipped, digest)).alias("at", "w"))
    windows = materialize(windows.filter("NOT w.blank").select("id", "k1", "k2", "at", "w.h1", "w.h2"), "line-windows")

    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    again = windows.join(repeated, ["h1", "h2"])
    again = materialize(again, "line-repeats")
    first = again.groupBy("h1", "h2").agg(F.min(F.struct("id", "k1", "k2", "at")).alias("first"))
    here = F.struct("id", "k1", "k2", "at")
    later = again.join(first, ["h1", "h2"]).filter(~here.eqNullSafe(F.col("first")))
    gone = later.groupBy("k1", "k2").agg(F.collect_set("at").alias("starts"))
    gone = materialize(gone.select(F.col("k1").alias("__g1"), F.col("k2").alias("__g2"), F.col("starts")
                                   .alias("__starts")), "line-removals")

    # a sort-merge join at any size: the removals grow with the corpus
    keyed = docs.withColumns(key).join(gone.hint("merge"), F.expr("__k1 = __g1 AND __k2 = __g2"), "left")
    covered = F.flatten(F.transform("__starts", lambda s: F.transform(F.lit(list(range(window))), lambda i: s + i)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), covered)
    out = keyed.withColumn("__lines", lines).withColumn("__left", F.when(F.col("__starts").isNotNull(), left))
    # (the size keeps the lines a column of their own: inside the lambda alone
    # the text would be split again for every line)
    text = F.when(F.col("__starts").isNull() | (F.size("__lines") == 0), F.col(text_col)).otherwise(
        F.array_join(F.transform("__left", lambda i: F.get("__lines", i)), "\n"))
    n_lines = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("__lines")), F.lit(0)).cast("long")
    n_removed = F.when(F.col("__starts").isNull(), F.lit(0)).otherwise(F.size("__lines") - F.size("__left"))
    new = {"n_lines": n_lines, "n_removed": n_removed.cast("long")} if counts else {}
    kept = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in new]
    return out.select(*kept, *[v.alias(n) for n, v in new.items()])
