"""Mixing sources to target weights: Efraimidis-Spirakis sampling.

Every document draws a uniform number from a digest of itself and gets the
exponential key ``-ln(u) / quality``; ascending keys within a source are a
weighted random order without replacement, the same in every run.  A source's
target is met by complete epochs (every document once each) and then by the
prefix of that order whose words fill what is left; the document at the end
of the prefix is taken when at least half of it fits, so that whole documents
bring the source as near to its target as a prefix can.

Targets share ``share`` times the size of the corpus by source weight; a
target stops at ``most`` times its source's size and the excess is shared
again by weight among the others until none is above.

No source is sorted in one task.  Keys fall into 4096 equal slices, sizes are
summed per (source, slice) before the shuffle, and only the slice in which the
prefix ends is looked at more closely: once more in 4096 slices, then row by
row.  What results is one boundary per source, and each document is decided
by comparing its key with it.

Defined cases: a null text has size 0; null is a source of its own, last in
order; documents of size 0 take no words; rows that repeat both id and text
share a key and are taken or left together; an empty table gives no rows;
columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import with_global_position
from .frames import free_name, materialize

SLICES = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    """Runs of anything but the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: falls with the number of marks (neither letters, digits
    nor white space) per word."""
    marks = F.coalesce(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")), F.lit(0))
    return size / (size + marks + F.lit(1.0))


def _digest(id_col: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"),
                          F.coalesce(text, F.lit("")).cast("binary")))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also ``target``.  Sources weigh ``weights`` in
    turn by code point, null last.  Each round is one small aggregate."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = with_global_position(sizes.withColumn("absent", F.col("source").isNull()),
                                  [F.col("absent"), F.col("source")], "place").drop("absent")
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    table = materialize(placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)),
                        "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, 0
    while True:
        above = F.lit(False) if level is None else (F.lit(level[0]) * F.col("weight") / F.lit(level[1]) > F.col("cap"))
        got = table.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))),
                        F.count(F.when(above, 1))).first()
        left, heavy, n = share * total - (got[0] or 0.0), got[1] or 0.0, got[2]
        if heavy == 0 or (level is not None and n == stopped):
            break
        level, stopped = (left, heavy), n
    if level is None:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    fair = F.lit(level[0]) * F.col("weight") / F.lit(level[1])
    return table.select("source", "source_size", F.least(fair, F.col("cap")).alias("target"))


def _slice(key: Column) -> tuple[Column, Column]:
    """Equal slices of the keys' range, in key order, and slices of those."""
    at = (F.lit(1.0) - F.exp(-key)) * SLICES
    first = F.least(F.floor(at), F.lit(SLICES - 1)).cast("int")
    return first, F.least(F.floor((at - first) * SLICES), F.lit(SLICES - 1)).cast("int")


def _ends_in(rows: DataFrame, need: DataFrame, slot: str) -> DataFrame:
    """Per source the slice in which the prefix ends, and the words before it.
    A source whose prefix ends behind its last slice has no row."""
    sums = rows.groupBy("source", slot).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy(slot)
    cut = (sums.withColumn("upto", F.sum("words").over(running))
           .join(need, F.expr("source <=> need_source")).drop("need_source"))
    before = F.col("upto") - F.col("words") + F.col("taken_before")
    return (cut.withColumn("before", before)
            .filter((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("words")))
            .select(F.col("source").alias("need_source"), F.col(slot).alias(f"end_{slot}"),
                    F.col("before").alias("taken_before"), "need"))


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, share: float, most: float,
             seed: int) -> DataFrame:
    """``docs`` with the decision in columns of their own."""
    text = F.col(text_col)
    size, key, tie = F.col("__mix_size"), F.col("__mix_key"), F.col("__mix_tie")
    if any(c.lower().startswith("__mix_") for c in docs.columns):
        raise ValueError(f"column names starting with {free_name(docs, 'mix_')} are used inside")
    uniform = (F.conv(F.substring("__mix_tie", 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    keyed = (docs.withColumn("__mix_size", word_count(text))
             .withColumn("__mix_tie", _digest(F.col(id_col), text, seed))
             .withColumn("__mix_key", -F.log(uniform) / quality_weight(text, F.greatest(size, F.lit(1)))))
    first, second = _slice(key)
    keyed = keyed.withColumn("__mix_slice", first)

    rows = materialize(keyed.select(F.col(source_col).alias("source"), size.alias("size"), key.alias("key"),
                                    tie.alias("tie"), F.col("__mix_slice").alias("slice"),
                                    second.alias("part")), "mix-keys")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = materialize(targets.withColumn("epochs", epochs.cast("int")), "mix-targets")
    need = targets.select(F.col("source").alias("need_source"), F.lit(0).cast("long").alias("taken_before"),
                          (F.col("target") - F.col("epochs") * F.col("source_size")).alias("need"))
    ends = materialize(_ends_in(rows, need, "slice"), "mix-ends")
    near = rows.join(ends, F.expr("source <=> need_source AND slice = end_slice")).select(*rows.columns)
    parts = materialize(_ends_in(near, ends.drop("end_slice"), "part"), "mix-parts")
    last = (near.join(parts, F.expr("source <=> need_source AND part = end_part"))
            .groupBy("source", "key", "tie", "taken_before", "need").agg(F.sum("size").alias("words")))
    running = Window.partitionBy("source").orderBy("key", "tie")
    middle = F.sum("words").over(running) - F.col("words") / 2 + F.col("taken_before")
    taken = last.withColumn("middle", middle).filter(F.col("middle") <= F.col("need"))
    edge = taken.groupBy("source").agg(F.max(F.struct("key", "tie")).alias("edge"))
    bound = (targets.join(ends.select("need_source", "end_slice"), F.expr("source <=> need_source"), "left")
             .drop("need_source")
             .join(parts.select("need_source", "end_part"), F.expr("source <=> need_source"), "left")
             .drop("need_source")
             .join(edge.withColumnRenamed("source", "edge_source"), F.expr("source <=> edge_source"), "left"))
    bound = materialize(bound.select(
        F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_total"),
        F.col("target").alias("__mix_target"), F.col("epochs").alias("__mix_epochs"),
        F.col("end_slice").alias("__mix_end"), F.col("end_part").alias("__mix_end_part"),
        F.col("edge.key").alias("__mix_edge"), F.col("edge.tie").alias("__mix_edge_tie")), "mix-bounds")

    decided = keyed.withColumn("__mix_part", _slice(key)[1]).join(
        bound, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    inside = F.expr("""coalesce(
        __mix_slice < __mix_end
        OR (__mix_slice = __mix_end AND (__mix_part < __mix_end_part OR (__mix_part = __mix_end_part
            AND (__mix_key < __mix_edge OR (__mix_key = __mix_edge AND __mix_tie <= __mix_edge_tie))))),
        __mix_end IS NULL AND __mix_target - __mix_epochs * __mix_total > 0)""")
    copies = F.col("__mix_epochs") + F.coalesce(inside, F.lit(False)).cast("int")
    return decided.withColumn("__mix_copies", copies)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11,
        columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) and size, source_size, target,
    copies (how often the mix takes the document) and taken (words)."""
    decided = _decided(docs, id_col, text_col, source_col, weights, share, most, seed)
    size, copies = F.col("__mix_size"), F.col("__mix_copies")
    new = {"size": size, "source_size": F.col("__mix_total"), "target": F.col("__mix_target"),
           "copies": copies, "taken": size * copies}
    kept = [c for c in (columns or docs.columns) if c.lower() not in new]
    return decided.select(*[F.col(c) for c in kept], *[v.alias(n) for n, v in new.items()])


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with the
    columns of ``docs``."""
    decided = _decided(docs, id_col, text_col, source_col, weights, share, most, seed).filter("__mix_copies > 0")
    again = F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies")))
    return decided.select(*[F.col(c) for c in docs.columns], again.alias("__mix_again")).drop("__mix_again")
