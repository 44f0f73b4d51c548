"""Merkle manifest of a dataset: one leaf per row, a tree per group, a tree
over the groups, and for every row the proof that leads to the root.

The trees are rolled up as nested structs.  A row's rank in its group is
written as digits to the base ``fanout``; the digits are grouped away one
after the other, the lowest first, and every step puts the structs of the
children into the struct of their parent.  ``height`` digits make a block:
after one exchange by (group, block) all of a block's steps run where its rows
are, and a block never holds more than ``fanout ** height`` leaves however
large its group is.  The blocks' roots are the leaves of the next tier, until
one block is left per group; the groups' roots then make a last tree.

Proofs come back the same way.  From the top tier down, a block's struct and
the path above it meet under their common key in one grouping of their union;
``transform`` hands each child its siblings and an exploding ``inline`` emits
it, digit by digit.  No join is used.

Ranks come from one range shuffle of the digests (never of the texts): a task
numbers its sorted rows by group, and only a group that began in an earlier
task needs an offset, one number per partition.

Definitions: ``H`` is the lowercase hex SHA-256 of its concatenated inputs,
digests as hex text.  A leaf is ``H`` of its fields, ``-`` for a null, else the
UTF-8 byte count, ``:`` and the value.  While more than one node remains, every
``fanout`` consecutive ones (the last run may be shorter) become their ``H``; a
lone leaf is its own root.

Defined cases: null groups come first and are a group like any other; null
order values come first in their group; rows that share group and order value
follow their leaf digests, so fully repeated rows have equal leaves and stand
side by side; empty texts count zero bytes; an empty table gives no rows;
columns named like a result column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import materialize

FANOUT = 2
HEIGHT = 8
RESULTS = ("leaf", "subroot", "root", "proof", "folded_root", "verified")
PATH = "array<struct<left:string,right:string>>"


def digest_of(fields: list[Column]) -> Column:
    """``H`` of the fields of one row."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(df: DataFrame, fields: list[str], group_col: str, order_col: str, keep: list[str] | None = None,
             tampered: dict[str, Column] | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``keep`` (the order column by default) and leaf, subroot, root, proof,
    folded_root and verified of every row.

    ``proof`` lists, from the leaf to the root, the siblings on the left and
    on the right of each step.  ``folded_root`` is what the proof makes of the
    row's leaf, or of the leaf of the row with the values of ``tampered`` in
    place of its own; ``verified`` tells whether that is the root.
    """
    if fanout < 2 or height < 1:
        raise ValueError("fanout must be at least 2 and height at least 1")
    kept = [c for c in (keep or [order_col]) if c.lower() not in RESULTS]
    changed = {name.lower(): value for name, value in (tampered or {}).items()}
    leaf = digest_of([F.col(c) for c in fields])
    other = digest_of([changed.get(c.lower(), F.col(c)) for c in fields]) if changed else F.lit(None).cast("string")
    # kept columns travel under names of our own
    item = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.nullif(other, leaf).alias("other"))
    rows = df.select(F.col(group_col).alias("grp"), F.col(order_col).alias("ord"), leaf.alias("hash"),
                     item.alias("item"))

    tiers = _tiers(*_ranked(materialize(rows, "merkle-leaves")), fanout, height)
    groups = tiers[-1][0].select(F.lit(0).alias("grp"), F.col("grp").alias("ord"), "hash",
                              F.struct(F.col("grp").alias("of")).alias("item"))
    top = _tiers(*_ranked(groups), fanout, height)

    last, digits = top[-1]
    start = last.select("grp", "block", "hash", "kids", F.array().cast(PATH).alias("path"),
                           F.struct(F.col("hash").alias("root")).alias("over"))
    found = _descended(top, _paths(start, fanout, digits), fanout)
    found = found.select(F.col("item.of").alias("grp"), F.lit(0).cast("long").alias("block"), "path",
                         F.struct("over.root", F.col("hash").alias("subroot")).alias("over"))
    last, digits = tiers[-1]
    found = _descended(tiers, _paths(_met(last, found), fanout, digits), fanout)

    folded = F.aggregate("path", F.coalesce("item.other", "hash"),
                         lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))
    named = found.select(*[F.col(f"item.k{i}").alias(c) for i, c in enumerate(kept)], F.col("hash").alias("leaf"),
                         F.col("over.subroot").alias("subroot"), F.col("over.root").alias("root"),
                         F.col("path").alias("proof"), folded.alias("folded_root"))
    return named.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: Column) -> Column:
    """``H`` of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """(grp, ord, hash, item) -> (grp, rank, hash, item) with the 0-based rank
    of each row in its group, and a bound that no rank reaches."""
    keys = ["grp", "ord", "hash", "salt"]  # the salt parts rows that are alike in all else
    placed = (rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys)
              .sortWithinPartitions(*keys).select("grp", "hash", "item", F.spark_partition_id().alias("pid")))
    schema = T.StructType(placed.schema.fields + [T.StructField("place", T.LongType()),
                                                  T.StructField("opening", T.BooleanType())])
    placed = materialize(placed.mapInArrow(_numbered, schema), "merkle-places")

    # one row per partition: its first and last group, and how many rows they have there
    found, group = F.col("grp").isNotNull().alias("found"), F.col("grp").alias("group")
    ends = placed.groupBy("pid").agg(
        F.min(F.struct(found, group)).alias("first"), F.max(F.struct(found, group)).alias("last"),
        F.max(F.struct(found, group, (F.col("place") + 1).alias("n")))["n"].alias("n_last"),
        F.max("place").alias("most")).collect()
    offsets, bound, before, carried = {}, 0, None, 0
    for row in sorted(ends, key=lambda r: r["pid"]):
        offset = carried if before is not None and before == row["first"] else 0
        offsets[row["pid"]] = offset
        bound = max(bound, row["most"] + 1 + offset)
        carried = row["n_last"] + (offset if row["first"] == row["last"] else 0)
        before = row["last"]
    table = F.array(*[F.lit(offsets.get(p, 0)).cast("long") for p in range(max(offsets, default=0) + 1)])
    rank = F.col("place") + F.when(F.col("opening"), F.element_at(table, F.col("pid") + 1)).otherwise(F.lit(0))
    return placed.select("grp", rank.alias("rank"), "hash", "item"), bound


def _numbered(batches):
    """Sorted rows of one partition with their place in their group there;
    ``opening`` marks the group that the partition begins with."""
    last, count, opening = None, 0, True
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        groups = batch.column("grp")
        before = groups.slice(0, 1) if last is None else last
        codes = np.asarray(pa.concat_arrays([before, groups]).dictionary_encode().indices.fill_null(-1))
        starts = np.flatnonzero(codes[1:] != codes[:-1])
        base = np.full(n, -count, np.int64)   # where the row's group begins, in rows of this batch
        base[starts] = starts
        place = np.arange(n) - np.maximum.accumulate(base)
        opened = np.full(n, opening)
        if len(starts):
            opened[starts[0]:] = opening = False
        last, count = groups.slice(n - 1, 1), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(place), pa.array(opened)],
                                         names=batch.schema.names + ["place", "opening"])


def _tiers(nodes: DataFrame, bound: int, fanout: int, height: int) -> list[tuple[DataFrame, int]]:
    """The stored tiers, from the leaves up, and the digits each one groups
    away: one row per block with its root and its nested children.  The last
    tier has as many digits as are left, and one row per group."""
    tiers = []
    while True:
        digits = 1
        while digits < height and fanout ** digits < bound:
            digits += 1
        tiers.append((materialize(_rolled_up(nodes, fanout, digits), "merkle-tier"), digits))
        bound = -(-bound // fanout ** digits)
        if bound <= 1:
            return tiers
        nodes = tiers[-1][0].select("grp", F.col("block").alias("rank"), "hash", F.struct("block").alias("item"))


def _rolled_up(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """(grp, rank, hash, item) -> (grp, block, hash, kids): the digits of the
    rank inside the block are grouped away, nesting the children."""
    digits = [f"d{i}" for i in range(height)]
    at = [F.expr(f"cast(rank div {fanout ** i} % {fanout} as int)").alias(d) for i, d in enumerate(digits)]
    block = F.expr(f"rank div {fanout ** height}").alias("block")
    # all groupings below keep (grp, block), so this is their only exchange
    cur = nodes.select("grp", block, *at, "hash", F.col("item").alias("kids")).repartition("grp", "block")
    node = F.col("hash")
    for i, digit in enumerate(digits):
        rest = digits[i + 1:]
        child = F.struct(F.col(digit).alias("d"), node.alias("h"), F.col("kids").alias("k"))
        kids = F.array_sort(F.collect_list(child), lambda a, b: a["d"] - b["d"])
        cur = cur.groupBy("grp", "block", *rest).agg(kids.alias("kids"))
        # a lone child in the very first place is all that its group has there
        lone = F.expr(" AND ".join(["size(kids) = 1", "block = 0", *[f"{d} = 0" for d in rest]]))
        node = F.when(lone, F.expr("kids[0].h")).otherwise(F.expr("sha2(array_join(kids.h, ''), 256)"))
    return cur.select("grp", "block", node.alias("hash"), "kids")


def _met(tier: DataFrame, above: DataFrame) -> DataFrame:
    """Each block of ``tier`` with the path above it, (grp, block, path,
    over): both sides are rows of one union, grouped by their common key."""
    here = tier.select("grp", "block", F.struct("hash", "kids").alias("node"))
    there = above.select("grp", "block", F.struct("path", "over").alias("up"))
    both = here.unionByName(there, allowMissingColumns=True).groupBy("grp", "block").agg(
        F.collect_list("node")[0].alias("node"), F.collect_list("up")[0].alias("up"))
    return both.select("grp", "block", "node.hash", "node.kids", "up.path", "up.over")


def _descended(tiers: list[tuple[DataFrame, int]], found: DataFrame, fanout: int) -> DataFrame:
    """From the leaves of the last tier with their paths to those of the first."""
    for tier, height in reversed(tiers[:-1]):
        above = found.select("grp", F.col("item.block").alias("block"), "path", "over")
        found = _paths(_met(tier, above), fanout, height)
    return found


def _paths(blocks: DataFrame, fanout: int, height: int) -> DataFrame:
    """(grp, block, hash, kids, path, over) -> one row per leaf of the blocks:
    (grp, hash, item, path, over), the path leading from the leaf up."""
    handed = f"""inline(transform(kids, (kid, i) -> struct(
        kid.h AS hash, kid.k AS kids,
        concat(if(size(kids) = 1 AND kids[0].h = hash, cast(array() AS {PATH}),
                  array(struct(array_join(slice(kids.h, 1, i), '') AS left,
                               array_join(slice(kids.h, i + 2, {fanout}), '') AS right))), path) AS path)))"""
    cur = blocks
    for _ in range(height):
        cur = cur.select("grp", "over", F.expr(handed))
    return cur.withColumnRenamed("kids", "item")
