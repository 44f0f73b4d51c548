"""Removal of repeated long substrings by suffix arrays.

A byte is removed when it is covered by a string of ``LENGTH`` bytes that also
starts anywhere else in the corpus, judged on the input; matches never cross
documents.

**Partitioning.**  No suffix array of the corpus is built.  Every window of
``LENGTH`` bytes has an anchor: the leftmost of its 32-byte substrings with the
smallest hash.  Equal windows have equal anchors at the same place, so the
windows of a document fall into contexts (an anchor and all bytes of its
windows), and only contexts of the same anchor hash can share a window.
Contexts travel as digests; equal contexts are counted per task first, so a
passage held by a third of all documents stays one row per task, and only
anchors that occur with different contexts fetch bytes.

**Suffix arrays.**  The contexts of one anchor are aligned at it.  Going out
from the anchor on each side, the set of contexts that still agree splits at a
few places; between two such places a context is one symbol, equal for the
contexts that agree all the way from the anchor.  A maximal match between two
contexts begins and ends at such places.  The symbol strings of many groups
form one text per block, whose suffix array (built by linear grouping,
``gsaca``) puts next to each suffix the one that shares most with it; a shared
length of ``LENGTH`` bytes or more marks its bytes.  Contexts that occur more
than once enter twice and find each other.

**Skew.**  A group of more than ``GROUP`` different contexts is split by where
windows lie around the anchor: windows of one half share the bytes common to
that half, so groups of equal common bytes hold all partners.  Halving ends, at
the latest, with single windows, whose groups are equal contexts.

Defined cases: null counts as the empty text; documents shorter than
``LENGTH`` lose nothing; rows that repeat both id and text are copies of each
other like any other rows; columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_append, materialize, slices, spark_schema_with
from .gsaca import common_prefixes, suffix_array
from .near_dup import mix

LENGTH = 400
SEED = 32                   # bytes of an anchor
GROUP = 256                 # different contexts of one anchor sorted together
BLOCK_SYMBOLS = 50_000      # of one suffix array
BROADCAST_KEYS = 2_000_000  # document keys sent to every executor at most

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes from each position on, by doubling."""
    with np.errstate(over="ignore"):
        h, width, power = _BYTE[data], 1, np.uint64(0xD6E8FEB86659FD93)
        while width < SEED:
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
        return mix(h)


def anchors(data: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(hash, anchor, first window, last window) for all windows of a text."""
    n = len(data) - length + 1
    if n <= 0:
        return []
    h = seed_hashes(data)
    span = length - SEED + 1
    low, width = h, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width:span - width + n])
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    out = []
    signed = h.view(np.int64)
    for s, end in zip([0, *change.tolist()], [*change.tolist(), n], strict=True):
        while s < end:   # the smallest hash may occur more than once
            a = s + int(h[s:s + span].argmin())
            stop = min(end, a + 1)
            out.append((int(signed[a]), a, s, stop - 1))
            s = stop
    return out


_CONTEXTS = "id long, k long, h long, d1 long, d2 long, most int, least int, ats array<int>"


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """(id, k, text) -> one row per document and different context: its anchor
    hash, digest, the largest and smallest distance from a window's start to
    the anchor, and the anchors."""
    def run(batches):
        for batch in slices(batches):
            rows, keys, ats = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                found: dict[tuple, list[int]] = {}
                for h, a, first, last in anchors(np.frombuffer(raw, dtype=np.uint8), length):
                    digest = xxhash.xxh3_128_digest(raw[first:last + length], seed=a - first)
                    found.setdefault((h, digest, a - first, a - last), []).append(a)
                rows.extend([i] * len(found))
                keys.extend(found)
                ats.extend(found.values())
            digests = np.frombuffer(b"".join(k[1] for k in keys), dtype="<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int32()),
                 pa.array(ats, pa.list_(pa.int32()))],
                names=["id", "k", "h", "d1", "d2", "most", "least", "ats"])

    return docs.mapInArrow(run, _CONTEXTS)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _side(sides: list[bytes], fresh: int) -> tuple[list[list[tuple[int, int]]], int]:
    """Per string its (symbol, bytes) segments from the anchor outwards, as far
    as any other string agrees; the next unused symbol."""
    by = sorted(range(len(sides)), key=sides.__getitem__)
    near = [0, *[_shared(sides[by[i - 1]], sides[by[i]]) for i in range(1, len(by))]]
    out: list[list[tuple[int, int]]] = [[] for _ in sides]
    active, depth = [(0, len(by))], 0
    while active:
        following = []
        # ranges of strings that agree up to depth; each splits where its
        # neighbours first differ
        for first, end in active:
            base = out[by[first]]
            reach = min(near[first + 1:end])
            if reach > 0:
                start = sum(n for _, n in base)
                if reach > start:
                    for i in range(first, end):
                        out[by[i]].append((fresh, reach - start))
                    fresh += 1
            cuts = [first, *[i for i in range(first + 1, end) if near[i] == reach], end]
            following.extend((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1)
        active = following
        depth += 1
    return out, fresh


class Block:
    """Symbol strings of several groups and the spans they yield."""

    def __init__(self, length: int):
        self.length = length
        self.fresh = 2            # 0 and 1 are kept for separators
        self.text: list[int] = []
        self.weight: list[int] = []
        self.owner: list[int] = []
        self.begin: list[int] = []
        self.names: list[tuple] = []

    def add(self, group: list[tuple]) -> None:
        """``group``: (name, copies, most, least, left, right) of one anchor;
        the bytes may be absent when there is one context only."""
        rows = [r for r in group for _ in range(min(2, r[1]))]
        if len(rows) < 2:
            return
        if len(group) == 1:
            (_, _, most, least, _, _) = group[0]
            segments = [([(self.fresh, most)] if most else [], [(self.fresh + 1, self.length - least)])] * len(rows)
            self.fresh += 2
        else:
            left, self.fresh = _side([r[4][::-1] for r in rows], self.fresh)
            right, self.fresh = _side([r[5] for r in rows], self.fresh)
            segments = list(zip(left, right, strict=True))
        for row, (before, after) in zip(rows, segments, strict=True):
            at = -sum(n for _, n in before)
            self.names.append(row[0])
            for symbol, n in [*reversed(before), *after]:
                self.text.append(symbol)
                self.weight.append(n)
                self.owner.append(len(self.names) - 1)
                self.begin.append(at)
                at += n
            self.text.append(1)
            self.weight.append(0)
            self.owner.append(-1)
            self.begin.append(0)

    def spans(self) -> dict[tuple, list[tuple[int, int]]]:
        """Per context the marked byte ranges, relative to the anchor."""
        array = suffix_array(np.array(self.text, dtype=np.int64))
        near = [*common_prefixes(self.text, array, 2), 0]
        upto = np.r_[0, np.cumsum(self.weight)].tolist()
        out: dict[tuple, set[tuple[int, int]]] = {}
        for r, s in enumerate(array):
            if self.owner[s] >= 0:
                shared = upto[s + max(near[r], near[r + 1])] - upto[s]
                if shared >= self.length:
                    out.setdefault(self.names[self.owner[s]], set()).add((self.begin[s], self.begin[s] + shared))
        return {name: merged(found) for name, found in out.items()}


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_SPANS = "key long, s1 long, s2 long, spans array<struct<s: int, e: int>>"


def _sorted_groups(groups: DataFrame, length: int) -> DataFrame:
    """Spans of all groups: rows (key, s1, s2, copies, most, least, left,
    right), each key's rows together in one task."""
    def run(batches):
        def result(block):
            found = block.spans()
            names = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([n[i] for n in names], pa.int64()) for i in range(3)]
                + [pa.array([[{"s": s, "e": e} for s, e in found[n]] for n in names],
                            pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
                names=["key", "s1", "s2", "spans"])

        block, group, key = Block(length), [], None
        for batch in batches:
            for k, s1, s2, copies, most, least, left, right in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    block.add(group)
                    group, key = [], k
                    if len(block.text) >= BLOCK_SYMBOLS:
                        yield result(block)
                        block = Block(length)
                group.append(((k, s1, s2), copies, most, least, left, right))
        block.add(group)
        yield result(block)

    return (groups.repartition("key").sortWithinPartitions("key", "s1", "s2")
            .select("key", "s1", "s2", "copies", "most", "least", "left", "right").mapInArrow(run, _SPANS))


_HALVES = ("key long, s1 long, s2 long, key2 long, t1 long, t2 long, copies long, most int, least int, "
           "left binary, right binary, low int, high int")


def _halves(groups: DataFrame, length: int) -> DataFrame:
    """Each context's windows in the lower and the upper half of its group's
    distances [low, high), as contexts of a group that shares the bytes common
    to that half."""
    def run(batches):
        for batch in slices(batches, 1024):
            out = []
            for key, s1, s2, copies, most, least, left, right, low, high in zip(
                    *[c.to_pylist() for c in batch.columns], strict=True):
                mid = (low + high) // 2
                for a, b in ((low, mid), (mid, high)):   # distances from start to anchor
                    far, close = min(most, b - 1), max(least, a)
                    if far < close:
                        continue
                    before, after = left[len(left) - far:], right[:length - close]
                    common = left[len(left) - a:] + right[:length - (b - 1)]
                    name = xxhash.xxh3_64_digest(common, seed=a * 1_000_003 + b)
                    sub = xxhash.xxh3_128_digest(before + after, seed=far)
                    out.append((key, s1, s2, int.from_bytes(name, "little", signed=True) ^ key,
                                int.from_bytes(sub[:8], "little", signed=True),
                                int.from_bytes(sub[8:], "little", signed=True), copies, far, close, before, after, a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _HALF_TYPES, strict=True)]
                if out else [pa.array([], t) for t in _HALF_TYPES], names=_HALF_NAMES)

    return groups.select("key", "s1", "s2", "copies", "most", "least", "left", "right", "low", "high").mapInArrow(
        run, _HALVES)


_HALF_NAMES = [x.strip().split(" ")[0] for x in _HALVES.split(",")]
_HALF_TYPES = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()] * 2 + [pa.int32()] * 2


def _solve(groups: DataFrame, length: int) -> DataFrame:
    """(key, s1, s2, spans) of different contexts.

    One round for each halving, for all groups together: small groups are
    sorted, large ones halved.  Then the rounds are taken back, so that a
    context has the spans of its halves."""
    level = groups.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - SEED + 1))
    solved, steps = [], []
    while True:
        counts = level.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("all"))
        counted = materialize(level.join(counts, "key").filter("all > 1"), "substring-groups")
        solved.append(materialize(_sorted_groups(counted.filter(F.col("n") <= GROUP), length), "substring-sorted"))
        large = counted.filter(F.col("n") > GROUP)
        if large.isEmpty():
            break
        halves = materialize(_halves(large, length), "substring-halves")
        steps.append(halves.select("key", "s1", "s2", "key2", "t1", "t2"))
        context = F.first(F.struct("most", "least", "left", "right", "low", "high")).alias("c")
        level = (halves.groupBy("key2", "t1", "t2").agg(F.sum("copies").alias("copies"), context)
                 .select(F.col("key2").alias("key"), F.col("t1").alias("s1"), F.col("t2").alias("s2"), "copies", "c.*"))
    spans = solved.pop()
    while steps:
        below = spans.select(F.col("key").alias("key2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), "spans")
        back = steps.pop().join(below, ["key2", "t1", "t2"]).select("key", "s1", "s2", "spans")
        spans = materialize(solved.pop().unionAll(back).groupBy("key", "s1", "s2")
                            .agg(F.flatten(F.collect_list("spans")).alias("spans")), "substring-spans")
    return spans


def _with_bytes(contexts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Adds the bytes left and right of the anchor; ``contexts`` name a document
    (id, k) and a place in it that hold them."""
    asked = contexts.groupBy("id", "k").agg(F.collect_list(
        F.struct("key", "s1", "s2", "copies", "most", "least", "at")).alias("asked"))
    asked = asked.select(F.col("id").alias("__aid"), F.col("k").alias("__ak"), "asked")
    joined = (docs.join(asked.hint("merge"), F.expr("k = __ak AND id <=> __aid"))
              .dropDuplicates(["id", "k"]).select("text", "asked"))
    names = ["key", "s1", "s2", "copies", "most", "least", "left", "right"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] * 2

    def run(batches):
        for batch in slices(batches, 64):
            out = []
            for text, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for c in found:
                    a = c["at"]
                    out.append((c["key"], c["s1"], c["s2"], c["copies"], c["most"], c["least"],
                                raw[a - c["most"]:a], raw[a:a - c["least"] + length]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                if out else [pa.array([], t) for t in kinds], names=names)

    return joined.mapInArrow(run, "key long, s1 long, s2 long, copies long, most int, least int, "
                                  "left binary, right binary")


def _only(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The documents with (left_semi) or without (left_anti) a key in ``keys``,
    which is sent to the executors when it is small."""
    keys = keys.select(F.col("id").alias("__oid"), F.col("k").alias("__ok"))
    if keys.count() <= BROADCAST_KEYS:   # else shuffled, with the same result
        keys = F.broadcast(keys)
    return docs.join(keys, F.expr("k = __ok AND id <=> __oid"), how)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, k, text) -> (id, k, spans): the byte ranges to remove, of the
    documents that have any."""
    rows = materialize(_contexts(docs, length), "substring-contexts")
    often = (rows.groupBy("h").agg(F.sum(F.size("ats")).alias("n")).filter("n > 1")
             .select(F.col("h").alias("__h")))
    again = materialize(rows.join(often, F.col("h") == F.col("__h")).drop("__h"), "substring-again")
    different = again.groupBy("h", "d1", "d2").agg(
        F.sum(F.size("ats")).cast("long").alias("copies"),
        F.min(F.struct("id", "k", F.col("ats")[0].alias("at"), "most", "least")).alias("c"))
    different = materialize(different.select(F.col("h").alias("key"), F.col("d1").alias("s1"), F.col("d2").alias("s2"),
                                             "copies", "c.*"), "substring-different")
    per_key = different.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sized = different.join(per_key, "key")
    alone = (sized.filter("n = 1").select("key", "s1", "s2", "copies", "most", "least",
                                          F.lit(None).cast("binary").alias("left"),
                                          F.lit(None).cast("binary").alias("right")))
    several = materialize(sized.filter("n > 1").drop("n"), "substring-several")
    holders = _only(docs, materialize(several.select("id", "k").distinct(), "substring-holders"), "left_semi")
    groups = alone.unionAll(_with_bytes(several, holders, length))
    spans = _solve(groups, length)
    found = again.join(spans.select(F.col("key").alias("h"), F.col("s1").alias("d1"), F.col("s2").alias("d2"),
                                    "spans"), ["h", "d1", "d2"])
    placed = F.flatten(F.transform("ats", lambda a: F.transform("spans", lambda x: F.struct(
        (a + x["s"]).alias("s"), (a + x["e"]).alias("e")))))
    return (found.select("id", "k", placed.alias("spans")).groupBy("id", "k")
            .agg(F.flatten(F.collect_list("spans")).alias("spans")))


def remove_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                               length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``) with ``kept`` (the remaining bytes),
    ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs)."""
    if length < SEED:
        raise ValueError(f"length must be at least {SEED}")
    new = [("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType())]
    plain = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n for n, _ in new}]
    k = F.xxhash64(F.col(id_col), F.col(text_col))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), k.alias("k"), F.col(text_col).alias("text"))
    spans = materialize(repeated_spans(narrow, length), "substring-removals")
    spans = spans.select(F.col("id").alias("__sid"), F.col("k").alias("__sk"), F.col("spans").alias("__spans"))
    columns = list(dict.fromkeys([*plain, text_col]))
    keyed = docs.select(*columns, F.col(id_col).cast("long").alias("id__"), k.alias("k__"))

    def run(batches):
        for batch in slices(batches):
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, found in zip(batch.column(text_col).to_pylist(), batch.column("__spans").to_pylist(),
                                   strict=True):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                gone = merged((x["s"], x["e"]) for x in found or [])
                parts, at = [], 0
                for s, e in gone:
                    parts.append(raw[at:s])
                    at = e
                kept.append(b"".join([*parts, raw[at:]]))
                n_bytes.append(len(raw))
                n_removed.append(sum(e - s for s, e in gone))
                n_spans.append(len(gone))
            yield arrow_append(batch.select(plain), [("kept", pa.array(kept, pa.binary())), *[
                (n, pa.array(v, pa.int64())) for (n, _), v in zip(new[1:], (n_bytes, n_removed, n_spans), strict=True)]])

    schema = spark_schema_with(docs.select(*plain), new)
    keys = spans.select(F.col("__sid").alias("id"), F.col("__sk").alias("k"))
    renamed = keyed.withColumnsRenamed({"id__": "__id", "k__": "__k"})
    small = keys.count() <= BROADCAST_KEYS
    marks = keys.select(F.col("id").alias("__mid"), F.col("k").alias("__mk"))
    marks = F.broadcast(marks) if small else marks
    same = F.expr("__k = __mk AND __id <=> __mid")
    # only documents with something to remove meet their spans
    cut = renamed.join(marks, same, "left_semi").join(spans.hint("merge"), F.expr("__k = __sk AND __id <=> __sid"))
    whole = renamed.join(marks, same, "left_anti").withColumn("__spans", F.lit(None).cast(
        "array<struct<s: int, e: int>>"))
    every = cut.select(*columns, "__spans").unionAll(whole.select(*columns, "__spans"))
    return every.mapInArrow(run, schema)
