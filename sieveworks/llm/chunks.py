"""Substring de-duplication by content-defined chunks.

A gear rolling hash runs over the bytes of every text.  A chunk ends where the
hash of the last 32 bytes has its lowest-order selected bits zero, at least
``MIN_CHUNK`` and at most ``MAX_CHUNK`` bytes after it began, so boundaries
move with the content and an insertion disturbs only the chunks around it.
Chunks are identified by a 128-bit digest.  The first occurrence of a chunk in
document order stays; later ones go when they form an unbroken run of at least
``MIN_RUN`` bytes, which spares short phrases that texts share by chance.

Only digests and positions cross the shuffle; counts are summed per task, and
only chunks that occur more than once go on to the choice of the first.

Defined cases: documents are ordered by id (null last), then by a hash of
their text; rows that repeat both id and text are one document and lose the
same chunks; a null text stays null, with no bytes; chunks end at character
boundaries, so texts stay valid; columns named like a result column are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_append, materialize, slices, spark_schema_with
from .near_dup import mix

MIN_CHUNK, MAX_CHUNK = 32, 256
CUT_BITS = 5            # a cut every 2^5 bytes beyond the smallest chunk
MIN_RUN = 64
WINDOW = 32             # bytes that a 32-bit gear hash depends on

#: One number per byte value, drawn by rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash ``h = 2 h + gear[byte]`` (mod 2^32) at every byte: the
    last 32 bytes weigh in, each twice its successor, so sums over 1, 2, 4, ...
    bytes double up to the whole window."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h = longer
        width *= 2
    return h


def chunk_ends(text: bytes) -> list[int]:
    """End offsets of the chunks of one text."""
    n = len(text)
    if n == 0:
        return []
    data = np.frombuffer(text, dtype=np.uint8)
    # the highest bits depend on the whole window
    cut = gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0
    starts_character = np.ones(n, dtype=bool)
    starts_character[:-1] = (data[1:] & 0xC0) != 0x80
    ends, at = [], 0
    for end in (np.flatnonzero(cut & starts_character) + 1).tolist():
        while end - at > MAX_CHUNK:
            at = _boundary(text, at + MAX_CHUNK)
            ends.append(at)
        if end - at >= MIN_CHUNK:
            ends.append(end)
            at = end
    while n - at > MAX_CHUNK:
        at = _boundary(text, at + MAX_CHUNK)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _boundary(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


_CHUNKS = "id long, k long, off int, len int, d1 long, d2 long"


def _chunked(docs: DataFrame) -> DataFrame:
    """(id, k, text) -> one row per chunk."""
    def run(batches):
        for batch in slices(batches):
            sizes, offs, lens, digests = [], [], [], []
            for text in batch.column(2).to_pylist():
                data = text.encode("utf-8", "surrogatepass") if text else b""
                ends = chunk_ends(data)
                sizes.append(len(ends))
                start = 0
                for end in ends:
                    offs.append(start)
                    lens.append(end - start)
                    digests.append(xxhash.xxh3_128_digest(data[start:end]))
                    start = end
            rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(offs, pa.int32()),
                 pa.array(lens, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                names=["id", "k", "off", "len", "d1", "d2"])

    return docs.mapInArrow(run, _CHUNKS)


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           min_run: int = MIN_RUN, whole_documents: bool = False) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text_col``, and ``n_bytes``
    (before), ``n_removed`` (bytes) and ``n_spans`` (removed runs).

    With ``whole_documents`` a run that covers a whole document goes at any
    size, and ``n_left`` tells the bytes of later chunks that stay because
    their run is shorter than ``min_run``."""
    k = F.xxhash64(F.col(id_col), F.col(text_col))
    chunks = materialize(_chunked(docs.select(F.col(id_col).cast("long").alias("id"), k.alias("k"), text_col)),
                         "chunk-rows")
    repeated = chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1", "d2")
    again = materialize(chunks.join(repeated, ["d1", "d2"]), "chunk-repeats")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k", "off")
    first = again.groupBy("d1", "d2").agg(F.min(order).alias("first"))
    later = again.join(first, ["d1", "d2"]).filter(~order.eqNullSafe(F.col("first")))
    gone = (later.groupBy(F.col("id").alias("__gid"), F.col("k").alias("__gk"))
            .agg(F.sort_array(F.collect_set(F.struct("off", "len"))).alias("__gone")))

    new = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType())]
    if whole_documents:
        new.append(("n_left", T.LongType()))
    plain = [c for c in docs.columns if c.lower() not in {n for n, _ in new}]

    def run(batches):
        for batch in slices(batches):
            texts, n_bytes, n_removed, n_spans, n_left = [], [], [], [], []
            for text, gone in zip(batch.column(text_col).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                gone = gone or []
                kept, spans, at = [], _runs(gone, min_run, len(data) if whole_documents else None), 0
                for start, end in spans:
                    kept.append(data[at:start])
                    at = end
                n_bytes.append(len(data))
                n_removed.append(sum(e - s for s, e in spans))
                n_spans.append(len(spans))
                n_left.append(sum(c["len"] for c in gone) - n_removed[-1])
                texts.append(b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass") if spans else text)
            out = batch.select(plain)
            out = out.set_column(plain.index(text_col), text_col, pa.array(texts, pa.string()))
            yield arrow_append(out, [(n, pa.array(v, pa.int64())) for (n, _), v in
                                     zip(new, (n_bytes, n_removed, n_spans, n_left), strict=False)])

    keyed = docs.withColumn("__k", k).withColumn("__id", F.col(id_col).cast("long"))
    joined = keyed.join(gone.hint("merge"), F.expr("__id <=> __gid AND __k = __gk"), "left").select(*plain, "__gone")
    return joined.mapInArrow(run, spark_schema_with(docs.select(*plain), new))


def _runs(gone: list[dict], min_run: int, whole: int | None = None) -> list[tuple[int, int]]:
    """Adjoining chunks merged; runs of at least ``min_run`` bytes, or of
    ``whole``."""
    out: list[list[int]] = []
    for c in gone:
        if out and out[-1][1] == c["off"]:
            out[-1][1] += c["len"]
        else:
            out.append([c["off"], c["off"] + c["len"]])
    return [(s, e) for s, e in out if e - s >= min_run or e - s == whole]
