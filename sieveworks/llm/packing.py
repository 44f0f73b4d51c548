"""Packing of tokenised documents into training sequences: best-fit decreasing.

A document longer than a sequence is first cut into full windows, each a
sequence of its own.  What is left of it, and every shorter document, is placed
in decreasing order of length into the tightest open window that has room.
Open windows hang on a segment tree indexed by their remaining capacity: a
node knows whether any window below it is open, so the tightest one is found
by one climb and one descent, in the logarithm of the capacity.

Sequences are padded to the capacity, except those of a power of two tokens.
Windows that stay open after the last document are closed without padding: the
emptiest ones are cut to fill the gaps of the others, and the very last one is
cut at powers of two.  Gaps below ``least_cut`` tokens stay padded instead.

The work is map-only.  A task packs its own rows in blocks of about
``block_tokens`` tokens, so neither a source nor a group of copies can gather
anywhere; a block wastes at most what its own last window does, which the
closing cuts remove.  Only a single document is ever held whole.

Ids are those of a ``tokenizers`` file.  For a byte-level file with the usual
splitting pattern, texts are split first and each distinct piece is encoded
once per task (the memory is bounded in bytes); texts with characters on which
the two libraries' Unicode tables may differ, and all texts of other files, go
to the tokenizer whole.

Defined cases: a null text packs like an empty one (the end id alone); repeated
rows are documents of their own; an empty table gives no rows; columns named
like a result column are replaced.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import splitter
from .frames import free_name, slices

CAPACITY = 2048
LEAST_CUT = 16              # smaller gaps stay padded rather than cut a document for them
BLOCK_TOKENS = 1 << 22      # a block's ids take four bytes each
BLOCK_DOCUMENTS = 1 << 16   # a block of tiny documents ends here
MEMORY_BYTES = 64 << 20     # of pieces that a task remembers; results don't depend on it
PIECE_TO_REMEMBER = 64
SEQUENCES_PER_TASK = 1 << 36

RESULTS = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()),
           ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType())]

#: The pattern of byte-level files; characters outside these ranges go to the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ELSEWHERE = re.compile("[^\x00-\u0557\u2000-\u208e\u20a0-\ua7cd\uac00-\ud7a3]")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level files write for each byte: visible Latin-1
    characters stand for themselves, the others for those from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in visible]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def _packed_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class OpenWindows:
    """Windows by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, window: int, room: int) -> None:
        self.by_room[room].append(window)
        at = self.size + room
        while at and not self.open[at]:
            self.open[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its room) of the tightest window with room for ``need``."""
        tree, size = self.open, self.size
        at = size + need
        while not tree[at]:
            # the nearest open node to the right: climb until a right sibling has one
            while at & 1 or not tree[at + 1]:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - size
        window = self.by_room[room].pop()
        if not self.by_room[room]:
            while at:
                tree[at] = 0
                at >>= 1
                if at and (tree[2 * at] or tree[2 * at + 1]):
                    break
        return window, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items (each of 1 to ``capacity``) per window, in the order placed."""
    windows: list[list[int]] = []
    open_windows = OpenWindows(capacity)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        found = open_windows.take(need)
        if found is None:
            found = len(windows), capacity
            windows.append([])
        window, room = found
        windows[window].append(item)
        if room > need:
            open_windows.add(window, room - need)
    return windows


def _needs_padding(total: int, capacity: int) -> bool:
    return total != capacity and total & (total - 1) != 0


def closed(windows: list[list[tuple[int, int, int]]], capacity: int, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """The windows of (item, start, length) pieces without those that would be
    padded: the emptiest are cut up to fill gaps of ``least_cut`` and more."""
    total = [sum(p[2] for p in w) for w in windows]
    gaps = [i for i, n in enumerate(total) if _needs_padding(n, capacity) and capacity - n >= least_cut]
    gaps.sort(key=lambda i: total[i])
    first, last = 0, len(gaps) - 1
    while first < last:
        giver, taker = gaps[first], gaps[last]
        item, start, length = windows[giver].pop()
        moved = min(length, capacity - total[taker])
        if moved < length:
            windows[giver].append((item, start, length - moved))
        windows[taker].append((item, start + length - moved, moved))
        total[giver] -= moved
        total[taker] += moved
        if total[taker] == capacity:
            last -= 1
        if total[giver] == 0:
            first += 1
    if first == last and _needs_padding(total[gaps[first]], capacity):
        rest, windows[gaps[first]] = windows[gaps[first]], []
        left = total[gaps[first]]
        while left:
            room, window = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                item, start, length = rest.pop()
                used = min(length, room)
                if used < length:
                    rest.append((item, start + used, length - used))
                window.append((item, start, used))
                room -= used
            windows.append(window)
    return [w for w in windows if w]


class Pieces(dict):
    """Ids of pieces that a task has met, worked out at the first meeting."""

    def __init__(self, tokens_of):
        super().__init__()
        self.tokens_of, self.held, self.passing = tokens_of, 0, []

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():   # a blank is the only one of these that is written otherwise
            letters = piece.replace(" ", BYTE_LETTERS[0x20])
        else:
            letters = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        code = self[piece] = _packed_ids([token.id for token in self.tokens_of(letters)])
        if len(piece) > PIECE_TO_REMEMBER:
            self.passing.append(piece)
        self.held += 160 + 2 * len(piece)   # two objects and an entry
        return code

    def trim(self) -> None:
        """Forget long pieces, and all beyond the bound."""
        if self.held > MEMORY_BYTES:
            self.clear()
            self.held = 0
        else:
            for piece in self.passing:
                del self[piece]
                self.held -= 160 + 2 * len(piece)
        self.passing = []


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, definition: str, end_id: int, plain: bool):
        # one thread a task: the cluster has the cores, and threads that wait for work burn them
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True   # their strings in a text are ordinary text
        self.split = splitter(PATTERN) if plain else None
        self.end = np.array([end_id], "<u4").tobytes()
        self.known = Pieces(self.tokenizer.model.tokenize)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids_of, out = self.known.__getitem__, []
        for text in texts:
            text = text or ""
            if self.split and not _ELSEWHERE.search(text):
                out.append(b"".join(map(ids_of, self.split(text))) + self.end)
            else:
                out.append(_packed_ids(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end)
        self.known.trim()
        return out


def splits_plainly(definition: str) -> bool:
    """Whether a tokenizer file splits texts by ``PATTERN`` and nothing else."""
    parts = json.loads(definition)
    split = parts.get("pre_tokenizer") or {}
    return (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not parts.get("normalizer") and not parts.get("truncation"))


def share_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The text of a tokenizer file for the executors (a few megabytes, whatever
    the data)."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    return spark.sparkContext.broadcast((definition, splits_plainly(definition)))


def pack(df: DataFrame, tokenizer: Broadcast, text_col: str = "text", keep: list[str] | None = None, end_id: int = 1,
         capacity: int = CAPACITY, least_cut: int = LEAST_CUT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: ``keep`` (all columns by default) of its document,
    ``start`` (the document's ids before it), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` in the sequence, and the piece's ``ids`` as
    little-endian unsigned 32-bit numbers."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    names = {n for n, _ in RESULTS}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    rows = df.select(*kept, F.col(text_col).alias(free_name(df, "text")))
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField(n, t) for n, t in RESULTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, plain = tokenizer.value
        encoder = Encoder(definition, end_id, plain)
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        held, ids, tokens = [], [], 0
        for batch in slices(batches):
            codes = encoder.encode(batch.column(len(kept)).to_pylist())
            held.append(batch.select(list(range(len(kept)))))
            ids.extend(codes)
            tokens += sum(map(len, codes)) // 4
            if tokens >= block_tokens or len(ids) >= BLOCK_DOCUMENTS:
                windows = _packed(ids, capacity, least_cut)
                yield from _pieces(pa.Table.from_batches(held), ids, windows, sequence)
                sequence += len(windows)
                held, ids, tokens = [], [], 0
        if ids:
            yield from _pieces(pa.Table.from_batches(held), ids, _packed(ids, capacity, least_cut), sequence)

    return rows.mapInArrow(run, schema)


def _packed(ids: list[bytes], capacity: int, least_cut: int) -> list[list[tuple[int, int, int]]]:
    """The windows of one block, as (document, start, length) pieces."""
    windows, items = [], []
    for doc, code in enumerate(ids):
        n = len(code) // 4
        cut = n - n % capacity
        windows.extend([(doc, at, capacity)] for at in range(0, cut, capacity))
        if cut < n:
            items.append((doc, cut, n - cut))
    packed = best_fit_decreasing([x[2] for x in items], capacity)
    return windows + closed([[items[i] for i in w] for w in packed], capacity, least_cut)


def _pieces(held: pa.Table, ids: list[bytes], windows: list[list[tuple[int, int, int]]], sequence: int,
            rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The pieces of a block's windows as batches."""
    columns_held = [pa.concat_arrays(c.chunks) for c in held.columns]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        docs, starts, lengths, sizes, where, offsets, codes = zip(*out)
        numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, sizes, where, offsets)]
        rows_of = pa.array(docs, pa.int64())
        columns = [c.take(rows_of) for c in columns_held]
        return pa.RecordBatch.from_arrays(columns + numbers + [pa.array(codes, pa.binary())],
                                          names=held.column_names + [n for n, _ in RESULTS])

    for window in windows:
        offset = 0
        for doc, start, length in window:
            code = ids[doc]
            out.append((doc, start, length, len(code) // 4, sequence, offset, code[4 * start:4 * (start + length)]))
            offset += length
        sequence += 1
        if len(out) >= rows:
            yield batch()
            out.clear()
    if out:
        yield batch()


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces: the ids of each sequence
    in order, still without padding."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
