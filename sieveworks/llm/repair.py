"""Conversation structure repair: the cheapest edits that make turns alternate.

Rows are repartitioned by conversation and sorted by turn; ``mapInPandas`` then
reads them as a stream and carries the state of a dynamic programme from one
Arrow batch to the next.  A conversation may begin in one batch and end many
batches later: what is kept of it is one byte per row and state (the
backpointers) and the texts that may survive, both spilled to a file of the
task beyond ``SPILL_BYTES``.  At the conversation's end the pointers are read
backwards, the edits forwards again beside the texts.

Edits: *Keep* costs 0, *Rerole* to user or assistant 1, *Delete* 2, *Insert* of
an empty user or assistant row 5; a truncated row that is not deleted adds 5.
Blank rows and duplicates have to be deleted.  The result is either nothing or
an optional system row followed by user and assistant rows in turn, beginning
with a user and ending with an assistant.  Of the cheapest edits the one whose
initials (D, I, K, R) come first in ASCII order is chosen.  An audit fixes the
repaired roles: from each state only one role of user and assistant may follow.

Costs are kept relative to the cheapest state, so the programme has few
distinct positions; a step from one of them is worked out once and then looked
up.  Two audits that have read the same rows never are prefixes of each other
(each ends with a row's edit), so the order of the states' audits is all that
ties need.

A row's first fault counts: *blank* (no character but ASCII white space),
*duplicate* (role and text seen earlier in the conversation), *truncated* (the
last other character is none of ``.!?``).  Duplicates are found by Spark, in a
window that uses the same partitioning.

Defined cases: null role and text read as one space; null turns come first,
null conversations are one conversation; rows of one turn follow role and
text; only roles that begin with s, u or a can be kept (an empty role has no
initial and cannot); ``gaps`` that exceed 64 bits stop there; an empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPILL_BYTES = 8 << 20
SPACE = r"\x20\x09-\x0D"
RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")

START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}   # inserts that finish a conversation
FINE, TRUNCATED, GONE = range(3)                      # a row may stay, stays at a price, has to go
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
CUT_OFF = 5
EDITS = ("D", "K", "R")
LONGEST = 2 ** 63 - 1


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped) of conversations with faults: by the
    CRC-32 of ``conv:turn`` modulo 20, 0 drops a row (it stays as a mark of its
    conversation), 1 empties its text, 2 removes the sentence ends, 3 repeats
    it and 4 makes its role user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col(turn_col).cast("string"), blank))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col), blank).alias("role"),
                       F.coalesce(F.col(text_col), blank).alias("text"),
                       F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("fault"))
    text = (F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"),
                       F.explode(F.array_repeat(F.lit(0), times)).alias("again")).drop("again")


def faults(text: Column, nth: Column) -> Column:
    """``B``, ``D``, ``T`` or an empty text for a row that is the ``nth`` with
    its role and text."""
    return (F.when(~text.rlike(f"[^{SPACE}]"), F.lit("B")).when(nth > 1, F.lit("D"))
            .when(~text.rlike(rf"[.!?][{SPACE}]*\z"), F.lit("T")).otherwise(F.lit("")))


def summary(rows: DataFrame, conv_col: str = "conv_id", spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per conversation of (conv, turn, role, text, dropped): faults
    found, the cost of the cheapest edits, their audit and the SHA-256 of the
    repaired ``role:text`` lines."""
    return _streamed(rows, conv_col, RESULT, lambda c: [c.result()], spill_bytes)


def repaired(rows: DataFrame, conv_col: str = "conv_id", spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """The repaired conversations of (conv, turn, role, text, dropped), one row
    per line: its ``position`` from 0, the ``edit`` that it owes its place to
    (K, R or I), ``role`` and ``text``."""
    def lines(conversation: Conversation) -> Iterator[tuple]:
        kept = conversation.lines(conversation.audit())
        for position, (edit, role, text) in enumerate(kept):
            yield position, edit, role.decode("utf-8", "surrogatepass"), text.decode("utf-8", "surrogatepass")

    return _streamed(rows, conv_col, "position long, edit string, role string, text string", lines, spill_bytes)


def _streamed(rows: DataFrame, conv_col: str, result: str, finish, spill_bytes: int) -> DataFrame:
    """What ``finish`` makes of each conversation, read as one sorted stream."""
    rows = rows.select("conv", "turn", "role", "text", "dropped")
    seen = Window.partitionBy("conv", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    # one exchange: the window and the stream both use the rows of a conversation where they are
    ordered = (rows.repartition("conv").withColumn("nth", F.row_number().over(seen))
               .withColumn("fault", F.when(F.col("dropped"), F.lit("X"))
                           .otherwise(faults(F.col("text"), F.col("nth"))))
               .sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role",
                                     "text", "nth"))
    # pandas has no nullable integers of 64 bits: ids travel as text
    read = ordered.select(F.col("conv").cast("string").alias("conv"), F.col("conv").isNull().alias("no_conv"),
                          F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"),
                          "role", "text", "fault")
    names = ["conv", *[c.split()[0] for c in result.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        for conversation in _conversations(batches, spill_bytes):
            for row in finish(conversation):
                done.append((conversation.key, *row))
                if len(done) >= 1024:
                    yield pd.DataFrame(done, columns=names)
                    done = []
        if done:
            yield pd.DataFrame(done, columns=names)

    out = read.mapInPandas(run, f"conv string, {result}")
    return out.select(F.col("conv").cast(rows.schema["conv"].dataType).alias(conv_col), *names[1:])


def _conversations(batches: Iterator[pd.DataFrame], spill_bytes: int) -> Iterator[Conversation]:
    """The conversations of sorted rows, each when its last row is read."""
    step = Steps()
    current: Conversation | None = None
    columns = ["conv", "no_conv", "turn", "no_turn", "role", "text", "fault"]
    for batch in batches:
        for conv, no_conv, turn, no_turn, role, text, fault in zip(*[batch[c] for c in columns]):
            key = None if no_conv else conv
            if current is None or current.key != key:
                if current is not None:
                    yield current
                current = Conversation(key, step, spill_bytes)
            if fault != "X":
                current.add(None if no_turn else turn, role, text, fault)
    if current is not None:
        yield current


def inserted(state: int, count: int) -> int:
    """The state after ``count`` inserted rows."""
    for _ in range(count):
        state = ASSISTANT if state == USER else USER
    return state


def _after(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, int, int]]:
    """(inserts, edit, new state, cost) of all ways to take a row in ``state``."""
    for count in range(3):
        at, cost = inserted(state, count), INSERT * count
        yield count, 0, at, cost + DELETE
        if fault == GONE:
            continue
        price = cost + (CUT_OFF if fault == TRUNCATED else 0)
        following = ASSISTANT if at == USER else USER
        if initial == "s" and at == START:
            yield count, 1, SYSTEM, price + KEEP
        if initial == ("a" if following == ASSISTANT else "u"):
            yield count, 1, following, price + KEEP
        yield count, 2, following, price + REROLE


class Steps:
    """The dynamic programme's steps, each worked out once.

    A position is, in the order of the audits, the reachable states with their
    costs above the cheapest one."""

    FIRST = ((START, 0),)

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def __call__(self, position: tuple, initial: str, fault: int) -> tuple[tuple, int, bytes]:
        key = position, initial, fault
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._step(position, initial, fault)
        return found

    @staticmethod
    def _step(position: tuple, initial: str, fault: int) -> tuple[tuple, int, bytes]:
        best: dict[int, tuple] = {}
        for order, (state, so_far) in enumerate(position):
            for count, edit, new, cost in _after(state, initial, fault):
                # cheapest first, then by the audits so far, then by what this row adds
                way = so_far + cost, order, "I" * count + EDITS[edit], state
                if new not in best or way < best[new]:
                    best[new] = way
        least = min(way[0] for way in best.values())
        pointers = bytearray(4)
        for new, (_, _, added, state) in best.items():
            pointers[new] = state << 4 | (len(added) - 1) << 2 | EDITS.index(added[-1])
        ordered = sorted(best, key=lambda s: best[s][1:3])
        return tuple((s, best[s][0] - least) for s in ordered), least, bytes(pointers)


class Spill:
    """Bytes appended in memory, beyond a size in a nameless file of the task."""

    def __init__(self, most: int):
        self.file = tempfile.SpooledTemporaryFile(max_size=most)
        self.size = 0

    def append(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def backwards(self, block: int = 1 << 16) -> Iterator[bytes]:
        """Blocks from the last to the first."""
        for end in range(self.size, 0, -block):
            start = max(0, end - block)
            self.file.seek(start)
            yield self.file.read(end - start)

    def forwards(self):
        self.file.seek(0)
        return self.file


class Conversation:
    """What the stream holds of the conversation that it is in."""

    def __init__(self, key, step: Steps, spill_bytes: int):
        self.key, self.step = key, step
        self.position, self.cost = Steps.FIRST, 0
        self.pointers, self.texts = Spill(spill_bytes), Spill(spill_bytes)
        self.first = self.last = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        initial = role[:1]
        if self.initial is not None and (self.initial + initial) not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        kind = FINE
        if fault == "T":
            self.truncated += 1
            kind = TRUNCATED
        elif fault:
            kind = GONE
            if fault == "B":
                self.blank += 1
            else:
                self.duplicate += 1
        self.position, added, pointers = self.step(self.position, initial if initial in ("s", "u", "a") else "", kind)
        self.cost += added
        self.pointers.append(pointers)
        if kind != GONE:
            line = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
            self.texts.append(struct.pack("<BII", 1, len(line[0]), len(line[1])) + line[0] + line[1])
        else:
            self.texts.append(b"\x00")

    def end(self) -> tuple[int, int]:
        """The last row's state of the cheapest edits, and what finishing costs
        above the cheapest state."""
        if not self.pointers.size:
            return START, 0
        ways = [(over + INSERT * ENDS[s], order, s) for order, (s, over) in enumerate(self.position)]
        extra, _, state = min(ways)
        return state, extra

    def result(self) -> tuple:
        gaps = min(self.last - self.first + 1 - self.turns, LONGEST) if self.turns else 0
        audit, digest, lines = self.audit(), hashlib.sha256(), 0
        for _, role, text in self.lines(audit):
            digest.update((b"\n" if lines else b"") + role + b":" + text)
            lines += 1
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + self.end()[1], audit,
                digest.hexdigest())

    def audit(self) -> str:
        """The edits' initials, read from the pointers backwards."""
        state, _ = self.end()
        parts = bytearray(b"I" * ENDS[state])
        for block in self.pointers.backwards():
            for at in range(len(block) - 4, -1, -4):
                pointer = block[at + state]
                parts += EDITS[pointer & 3].encode() + b"I" * (pointer >> 2 & 3)
                state = pointer >> 4
        parts.reverse()
        return parts.decode()

    def lines(self, audit: str) -> Iterator[tuple[str, bytes, bytes]]:
        """(edit, role, text) of the repaired rows: the edits beside the texts."""
        state, file = START, self.texts.forwards()
        for edit in audit:
            role = text = b""
            if edit != "I" and file.read(1)[0]:
                n, m = struct.unpack("<II", file.read(8))
                role, text = file.read(n), file.read(m)
            if edit == "D":
                continue
            if edit == "K" and role[:1] == b"s":
                state = SYSTEM
            else:
                state = ASSISTANT if state == USER else USER
                if edit != "K":
                    role = b"assistant" if state == ASSISTANT else b"user"
            yield edit, role, text
