"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of text exactly one vocabulary token can end the
BPE encoding of that prefix.  ``PrefixTable`` stores that token per byte
prefix.  The token ending prefix ``i`` is the one token ``t`` with
``piece[:i]`` ending in ``t`` whose predecessor (the last token of the prefix
before it) may stand next to it, that is, the two bytes strings encoded
together stay these two tokens.  The table grows by one entry per byte, so an
append never touches earlier entries, and after an edit the entries behind it
are recomputed only until they agree with the old ones for as many bytes as
the longest token has.  Work is linear in the length of a piece whatever it
holds (no merge queue over a 100 kB run of one letter).

Texts are split by the caller's pattern; each match is encoded separately and
never crosses another match.  A match that is itself a token becomes that
token, as the public rank-file libraries do.

Defined cases: a null text encodes like an empty one (no ids); ids decode to
bytes, null ids to no bytes; columns named like a result column are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .frames import arrow_append, slices, spark_schema_with

#: What a task remembers between texts: pieces in bytes, and token pairs and steps
#: from byte to byte (always the same size).  These bound memory only; a full
#: table is emptied and results do not depend on it.  The tables end with the task.
PIECES_BYTES = 64 << 20
PAIRS_REMEMBERED = 200_000
STEPS_REMEMBERED = 200_000
ENTRY_BYTES = 160   # of a dictionary entry and its two objects, besides their contents
#: Longer pieces get a table of their own each time they occur.
PIECE_TO_REMEMBER = 48
#: Characters of texts whose new pieces are encoded together.
TOGETHER = 1 << 20
PIECES_AT_ONCE = 1 << 14   # whose tables are in memory together


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks, and for each token that encodes to itself the two tokens of its
    last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.usable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = None
            else:
                halves = self._halves(token, rank)
                if halves is None:
                    continue  # never the result of merging: only whole matches give it
                self.parts[rank] = halves
            self.usable[token] = rank
        self.longest = max(map(len, self.usable))
        self._pairs.clear()
        self._link()
        self.tables = PrefixTables(self)

    def _link(self) -> None:
        """The tokens that end at a byte, for any text read from left to right.

        A state is the longest end of the text read so far that some token
        begins with; ``ending[state]`` has the size and rank of each token that
        the text ends with there, longest first."""
        self.steps: dict[int, int] = {}    # state << 8 | byte: of the tokens' own prefixes
        at = {b"": 0}
        nodes = [b""]
        for token in self.usable:
            for n in range(1, len(token) + 1):
                prefix = token[:n]
                if prefix not in at:
                    at[prefix] = self.steps[at[prefix[:-1]] << 8 | prefix[-1]] = len(nodes)
                    nodes.append(prefix)
        self.shorter = [0] * len(nodes)    # the next shorter end that is a state
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(nodes)
        for prefix in sorted(nodes, key=len):
            state, rank = at[prefix], self.usable.get(prefix)
            if len(prefix) > 1:
                self.shorter[state] = self._walk(self.shorter[at[prefix[:-1]]], prefix[-1])
            rest = self.ending[self.shorter[state]]
            self.ending[state] = rest if rank is None else ((len(prefix), rank), *rest)
        self.state_of = {token: at[token] for token in self.usable}
        self._further: dict[int, int] = {}

    def _walk(self, state: int, byte: int) -> int:
        while True:
            after = self.steps.get(state << 8 | byte)
            if after is not None or not state:
                return after or 0
            state = self.shorter[state]

    def step(self, key: int) -> int:
        """The state after ``state << 8 | byte`` where no token goes on so."""
        after = self._further.get(key)
        if after is None:
            if len(self._further) >= STEPS_REMEMBERED:
                self._further.clear()
            after = self._further[key] = self._walk(key >> 8, key & 255)
        return after

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The pair that merges into ``token`` last, if its own bytes do."""
        for cut in range(1, len(token)):
            left, right = self.usable.get(token[:cut]), self.usable.get(token[cut:])
            if left is not None and right is not None and left < rank and right < rank \
                    and self._apart(left, right, below=rank):
                return left, right
        return None

    def _apart(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether encoding ``left + right`` together leaves the border
        between them unmerged (``below``: by merges of a smaller rank).

        Runs the merges of both tokens backwards.  At any moment the border
        lies between a right-edge part of ``left`` and a left-edge part of
        ``right``; those two are neighbours until the later of the merges that
        formed the next larger parts.  A token joining the two with a rank due
        before that moment would have swallowed the border.  Equal ranks merge
        from left to right, so at a tie the left token's own merge comes first.
        """
        bytes_of, ranks, parts = self.bytes_of, self.ranks, self.parts
        until = below if below is not None else 1 << 60
        x, y = left, right
        while True:
            joint = ranks.get(bytes_of[x] + bytes_of[y])
            if joint is not None and joint < until:
                return False
            px, py = parts[x], parts[y]
            if px is None and py is None:
                return True
            # undo the later merge; of equal ranks the right-hand one is later
            if py is None or (px is not None and x > y):
                until, x = x, px[1]
            else:
                # the merge inside the left token at this rank came earlier, and
                # so would a merge of the border at the same rank
                until, y = y + 1, py[0]

    def forget(self) -> None:
        """Drop what was learned from texts."""
        self._pairs.clear()
        self._further.clear()

    def pair(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS_REMEMBERED:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(left, right)
        return known


class PrefixTable:
    """Last token of every prefix of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [-1]
        self.states: list[int] = [0]
        if data:
            self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Extend the piece; entries of the old prefixes stay as they are."""
        start = len(self.data)
        self.data += more
        self.last.extend([-1] * len(more))
        self.states.extend([0] * len(more))
        self._fill(start + 1, len(self.data))
        return self

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of ``data[start:stop]``; returns how many
        prefixes were computed anew."""
        old_last, old_states, old_len = self.last, self.states, len(self.data)
        shift = len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old_last[:start + 1] + [-1] * (len(self.data) - start)
        self.states = old_states[:start + 1] + [0] * (len(self.data) - start)
        agreed, i, n = 0, start + 1, len(self.data)
        while i <= n:
            self._fill(i, i)
            behind = i - shift
            same = i > start + len(new) and behind <= old_len and self.last[i] == old_last[behind]
            agreed = agreed + 1 if same else 0
            i += 1
            if agreed >= self.vocabulary.longest:
                # every later entry depends on these bytes and entries alone
                self.last[i:] = old_last[i - shift:]
                self.states[i:] = old_states[i - shift:]
                break
        return i - 1 - start

    def _fill(self, first: int, end: int) -> None:
        data, last, states, v = self.data, self.last, self.states, self.vocabulary
        steps, step, ending, known, pair = v.steps.get, v.step, v.ending, v._pairs.get, v.pair
        state = states[first - 1]
        for i in range(first, end + 1):
            key = state << 8 | data[i - 1]
            state = steps(key)
            if state is None:
                state = step(key)
            for size, token in ending[state]:
                if size == i:
                    break
                before = last[i - size]
                ok = known(before << 32 | token)
                if ok or (ok is None and pair(before, token)):
                    break
            states[i], last[i] = state, token

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        bytes_of, last = self.vocabulary.bytes_of, self.last
        while i:
            token = last[i]
            out.append(token)
            i -= len(bytes_of[token])
        out.reverse()
        return out


class PrefixTables:
    """The tables of many short pieces at once, byte by byte in arrays.

    Tokens go by the state that they are (``Vocabulary._link``), 0 is none.
    Pieces in byte order share the entries of the prefixes that they begin with
    alike: only the first of them computes these."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        keys = np.fromiter(v.steps.keys(), np.int64, len(v.steps))
        order = np.argsort(keys)
        self.keys, self.after = keys[order], np.fromiter(v.steps.values(), np.int64, len(keys))[order]
        self.shorter = np.array(v.shorter)
        state_of = v.state_of
        rank_at = {v.usable[token]: state for token, state in state_of.items()}
        self.token = np.array([rank_at[ends[0][1]] if ends else 0 for ends in v.ending])
        self.rest = self.token[self.shorter]   # of a token: the next shorter one
        self.size, self.rank, self.left, self.right = np.zeros((4, len(v.ending)), np.int64)
        for token, state in state_of.items():
            self.size[state], self.rank[state] = len(token), v.usable[token]
            if len(token) > 1:
                self.left[state], self.right[state] = (rank_at[x] for x in v.parts[v.usable[token]])
        joined = {}
        for token, rank in v.ranks.items():
            for cut in range(1, len(token)):
                x, y = state_of.get(token[:cut]), state_of.get(token[cut:])
                if x and y:
                    joined[x << 32 | y] = rank
        self.joined = np.sort(np.fromiter(joined, np.int64, len(joined)))
        self.joined_rank = np.array([joined[k] for k in self.joined.tolist()], np.int64)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(state), np.arange(len(state))
        while len(at):
            key = state << 8 | byte
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            out[at[hit]] = self.after[place[hit]]
            on = ~hit & (state > 0)
            at, state, byte = at[on], self.shorter[state[on]], byte[on]
        return out

    def _apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``Vocabulary._apart`` of many pairs."""
        never = 1 << 60
        out, at, until = np.zeros(len(x), bool), np.arange(len(x)), np.full(len(x), never)
        while len(at):
            alive = np.ones(len(x), bool)
            if len(self.joined):
                key = x << 32 | y
                place = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
                alive = np.where(self.joined[place] == key, self.joined_rank[place], never) >= until
            whole_x, whole_y = self.left[x] == 0, self.left[y] == 0
            out[at[alive & whole_x & whole_y]] = True
            on = alive & ~(whole_x & whole_y)
            at, x, y, undo = at[on], x[on], y[on], whole_y[on] | (~whole_x[on] & (self.rank[x[on]] > self.rank[y[on]]))
            until = np.where(undo, self.rank[x], self.rank[y] + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out

    def codes(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of the pieces, which are in byte order and not
        empty, as little-endian 32-bit numbers."""
        n, sizes = len(pieces), np.array([len(x) for x in pieces])
        width = sizes.max()
        data = np.zeros((n, width), np.int64)
        data[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        differs = data[1:] != data[:-1]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        shared = np.concatenate([[0], np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))])
        last, state = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int64)
        for i in range(1, width + 1):
            first = shared < i
            source = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            rows = np.flatnonzero(first & (sizes >= i))
            now = self._step(state[rows], data[rows, i - 1])
            token = self.token[now]
            open_ = np.flatnonzero(self.size[token] < i)
            while len(open_):
                tried = token[open_]
                before = last[rows[open_], i - self.size[tried]].astype(np.int64)
                open_ = open_[~self._apart(before, tried) & (self.rest[tried] > 0)]
                token[open_] = self.rest[token[open_]]
            state[rows], last[rows, i] = now, token
            rows = np.flatnonzero(~first)
            state[rows], last[rows, i] = state[source[rows]], last[source[rows], i]
        ids, left, at, rows = np.zeros((n, width), "<i4"), sizes.copy(), np.full(n, width), np.arange(n)
        while len(rows):
            token = last[rows, left[rows]]
            at[rows] -= 1
            ids[rows, at[rows]] = self.rank[token]
            left[rows] -= self.size[token]
            rows = rows[left[rows] > 0]
        flat = ids[np.arange(width) >= at[:, None]].tobytes()
        ends = np.cumsum((width - at) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


_CLASSES = (r"\p{L}", r"\p{N}", r"\s", r"\S")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _members(escape: str) -> str:
    """A class escape of the ``regex`` module spelled out as code point ranges
    below U+10000."""
    matches = regex.compile(escape).match
    hits = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and matches(chr(c))]
    out, start = [], 0
    for i, c in enumerate(hits):
        if i + 1 == len(hits) or hits[i + 1] != c + 1:
            out.append(f"\\u{hits[start]:04x}-\\u{c:04x}")
            start = i + 1
    return "".join(out)


@lru_cache(maxsize=8)
def splitter(pattern: str):
    """``findall`` of a splitting pattern.  Patterns of plain syntax and the
    classes above also get a form for the ``re`` module, which is much quicker
    on texts without characters beyond U+FFFF; the matches are the same."""
    exact = regex.compile(pattern).findall
    parts = re.split(r"(\\p\{[LN]\}|\\[sS]|\[\^?|\])", pattern)
    out, inside = [], False
    for part in parts:
        if part in _CLASSES:
            if inside and part == r"\S":
                return exact
            members = _members(part.replace("S", "s") if part == r"\S" else part)
            out.append(members if inside else f"[{'^' * (part == r'\S')}{members}]")
            continue
        if "\\" in part or "(?" in part.replace("(?!", "").replace("(?=", ""):
            return exact   # syntax that the two modules may read differently
        if part in ("[", "[^", "]"):
            inside = part != "]"
        out.append(part)
    quick = re.compile("".join(out)).findall

    def split(text: str) -> list[str]:
        return exact(text) if _BEYOND.search(text) else quick(text)
    return split


class Codec:
    """Texts to ids and back for one vocabulary and one splitting pattern."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = splitter(pattern)
        self._remembered: dict[str, bytes] = {}
        self._held = 0

    def _learn(self, pieces: Iterable[str]) -> None:
        """Remember the ids of those pieces that are short or tokens."""
        whole, found, rest = self.vocabulary.ranks, [], []
        for data, piece in sorted((piece.encode("utf-8", "surrogatepass"), piece) for piece in pieces):
            if data in whole:
                found.append((piece, whole[data].to_bytes(4, "little")))
            elif len(data) <= PIECE_TO_REMEMBER:
                rest.append((data, piece))
        for at in range(0, len(rest), PIECES_AT_ONCE):
            part = rest[at:at + PIECES_AT_ONCE]
            found += zip([piece for _, piece in part], self.vocabulary.tables.codes([data for data, _ in part]))
        self._remembered.update(found)
        self._held += sum(ENTRY_BYTES + 2 * len(piece) + len(code) for piece, code in found)

    def _long(self, piece: str) -> bytes:
        ids = PrefixTable(self.vocabulary, piece.encode("utf-8", "surrogatepass")).ids()
        return np.array(ids, dtype="<i4").tobytes()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(text) for text in texts]
        if self._held > PIECES_BYTES:
            self._remembered.clear()
            self._held = 0
        known = self._remembered
        codes = [list(map(known.get, pieces)) for pieces in split]
        gaps = [[at for at, code in enumerate(out) if code is None] for out in codes]
        new = {pieces[at] for pieces, unknown in zip(split, gaps) for at in unknown}
        self._learn(new)
        for pieces, out, unknown in zip(split, codes, gaps):
            for at in unknown:
                code = known.get(pieces[at])
                out[at] = self._long(pieces[at]) if code is None else code
        return [np.frombuffer(b"".join(out), dtype="<i4") for out in codes]

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def encode(self, text: str) -> np.ndarray:
        return self._encode([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


#: Of a Python worker: the vocabulary, whose size is that of the rank file.  What
#: is remembered of texts belongs to the task's codec.
_WORKER: dict[str, object] = {}


def _vocabulary(ranks: Broadcast) -> Vocabulary:
    table = ranks.value
    if _WORKER.get("ranks") != table:
        _WORKER.update(ranks=table, vocabulary=Vocabulary(table))
    return _WORKER["vocabulary"]


def _bytes_of(ranks: Broadcast) -> tuple[np.ndarray, pa.Array]:
    """The ranks in order and, at the same places, their bytes."""
    table = ranks.value
    if _WORKER.get("decoded") != table:
        order = sorted(table, key=table.get)
        _WORKER.update(decoded=table, bytes_of=(np.array([table[t] for t in order]), pa.array(order, pa.large_binary())))
    return _WORKER["bytes_of"]


def _decoded(ids: pa.ListArray, known: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The bytes of each list: the tokens of all lists one behind the other
    are the bytes of all results, cut where the lists end."""
    wanted = ids.flatten()   # without null lists
    if wanted.null_count:
        raise KeyError(None)
    wanted = wanted.to_numpy()
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    if (known[at] != wanted).any():
        raise KeyError(int(wanted[known[at] != wanted][0]))
    taken = tokens.take(pa.array(at))
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    _, offsets, data = taken.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int64)[taken.offset:taken.offset + len(taken) + 1][ends]
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts), data])
    return whole.cast(pa.binary())


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for the executors.  Its size is that of the rank file
    (tens of thousands of tokens), never that of the data."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(df: DataFrame, ranks: Broadcast, pattern: str, text_col: str = "text", ids_col: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids_col`` (array<int>): the BPE ids of each whole text.

    ``keep`` names the input columns to return (all by default), so that
    texts need not travel back from the Python workers.
    """
    kept = df.columns if keep is None else keep

    def run(batches):
        vocabulary = _vocabulary(ranks)
        codec = Codec(vocabulary, pattern)
        for batch in slices(batches):
            codes = list(codec.encode_all(t or "" for t in batch.column(text_col).to_pylist()))
            offsets = np.zeros(len(codes) + 1, dtype=np.int32)
            np.cumsum([len(c) for c in codes], out=offsets[1:])
            values = pa.array(np.concatenate(codes) if codes else np.empty(0, "<i4"))
            yield arrow_append(batch.select(kept), [(ids_col, pa.ListArray.from_arrays(pa.array(offsets), values))])
        vocabulary.forget()

    return df.mapInArrow(run, spark_schema_with(df.select(*kept), [(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ranks: Broadcast, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` (binary): the bytes that the ids stand for."""
    def run(batches):
        known, tokens = _bytes_of(ranks)
        for batch in slices(batches):
            yield arrow_append(batch, [(out_col, _decoded(batch.column(ids_col), known, tokens))])

    return df.mapInArrow(run, spark_schema_with(df, [(out_col, T.BinaryType())]))
