"""Toxicity scores after noisy-channel deobfuscation.

Writers hide words by look-alike characters (``1d10t``), spacing (``i d i o t``)
and repetition (``idiiiiot``).  Such spans become character lattices: every
observed character may stand for itself or for the letters it imitates, a run
of one letter may stand for one or two, a separator may be a blank or
nothing.  A Viterbi pass under a character trigram model picks the likeliest
letters, and the restored words are what the score sees.  Look-alikes at the
ends of a token may be punctuation or letters (``$tupid``, ``a$$``): it is read
both ways, without them and with them as letters.

* Language model: trigram counts over every text of the corpus, gathered per
  task and summed.  Letters rarer than the ``ALPHABET`` most frequent ones
  share one class.
* Evidence: words, their first letters and the n-grams of long letter runs
  (in scripts without blanks, of every run), counted over all labelled training
  rows (once per document), ranked by the likelihood ratio with the label.
* Weights: logistic regression over the ``FEATURES`` best ranked, fitted on at
  most ``SAMPLE_ROWS`` labelled rows chosen by a hash of their id.

Scores read the text only.  Every document is scored over its whole text.

Defined cases: null and empty texts score the bias alone; a label that is
neither 0 nor 1 is not learned from; labels repeated for a document count each
time; without labelled rows of both classes every score is the share of label
1 (0 without any); columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_append, slices, spark_schema_with
from .labelled import drawn, labelled_texts

ALPHABET = 60
FEATURES = 4096
SAMPLE_ROWS = 12_000
MIN_DOCS = 4             # documents of label 1 that a feature needs
LONG = 16                # longer words are named by a digest and also give n-grams
GRAMS = (2, 3, 4)        # sizes of the n-grams of long letter runs
TOKENS_REMEMBERED = 200_000
COUNTS_HELD = 400_000    # distinct features a task counts before it passes them on

# Letters that a character is written for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
END_FORMS = 16           # forms of a token with marks kept at its ends; where there are more, one lattice holds all
SUBSTITUTE, REPEAT, JOIN = -2.0, -1.0, -0.5   # log costs of the channel
EDGE = " "

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿·"
_PLAIN_MARKS = "".join(c for c in _MARKS if c not in LOOKS_LIKE)
_DOTTED = re.compile(r"(?:[^\W_]|[@$!|+€])(?:[._*\-]{1,2}(?:[^\W_]|[@$!|+€])){2,}")
_GRAMMED = re.compile(   # Thai, Lao, Burmese, Khmer, kana and Han; other letters in long runs
    r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{2,}"
    rf"|[^\W\d_]{{{LONG + 1},}}")
_RUN = re.compile(r"(.)\1{2,}", re.DOTALL)


class CharModel:
    """Interpolated trigram probabilities over a bounded alphabet."""

    def __init__(self, alphabet: str, counts: np.ndarray):
        self.code = {c: i + 2 for i, c in enumerate(alphabet)}
        self.code[EDGE] = 0   # 1: any other character
        three = counts.astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        n = len(counts)
        p1 = (one + 1) / (one.sum() + n)
        p2 = (two + 5 * p1[None, :]) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None, :, :]) / (three.sum(axis=2, keepdims=True) + 5)
        self.logp = np.log(p3).tolist()

    def of(self, char: str) -> int:
        return self.code.get(char, 1)


def viterbi(model: CharModel, lattice: list[list[tuple[str, float]]]) -> tuple[str, float]:
    """The likeliest reading of a lattice: per position (text, log cost)
    options, each of no, one or two letters.  Starts and ends at a blank.
    One pass over the whole lattice; a path points back to the one it extends.
    The reading and its log probability."""
    logp, of = model.logp, model.of
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in [*lattice, [(EDGE, 0.0)]]:
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in paths.items():
            for letters, cost in options:
                x, y, s = a, b, score + cost
                for c in letters:
                    z = of(c)
                    s += logp[x][y][z]
                    x, y = y, z
                known = reached.get((x, y))
                if known is None or s > known[0]:
                    reached[(x, y)] = (s, (path, letters) if letters else path)
        paths = reached
    (score, path), read = max(paths.values(), key=lambda found: found[0]), []
    while path is not None:
        path, letters = path
        read.append(letters)
    return "".join(reversed(read)).strip(), score


def _lattice(token: str, spaced: bool, front: int = 0, back: int = 0,
             drop: bool = False) -> list[list[tuple[str, float]]]:
    """Look-alikes among the first ``front`` and last ``back`` characters are
    letters, with ``drop`` letters or nothing."""
    out, i = [], 0
    while i < len(token):
        c = token[i]
        j = i + 1
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        sure = c in LOOKS_LIKE and (i < front or i >= len(token) - back)
        if c.isalpha():
            options = [(c, 0.0)]
        elif sure:
            options = [(x, SUBSTITUTE) for x in LOOKS_LIKE[c]] + [("", 0.0)] * drop
        elif c in LOOKS_LIKE:
            options = [(x, SUBSTITUTE) for x in LOOKS_LIKE[c]] + [(c, 0.0)]
        elif spaced and not c.isalnum():
            options = [("", JOIN), (EDGE, JOIN)]
        else:
            options = [(c, 0.0)]
        if n >= 3 and (sure or c.isalpha()):
            out.append([(x, s + REPEAT) for x, s in options] + [(x * 2, s + REPEAT) for x, s in options])
        elif spaced and not c.isalnum() and c not in LOOKS_LIKE:
            out.append(options)
        else:
            out.extend([options] * n)
        i = j
    return out


def _dotted(span: str) -> bool:
    return _DOTTED.fullmatch(span) is not None   # i.d.i.o.t


def _cuts(marks: str) -> list[int]:
    """How many of the ``marks`` after a word may belong to it: none, or up to
    the end of a run that holds a look-alike."""
    return [0, *(i + 1 for i, c in enumerate(marks) if c in LOOKS_LIKE and marks[i + 1:i + 2] != c)]


def _open_ends(raw: str, bare: str) -> list[tuple[str, int, int, bool]]:
    """Forms of ``raw`` with look-alikes kept before or after ``bare``, how many
    characters are kept on both sides, and whether the model may drop them."""
    at = raw.index(bare)
    before, after = raw[:at], raw[at + len(bare):]
    fronts, backs = _cuts(before[::-1]), _cuts(after)
    many = len(fronts) * len(backs) > END_FORMS
    ends = [(fronts[-1], backs[-1])] if many else [(f, b) for f in fronts for b in backs if f or b]
    return [(before[len(before) - f:] + bare + after[:b], f, b, many) for f, b in ends]


class Restorer:
    """Texts to the set of their restored words, in lower case."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def _decode(self, span: str, spaced: bool, front: int = 0, back: int = 0,
                drop: bool = False) -> tuple[str, ...]:
        lattice = _lattice(span, spaced, front, back, drop)
        if all(len(options) == 1 for options in lattice):   # nothing to choose
            return tuple("".join(options[0][0] for options in lattice).split())
        return tuple(viterbi(self.model, lattice)[0].split())

    def _unlettered(self, raw: str, bare: str) -> tuple[str, ...]:
        """Readings of a token without letters, where all is look-alikes and
        the model finds letters likelier than the token as it stands."""
        forms = [bare, *(form for form, *_ in _open_ends(raw, bare))] if bare else [raw.strip(_PLAIN_MARKS)]
        words = []
        for form in forms:
            if form and all(c in LOOKS_LIKE for c in form):
                word, score = viterbi(self.model, _lattice(form, False, len(form)))
                if score > viterbi(self.model, [[(c, 0.0)] for c in form])[1]:
                    words.append(word)
        return tuple(dict.fromkeys(words))

    def token(self, raw: str) -> tuple[str, ...]:
        found = self.known.get(raw)
        if found is None:
            bare = raw if raw.isalpha() else raw.strip(_MARKS)
            if not bare.isalpha() and not any(map(str.isalpha, bare)):
                found = self._unlettered(raw, bare)
            else:
                if bare.isalpha() and not _RUN.search(bare):
                    words = [bare]
                else:
                    words = [*self._decode(bare, _dotted(bare)), *re.findall(r"[^\W\d_]+", bare)]
                if bare is not raw and len(raw.strip(_PLAIN_MARKS)) != len(bare):   # look-alikes at an end
                    for form, *kept in _open_ends(raw, bare):
                        words.extend(self._decode(form, _dotted(form), *kept))
                found = tuple(dict.fromkeys(words))
            if len(self.known) >= TOKENS_REMEMBERED:
                self.known.clear()
            self.known[raw] = found
        return found

    def spaced(self, tokens: list[str]) -> list[tuple[str, ...]]:
        """Readings of runs of three or more single characters."""
        sizes = list(map(len, tokens))
        if sizes.count(1) < 3:
            return []
        out, i, n = [], 0, len(tokens)
        while i < n:
            if sizes[i] != 1:
                i += 1
                continue
            j = i
            while j < n and sizes[j] == 1:
                j += 1
            if j < n and sizes[j] == 2 and tokens[j][1] in _MARKS:
                j += 1   # the last letter and a full stop
            if j - i >= 3:
                span = " ".join(tokens[i:j])
                bare = span.rstrip(_MARKS + EDGE) or span
                out.append(self._decode(bare, True))
                out.extend(self._decode(form, True, *kept) for form, *kept in _open_ends(span, bare))
            i = j
        return out

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        out: set[str] = set()
        for raw in set(tokens):
            out.update(self.token(raw))
        for found in self.spaced(tokens):
            out.update(found)
        return out


def features_of(word: str) -> tuple[str, ...]:
    """The word (its digest, if long), its first letters, and the n-grams of
    long letter runs and of scripts without blanks."""
    if len(word) < 3 and not _GRAMMED.fullmatch(word):
        return ()
    whole = word if len(word) <= LONG else "#" + xxhash.xxh3_128_hexdigest(word.encode("utf-8", "surrogatepass"))
    found = [whole, *[f"{word[:n]}~" for n in (4, 5) if len(word) > n]]
    if len(word) > LONG or not word.isascii():
        for run in _GRAMMED.findall(word):
            found.extend(f"~{run[i:i + n]}~" for n in GRAMS for i in range(len(run) - n + 1))
    return tuple(found)


def fit_alphabet(docs: DataFrame, text_col: str, letters: int = ALPHABET) -> str:
    """The most frequent letters over all texts."""
    def run(batches):
        total = np.zeros(0x110000, dtype=np.int64)
        for batch in slices(batches):
            text = "".join(t.lower() for t in batch.column(0).to_pylist() if t)
            found = np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"))
            total[:len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"c": [chr(c) for c in at], "n": total[at]},
                                         schema=pa.schema([("c", pa.string()), ("n", pa.int64())]))

    counted = docs.select(text_col).mapInArrow(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("c").rlike(r"^\p{L}$")).orderBy(F.desc("n"), "c").limit(letters).collect()
    return "".join(sorted(r["c"] for r in top))


def fit_char_model(docs: DataFrame, text_col: str, letters: int = ALPHABET) -> CharModel:
    """Trigram counts of the whole corpus."""
    alphabet = fit_alphabet(docs, text_col, letters)
    n = len(alphabet) + 2

    def run(batches):
        table = np.ones(0x110000, dtype=np.int32)
        for i, c in enumerate(alphabet):
            table[ord(c)] = i + 2
        for c in range(0x110000):
            if c < 0x3100 and chr(c).isspace():
                table[c] = 0
        total = np.zeros(n ** 3, dtype=np.int64)
        for batch in slices(batches):
            text = EDGE.join(["", *(t.lower() for t in batch.column(0).to_pylist() if t), "", ""])
            codes = table[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
            total += np.bincount((codes[:-2] * n + codes[1:-1]) * n + codes[2:], minlength=n ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": at, "n": total[at]},
                                         schema=pa.schema([("k", pa.int64()), ("n", pa.int64())]))

    summed = docs.select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    rows = summed.toPandas()   # at most (letters + 2)^3 numbers, whatever the corpus
    counts = np.zeros(n ** 3)
    counts[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return CharModel(alphabet, counts.reshape(n, n, n))


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, n: int, l2: float = 0.1, steps: int = 600):
    """Weights and bias by gradient steps of adapted size on sparse 0/1 rows;
    the rarer label counts more, by the root of the classes' ratio."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    cols = np.concatenate(rows) if len(rows) else np.empty(0, int)
    owner = np.repeat(np.arange(len(rows)), sizes)
    ones = labels.sum()
    each = np.where(labels > 0, np.sqrt(max(1.0, (len(labels) - ones) / max(1.0, ones))),
                    np.sqrt(max(1.0, ones / max(1.0, len(labels) - ones))))
    w, b = np.zeros(n), 0.0
    square, square_b = np.full(n, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, weights=w[cols], minlength=len(rows)) + b
        error = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels)
        grad = np.bincount(cols, weights=error[owner], minlength=n) + l2 * w
        square += grad * grad
        square_b += error.sum() ** 2
        w -= 0.5 * grad / np.sqrt(square)
        b -= 0.5 * error.sum() / np.sqrt(square_b)
    return w, b


def score(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", keep: list[str] | None = None,
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` (its columns ``keep``) with the score and whether it reaches
    0.5, under ``names``.

    ``labelled`` holds (id, label) of the rows to learn from; their texts come
    from ``docs``.
    """
    spark = docs.sparkSession
    kept = docs.columns if keep is None else keep
    train, n1, n0 = labelled_texts(docs, labelled, id_col, text_col, label_col, "toxicity-labels")
    if not (n1 and n0):   # nothing to tell apart: the share of the one label there is
        share = n1 / (n1 + n0) if n1 + n0 else 0.0
        others = [c for c in kept if c.lower() not in {n.lower() for n in names}]
        return docs.select(*others, F.lit(share).alias(names[0]), F.lit(int(share >= 0.5)).alias(names[1]))
    model = spark.sparkContext.broadcast(fit_char_model(docs, text_col))
    index = {f: i for i, f in enumerate(_evidence(train, model, n1, n0))}
    weights, bias = _fit(train, model, index, n1 + n0)
    table = spark.sparkContext.broadcast({f: float(weights[i]) for f, i in index.items()})   # FEATURES entries

    def run(batches):
        restorer = Restorer(model.value)
        value = table.value
        strip: dict[str, tuple[str, ...]] = {}

        def of_token(raw):
            found = strip.get(raw)
            if found is None:
                found = tuple({f for w in restorer.token(raw) for f in features_of(w) if f in value})
                if len(strip) >= TOKENS_REMEMBERED:
                    strip.clear()
                strip[raw] = found
            return found

        for batch in slices(batches):
            z = []
            for text in batch.column(text_col).to_pylist():
                seen: set[str] = set()
                if text:
                    tokens = text.lower().split()
                    for raw in set(tokens):
                        seen.update(of_token(raw))
                    for words in restorer.spaced(tokens):
                        seen.update(f for word in words for f in features_of(word) if f in value)
                z.append(bias + sum(map(value.__getitem__, sorted(seen))))
            p = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -700, 700)))
            yield arrow_append(batch.select(kept), [(names[0], pa.array(p)),
                                                    (names[1], pa.array((p >= 0.5).astype(np.int32)))])

    columns = list(dict.fromkeys([*kept, text_col]))
    source = docs.select(*columns)
    return source.mapInArrow(run, spark_schema_with(
        source.select(*kept), [(names[0], T.DoubleType()), (names[1], T.IntegerType())]))


def _features(restorer: Restorer, text: str | None) -> set[str]:
    return {f for w in restorer.words(text) for f in features_of(w)} if text else set()


def _evidence(train: DataFrame, model, n1: int, n0: int) -> list[str]:
    """The features most strongly tied to the label, over all training rows."""
    def run(batches):
        restorer = Restorer(model.value)
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def row():
            names = list(held[0].keys() | held[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([held[1][f] for f in names], pa.int64()),
                 pa.array([held[0][f] for f in names], pa.int64())], names=["f", "a", "b"])

        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[label].update(_features(restorer, text))
            if len(held[0]) + len(held[1]) >= COUNTS_HELD:
                yield row()
                held = (Counter(), Counter())
        yield row()

    counted = (train.select("label", "text").mapInArrow(run, "f string, a long, b long")
               .groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))

    def part(k, total, n):
        # k * log(k / expected); nothing for k = 0
        return F.when(k > 0, k * F.log(k / (total * F.lit(n / max(1, n1 + n0))))).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    both = a + b
    gain = (part(a, both, n1) + part(b, both, n0) + part(F.lit(n1) - a, F.lit(n1 + n0) - both, n1)
            + part(F.lit(n0) - b, F.lit(n1 + n0) - both, n0))
    top = (counted.filter(a >= MIN_DOCS).withColumn("gain", gain)
           .orderBy(F.desc("gain"), "f").limit(FEATURES).collect())
    return [r["f"] for r in top]


def _fit(train: DataFrame, model, index: dict[str, int], rows: int):
    """Weights from at most ``SAMPLE_ROWS`` training rows, drawn by hash."""
    table = train.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        restorer, at = Restorer(model.value), table.value
        for batch in slices(batches):
            found = [sorted(at[f] for f in _features(restorer, t) if f in at) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))],
                                             names=["label", "draw", "f"])

    got = (drawn(train, SAMPLE_ROWS, rows).mapInArrow(run, "label int, draw long, f array<int>")
           .orderBy("draw", "label", F.col("f").cast("string")).limit(SAMPLE_ROWS).collect())
    return fit_logistic([np.array(r["f"], dtype=np.int64) for r in got], np.array([r["label"] for r in got], float),
                        len(index))
