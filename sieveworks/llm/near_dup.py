"""Near-duplicate documents by BagMinHash signatures.

A document is the multiset of its five-word shingles; two documents are near
duplicates when the weighted Jaccard similarity of the multisets (sum of the
smaller counts over sum of the larger) is at least 0.8.

**Signature.**  Every shingle owns Poisson processes over its weight axis, one
for each octave [0,1), [1,2), [2,4), [4,8), ...; a point has a time, a position
inside the octave and a signature slot.  A document with count ``c`` of the
shingle sees the points at positions below ``c``, and a slot keeps the point
with the earliest time.  Two slots agree with probability equal to the
weighted Jaccard similarity.  Only points earlier than a horizon are
generated, long enough to fill all slots almost always; documents with an
empty slot get a longer one, so the horizon never changes a signature.

**Candidates.**  Signatures are cut into bands; equal bands share a bucket.
Equal texts are one node.  First every node of a bucket is compared with the
bucket's smallest node (a star, never all pairs), in large buckets with two
more centres, which merges most of a large group of near copies; verified
links are merged to components.  What is left are buckets with some nodes outside their largest
component: those nodes are compared with all nodes of the bucket, block
against block of bounded size, by whole signatures in memory; pairs that agree
in enough slots to reach the similarity (within five standard deviations) are
verified on the spot, best first, until their components are joined, so a
block hands on at most one link for each component it joins.  A pair is
examined in the first bucket that it shares.  Buckets with very many outside
nodes (texts that share a passage) are first split by a second and third band,
which similar nodes share as well.  Nothing is capped: every pair of a bucket
that could join two components is examined.

**Verification.**  Links are verified on the shingle counts of the whole
texts.  Classes are the connected components of verified links.

Defined cases: null counts as the empty text; texts of one to four words
are one shingle; texts without words form one class; rows that repeat id and
text are in one class; ``class_id`` is the smallest non-null id of the class
(null if none has one); exactly one row per class is ``kept``, the first by
(id, null last, then digest of the text) - rows equal in both are marked alike
and ``deduplicate`` keeps one of them; words are compared in lower case, white
space apart; columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import materialize, slices

SHINGLE = 5
SIMILARITY = (4, 5)        # as a fraction
BAND_ROWS, BANDS = 4, 24
SLOTS = BAND_ROWS * BANDS
BLOCK = 2048               # nodes compared in memory at once
SPLITS = 2                 # further bands that split buckets with many components
STARS = 2                  # further centres of large buckets, at most 3
LARGE = 256                # nodes of a bucket from which they are taken
BROADCAST_NODES = 2_000_000
WORDS_REMEMBERED = 500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to hashed shingle multisets."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if len(self.known) >= WORDS_REMEMBERED:
            self.known.clear()
        code = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes and their counts."""
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        known = self.known
        codes = list(map(known.get, words))
        if None in codes:
            for i in [i for i, c in enumerate(codes) if c is None]:
                codes[i] = known.get(words[i]) or self._word(words[i])
        h = np.array(codes, dtype=np.uint64)
        n = max(1, len(h) - self.size + 1)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(min(self.size, len(h))):
            out = out * np.uint64(0x100000001B3) + mix(h[i:i + n] + np.uint64(i + 1))
        return np.unique(mix(out), return_counts=True)


#: Of a Python worker: the words it has hashed serve the next cells as well.
_SHINGLER = Shingler()


def similarity_reached(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether the weighted Jaccard similarity is at least SIMILARITY."""
    sums = int(a[1].sum()), int(b[1].sum())
    if SIMILARITY[1] * min(sums) < SIMILARITY[0] * max(sums):
        return False   # too different in length
    if not len(a[0]):
        return True
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return SIMILARITY[1] * both >= SIMILARITY[0] * (sum(sums) - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures (documents x slots, uint32) of non-empty bags."""
    out = np.zeros((len(bags), slots), dtype=np.uint32)
    weight = np.array([c.sum() for _, c in bags], dtype=np.float64)
    horizon = (np.log(slots) + 4.0) / weight
    todo = np.arange(len(bags))
    while len(todo):
        filled = _fill(out, todo, bags, horizon, slots)
        todo = todo[~filled]
        horizon[todo] *= 2
    return out


def _fill(out, todo, bags, horizon, slots) -> np.ndarray:
    sizes = [len(bags[d][0]) for d in todo]
    doc = np.repeat(np.arange(len(todo)), sizes)
    element = np.concatenate([bags[d][0] for d in todo])
    count = np.concatenate([bags[d][1] for d in todo])
    # one process per octave of the weight axis that the count reaches into
    octaves = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    owner = np.repeat(np.arange(len(element)), octaves)
    octave = np.arange(len(owner)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    doc, count = doc[owner], count[owner]
    start = np.where(octave > 0, 2.0 ** (octave - 1), 0.0)
    width = np.where(octave > 0, start, 1.0)
    state = mix(element[owner] ^ mix(octave.astype(np.uint64) + _GOLD))
    until = horizon[todo][doc]
    now = np.zeros(len(owner))
    live, first, chunk = np.arange(len(owner)), 0, 2
    times, places, values = [], [], []
    with np.errstate(over="ignore"):
        while len(live):
            step = (np.arange(first, first + chunk, dtype=np.uint64) * np.uint64(3) + np.uint64(1)) * _GOLD
            base = state[live][:, None]
            wait = mix(base + step)
            wait = -np.log(((wait >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
            t = now[live][:, None] + np.cumsum(wait, axis=1) / (slots * width[live])[:, None]
            row, col = np.nonzero(t <= until[live][:, None])
            process = live[row]
            own = state[process] + step[col]
            place = mix(own + _GOLD)
            where = mix(own + _GOLD + _GOLD)
            at = start[process] + width[process] * ((where >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)
            seen = at < count[process]
            times.append(t[row, col][seen])
            places.append((doc[process] * slots + ((place >> np.uint64(32)) % np.uint64(slots)).astype(np.int64))[seen])
            values.append(mix(place ^ state[process])[seen].astype(np.uint32))
            now[live] = t[:, -1]
            live = live[t[:, -1] <= until[live]]
            first += chunk
            chunk = min(2 * chunk, 512)
    times, places, values = np.concatenate(times), np.concatenate(places), np.concatenate(values)
    order = np.argsort(-times, kind="stable")
    got = np.zeros(len(todo) * slots, dtype=bool)
    got[places] = True
    sig = np.zeros(len(todo) * slots, dtype=np.uint32)
    sig[places[order]] = values[order]   # the earliest is written last
    out[todo] = sig.reshape(len(todo), slots)
    return got.reshape(len(todo), slots).all(axis=1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents x BANDS) bucket names."""
    parts = sig.reshape(len(sig), BANDS, BAND_ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(parts.shape[:2], dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(BAND_ROWS):
            key = mix(key * _GOLD + parts[:, :, i])
    return key.view(np.int64)


def _signed(docs: DataFrame, text_col: str) -> DataFrame:
    """(id, node, bands, sig) of every row; no bands for texts without words."""
    def run(batches):
        shingler = Shingler()
        for batch in slices(batches):
            bags = [shingler.bag(t) for t in batch.column(2).to_pylist()]
            full = [i for i, b in enumerate(bags) if len(b[0])]
            bands, sigs = [None] * len(bags), [None] * len(bags)
            if full:
                got = signatures([bags[i] for i in full])
                for i, keys, sig in zip(full, band_keys(got), got, strict=True):
                    bands[i], sigs[i] = keys, sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["id", "node", "bands", "sig"])

    return docs.select("__id", "__node", text_col).mapInArrow(
        run, "id long, node string, bands array<long>, sig binary")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def _enough() -> int:
    """Slots in which pairs at the similarity agree, less five deviations."""
    s = SIMILARITY[0] / SIMILARITY[1]
    return int(np.floor(SLOTS * s - 5 * np.sqrt(SLOTS * s * (1 - s))))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in enough slots."""
    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    enough = _enough()

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, SLOTS)
                    for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(_agree(a, b) >= enough))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(
        run, "a string, b string")


def _texts_of(names: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """(node, text) of the nodes in ``names``."""
    names = materialize(names.select(F.col("node").alias("__node")).distinct(), "near-needed")
    if names.count() <= BROADCAST_NODES:   # else shuffled, with the same result
        names = F.broadcast(names)
    held = texts.select("__node", F.col(text_col).alias("text")).join(names, "__node", "left_semi")
    return materialize(held.dropDuplicates(["__node"]).withColumnRenamed("__node", "node"), "near-texts")


def _verified(pairs: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """Pairs (a, b) whose texts reach the similarity."""
    pairs = materialize(pairs.distinct(), "near-pairs")
    held = _texts_of(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")), texts, text_col)
    left = held.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = held.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        shingler, last, bag = Shingler(), None, None
        for batch in slices(batches):
            good = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != last:
                    last, bag = b, shingler.bag(b)
                good.append(similarity_reached(shingler.bag(a), bag))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a string, b string")


def _cell_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Verified links of one cell that join components: between its outside
    nodes and any node of another component."""
    out, every = (pdf[pdf["outside"] == side].drop_duplicates("node") for side in (True, False))
    sig, all_sig = (np.frombuffer(b"".join(x["sig"]), dtype=np.uint32).reshape(-1, SLOTS) for x in (out, every))
    name, label, text = (out[c].to_numpy() for c in ("node", "label", "text"))
    all_name, all_label, all_text = (every[c].to_numpy() for c in ("node", "label", "text"))
    key = pdf["first"].iloc[0]
    columns, enough = np.ascontiguousarray(all_sig.T), _enough()
    bags, above = {}, {}

    def bag(node, text):
        if node not in bags:
            bags[node] = _SHINGLER.bag(text)
        return bags[node]

    def top(x):
        while x in above:
            x = above[x]
        return x

    found = []
    for at in range(0, len(name), 64):
        some = sig[at:at + 64]
        agree = np.zeros((len(some), len(all_name)), dtype=np.uint8)
        for slot in range(SLOTS):
            agree += some[:, slot][:, None] == columns[slot][None, :]
        i, j = np.nonzero(agree >= enough)
        across = label[at + i] != all_label[j]
        i, j = i[across], j[across]
        if not pd.isna(key):   # other buckets that the pair shares leave it to its first
            shared = (some[i] == all_sig[j]).reshape(-1, BANDS, BAND_ROWS).all(axis=2).argmax(axis=1)
            here = band_keys(some)[i, shared] == int(key)
            i, j = i[here], j[here]
        for k in np.argsort(-agree[i, j].astype(np.int16), kind="stable").tolist():
            a, b = at + i[k], j[k]
            x, y = top(label[a]), top(all_label[b])
            if x != y and similarity_reached(bag(name[a], text[a]), bag(all_name[b], all_text[b])):
                above[max(x, y)] = min(x, y)
                found.append((max(name[a], all_name[b]), min(name[a], all_name[b])))
    return pd.DataFrame(found, columns=["a", "b"], dtype=str)


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, n, outside, main) of the buckets that hold several components: their
    nodes, those outside the largest component, and its label."""
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    return (sizes.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("top"))
            .filter("n > top.m").select("key", "n", (F.col("n") - F.col("top.m")).alias("outside"),
                                        F.col("top.label").alias("main")))


def _turned(node: Column, turn: int) -> Column:
    """A digest with its first ``8 * turn`` digits behind the others."""
    return F.concat(F.substring(node, 8 * turn + 1, 32 - 8 * turn), F.substring(node, 1, 8 * turn))


def _stars(placed: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of each bucket's nodes with its centre, in large buckets with
    further centres as well."""
    of_bucket = placed.select("key", "node").join(centres, "key")
    chosen = F.when(F.col("n") > LARGE, F.col("centres")).otherwise(F.slice("centres", 1, 1))
    return (of_bucket.select("node", F.explode(F.array_distinct(chosen)).alias("centre")).filter("node <> centre")
            .select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct())


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links: those between the components so far
    make a small graph of labels, whose components rename them."""
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        links = links.join(of, end, "left")
    ends = links.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    renamed = materialize(components(ends), "near-renamed")
    new = renamed.select(F.col("node").alias("label"), F.col("label").alias("now"))
    kept = labels.join(new, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    # nodes that had no component before
    return kept.unionAll(renamed.join(labels, "node", "left_anti").select("node", "label"))


def _left_over(placed: DataFrame, nodes: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """Verified links across the components of a bucket; ``placed``: (key,
    node, label)."""
    cells, rows = [], placed
    for split in range(SPLITS + 1):
        rows = materialize(rows.join(_mixed(rows), "key"), "near-mixed")
        last = split == SPLITS
        many = F.col("outside") > BLOCK
        fit = rows if last else rows.filter(~many)
        blocks, strips = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "outside"))
        mine = F.xxhash64("node")
        every = fit.withColumn("block", F.pmod(mine, blocks)).withColumn(
            "strip", F.explode(F.sequence(F.lit(0), strips - 1))).withColumn("outside", F.lit(False))
        out = fit.filter("label <> main").withColumn("strip", F.pmod(mine, strips).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))).withColumn(
            "outside", F.lit(True))
        name = F.concat_ws(":", F.lit(split), "key", "block", "strip").alias("cell")
        first = (F.col("key") if split == 0 else F.lit(None).cast("long")).alias("first")
        cells += [df.select(name, first, "node", "label", "outside") for df in (every, out)]
        large = rows.filter(many).select("key", "node", "label")
        if last or large.isEmpty():
            break
        # similar nodes share further bands: such buckets fall apart by those
        rows = (large.join(nodes.select("node", F.explode("bands").alias("band")), "node")
                .filter("band <> key").select(F.xxhash64(F.least("key", "band"), F.greatest("key", "band"))
                                              .alias("key"), "node", "label").distinct())
    union = cells[0]
    for more in cells[1:]:
        union = union.unionAll(more)
    union = materialize(union, "near-cells")
    held = nodes.select("node", "sig").join(_texts_of(union, texts, text_col), "node")
    return union.join(held, "node").groupBy("cell").applyInPandas(_cell_links, "a string, b string")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``__class_id`` and ``__kept``; the (id, node) of every row."""
    keyed = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn(
        "__node", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    signed = materialize(_signed(keyed, text_col), "near-signatures")
    nodes = materialize(signed.filter("bands IS NOT NULL").dropDuplicates(["node"]).select("node", "bands", "sig"),
                        "near-nodes")

    bands = nodes.select("node", F.explode("bands").alias("key"))
    turned = [F.min(_turned(F.col("node"), turn)).alias(f"t{turn}") for turn in range(STARS + 1)]
    centres = F.array(*[_turned(F.col(f"t{turn}"), 4 - turn) if turn else F.col("t0") for turn in range(STARS + 1)])
    shared = (bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *turned).filter("n > 1")
              .select("key", "n", centres.alias("centres")))
    shared = materialize(shared, "near-centres")
    placed = materialize(bands.join(shared.select("key"), "key"), "near-buckets")
    links = materialize(_verified(_likely(_stars(placed, shared), nodes), keyed, text_col), "near-links")
    first = materialize(components(links), "near-components")
    labelled = materialize(placed.join(first, "node", "left")
                           .select("key", "node", F.coalesce("label", "node").alias("label")), "near-labelled")
    more = materialize(_left_over(labelled, nodes, keyed, text_col), "near-links")
    joined = first if more.isEmpty() else _joined(first, more)

    # class of a node: its component, or itself; texts without words are one class
    of_node = (signed.groupBy("node").agg(F.min("id").alias("low_id"), F.max(F.col("bands").isNull()).alias("bare"))
               .join(joined, "node", "left")
               .withColumn("class", F.when(F.col("bare"), F.lit("")).otherwise(F.coalesce("label", "node"))))
    of_node = materialize(of_node.select("node", "low_id", "class"), "near-classes")
    # the first member of a class: smallest id (null last), then smallest digest
    rank = F.struct(F.col("low_id").isNull().alias("none"), F.col("low_id").alias("id"), F.col("node").alias("node"))
    heads = of_node.groupBy("class").agg(F.min(rank).alias("head"))
    named = (of_node.join(heads, "class")
             .select(F.col("node").alias("__of"), F.col("head.id").alias("__class_id"),
                     F.col("head.node").alias("__head")))
    named = materialize(named, "near-named")
    out = keyed.join(named, F.col("__node") == F.col("__of"))
    kept = (F.col("__node") == F.col("__head")) & F.col("__id").eqNullSafe(F.col("__class_id"))
    return out.withColumn("__kept", kept), signed.select("id", "node")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``class_id`` and ``kept`` (the first row of each class)."""
    out, _ = _classified(docs, id_col, text_col)
    new = {"class_id": F.col("__class_id"), "kept": F.col("__kept")}
    columns = [F.col(c) for c in docs.columns if c.lower() not in new]
    return out.select(*columns, *[v.alias(n) for n, v in new.items()])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the columns of ``docs``."""
    out, rows = _classified(docs, id_col, text_col)
    out = out.filter("__kept")
    again = rows.groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not again.isEmpty():   # rows that repeat id and text are kept alike
        out = out.dropDuplicates(["__id", "__node"])
    return out.select(*docs.columns)
