"""One query per operator of this subpackage over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chunks, lines, merkle, mixing, near_dup, packing, quality, repair, substrings, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


@_query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again; digests of both."""
    ranks = bpe.share_ranks(spark, public_tokenizers.path(TOKENIZER))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    decoded = bpe.decode(coded, ranks)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@_query("op2_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10""")
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth vector's 10 largest integer inner products."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", k=10)


@_query("op10_graph_neighbours")
def op10_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fiftieth vector's 5 nearest by cosine, from the graph index."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding", k=5)


@_query("op3_line_windows", """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
i AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d),
w AS (SELECT doc_id, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c FROM i),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM w
      WHERE NOT (trim(a) = '' AND trim(b) = '' AND trim(c) = '')),
g AS (SELECT doc_id, list(DISTINCT pos + k) AS gone FROM r, (VALUES (0), (1), (2)) v(k) WHERE nth > 1 GROUP BY doc_id),
k AS (SELECT doc_id, text, len(lines) AS n_lines, gone,
        list_transform(list_filter(range(0, len(lines)), lambda x: NOT list_contains(gone, x)), lambda x: lines[x + 1]) AS kept
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  coalesce(n_lines, 0)::BIGINT AS n_lines,
  CASE WHEN gone IS NULL THEN 0 ELSE n_lines - len(kept) END::BIGINT AS n_removed FROM k""")
def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.remove_repeated_windows(docs)


@_query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; labels of one fold in five are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    scored = toxicity.score(docs, labels, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@_query("op6_source_mix", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[^\p{L}\p{N}\x20\x09-\x0D]')) AS marks,
    md5(concat('11:', coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))) AS tie FROM documents),
k AS (SELECT *, -ln((('0x' || tie[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
                / (greatest(size, 1) / (greatest(size, 1) + marks + 1.0)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
      FROM k GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS cap, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight,
        1.5 * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, total - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
      FROM w WINDOW f AS (ORDER BY cap / weight, place)),
l AS (SELECT rest, heavy FROM o WHERE NOT rest::DOUBLE * weight / heavy > cap ORDER BY cap / weight, place LIMIT 1),
t AS (SELECT w.source, source_size, least(l.rest::DOUBLE * weight / l.heavy, cap)::DOUBLE AS target FROM w, l),
p AS (SELECT doc_id, size, source_size, target,
        CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
        sum(size) OVER (PARTITION BY k.source ORDER BY key, tie) - size / 2.0 AS middle
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs + CASE WHEN middle <= target - epochs * source_size AND target - epochs * source_size > 0
            THEN 1 ELSE 0 END)::INT AS copies, (size * copies)::BIGINT AS taken FROM p""")
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, columns=["doc_id"])


@_query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document and the row each class keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.classes(docs).select("doc_id", "class_id", "kept")


@_query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; labels of one fold in four are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out)
    scored = quality.score(docs, labels, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@_query("op5_content_chunks")
def op5_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated chunks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.remove_repeated_chunks(docs, whole_documents=True)


@_query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated 400-byte strings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substrings.remove_repeated_substrings(docs, keep=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _h(*parts: str) -> str:
    """SQL of a leaf digest."""
    each = [f"coalesce(octet_length(encode({p}::VARCHAR))::VARCHAR || ':' || {p}::VARCHAR, '-')" for p in parts]
    return f"sha256({' || '.join(each)})"


def _tree(name: str, leaves: str) -> str:
    """SQL of all nodes (grp, level, rank, h, n) over ``leaves``."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, rank, h, n FROM {leaves}
  UNION ALL
  SELECT grp, level + 1, rank // 2, sha256(string_agg(h, '' ORDER BY rank)), any_value((n + 1) // 2)
  FROM {name} WHERE n > 1 GROUP BY grp, level, rank // 2)"""


def _walk(name: str, start: str, nodes: str) -> str:
    """SQL of the walk from each row of ``start`` (id, grp, rank, h, proof) to
    the top of its tree; the last row of an id has n = 1."""
    return f"""{name} AS (
  SELECT s.id, s.grp, 0 AS level, s.rank, s.h, s.proof, t.n FROM {start} s
  JOIN {nodes} t ON t.grp IS NOT DISTINCT FROM s.grp AND t.level = 0 AND t.rank = s.rank
  UNION ALL
  SELECT w.id, w.grp, w.level + 1, w.rank // 2,
    sha256(CASE WHEN w.rank % 2 = 1 THEN b.h || w.h ELSE w.h || coalesce(b.h, '') END),
    w.proof || coalesce(b.h, ''), (w.n + 1) // 2
  FROM {name} w LEFT JOIN {nodes} b ON b.grp IS NOT DISTINCT FROM w.grp AND b.level = w.level
    AND b.rank = xor(w.rank, 1) WHERE w.n > 1)"""


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@_query("op11_merkle_manifest", f"""
WITH RECURSIVE docs AS (SELECT *, {_crc32('doc_id::VARCHAR')} % 7 = 0 AS hit FROM documents),
leaves AS (
  SELECT row_number() OVER () AS id, doc_id, lang AS grp, {_h('doc_id', 'source', 'lang', 'n_chars', 'text')} AS h,
    {_h('doc_id', 'source', 'lang', '(CASE WHEN hit THEN n_chars::HUGEINT + 1 ELSE n_chars END)', 'text')} AS seen
  FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS rank,
             count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_tree('low', 'placed')},
subs AS (SELECT NULL::INT AS grp, grp AS lang, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS rank,
           count(*) OVER () AS n FROM low WHERE n = 1),
{_tree('high', 'subs')},
below AS (SELECT id, grp, rank, seen AS h, '' AS proof FROM placed),
{_walk('up', 'below', 'low')},
above AS (SELECT u.id, NULL::INT AS grp, s.rank, u.h, u.proof FROM up u JOIN subs s ON s.lang IS NOT DISTINCT FROM u.grp
          WHERE u.n = 1),
{_walk('over', 'above', 'high')}
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root,
  o.h = r.h AS verified
FROM placed p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.grp JOIN over o ON o.id = p.id AND o.n = 1
JOIN high r ON r.n = 1""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; rows whose id's CRC-32 is a
    multiple of 7 are verified with one character too many."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
                            tampered={"n_chars": F.when(hit, n_chars + 1).otherwise(n_chars)})
    return found.withColumn("proof", merkle.proof_digest(F.col("proof"))).withColumnRenamed("proof", "proof_sha256")


@_query("op12_bfd_packing")
def op12_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens; a digest of
    the ids of every piece."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = packing.share_tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, tokenizer, keep=["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@_query("op13_conversation_repair", rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations),
rows AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, range(CASE WHEN fault = 3 THEN 2 ELSE 1 END) WHERE fault <> 0),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM rows),
kinds AS (
  SELECT conv_id, turn, role, text, substring(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'B' WHEN nth > 1 THEN 'D'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'T' ELSE '' END AS kind FROM nth),
ins(state, more, spot, cost, lines) AS (VALUES
  ('-', '', '-', 0, []), ('-', 'I', 'u', 5, ['user:']), ('-', 'II', 'a', 10, ['user:', 'assistant:']),
  ('s', '', 's', 0, []), ('s', 'I', 'u', 5, ['user:']), ('s', 'II', 'a', 10, ['user:', 'assistant:']),
  ('u', '', 'u', 0, []), ('u', 'I', 'a', 5, ['assistant:']), ('a', '', 'a', 0, []), ('a', 'I', 'u', 5, ['user:'])),
edits(spot, edit, initial, new, cost, role) AS (VALUES
  ('-', 'D', NULL, '-', 2, NULL), ('s', 'D', NULL, 's', 2, NULL), ('u', 'D', NULL, 'u', 2, NULL),
  ('a', 'D', NULL, 'a', 2, NULL), ('-', 'K', 's', 's', 0, NULL), ('-', 'K', 'u', 'u', 0, NULL),
  ('s', 'K', 'u', 'u', 0, NULL), ('a', 'K', 'u', 'u', 0, NULL), ('u', 'K', 'a', 'a', 0, NULL),
  ('-', 'R', NULL, 'u', 1, 'user'), ('s', 'R', NULL, 'u', 1, 'user'), ('a', 'R', NULL, 'u', 1, 'user'),
  ('u', 'R', NULL, 'a', 1, 'assistant')),
moves AS (SELECT i.state, e.new, i.more || e.edit AS audit, i.lines, i.cost + e.cost AS cost, e.edit, e.initial, e.role
          FROM ins i JOIN edits e ON e.spot = i.spot),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, '-' AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best
  FROM raw GROUP BY conv_id
  UNION ALL
  SELECT d.conv_id, d.i + 1, m.new, min({{
      'cost': (d.best.cost + m.cost + CASE WHEN k.kind = 'T' AND m.edit <> 'D' THEN 5 ELSE 0 END)::BIGINT,
      'audit': d.best.audit || m.audit,
      'lines': list_concat(list_concat(d.best.lines, m.lines),
                           CASE WHEN m.edit = 'D' THEN [] ELSE [coalesce(m.role, k.role) || ':' || k.text] END)}})
  FROM dp d JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM d.conv_id AND k.i = d.i + 1
  JOIN moves m ON m.state = d.state AND (m.edit = 'D' OR k.kind IN ('', 'T'))
    AND (m.initial IS NULL OR m.initial = k.initial)
  GROUP BY d.conv_id, d.i, m.new),
ends AS (
  SELECT d.conv_id, min({{'cost': d.best.cost + i.cost, 'audit': d.best.audit || i.more,
                          'lines': list_concat(d.best.lines, i.lines)}}) AS best
  FROM dp d JOIN ins i ON i.state = d.state AND (i.spot = 'a' OR (i.spot = '-' AND i.more = ''))
  WHERE d.i = (SELECT count(*) FROM kinds k WHERE k.conv_id IS NOT DISTINCT FROM d.conv_id) GROUP BY d.conv_id),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM kinds),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (kind = 'B') AS blank,
    count(*) FILTER (kind = 'D') AS duplicate, count(*) FILTER (kind = 'T') AS truncated,
    count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.best.cost::BIGINT AS cost, e.best.audit AS audit,
  sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations: their faults, the cheapest repair and its digest."""
    return repair.summary(repair.damaged(table(spark, sf_dir, "conversations")))
