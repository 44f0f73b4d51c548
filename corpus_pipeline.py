"""The corpus pipeline: documents in, encoded training rows out.

Each stage takes every row that the stage before it kept; all but the last
return the columns of ``documents``.  A toxic document is dropped, repeated
line windows are cut out of the texts, one document of each near-duplicate
class stays, sources are mixed to their targets (a document taken twice is
two rows), and every text is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sieveworks.llm import bpe, lines, mixing, near_dup, toxicity
from sieveworks.llm.queries import TOKENIZER, table
from sieveworks.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half; the score is
    learned from all rows of ``labels``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.score(docs, labels, names=("__score", "__toxic"))
    return scored.filter("__toxic = 0").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of three-line windows.  A text may
    become empty; its row stays."""
    return lines.remove_repeated_windows(docs, counts=False)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return near_dup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it."""
    return mixing.mixed_rows(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of every whole text, as ``token_ids``."""
    ranks = bpe.share_ranks(spark, public_tokenizers.path(TOKENIZER))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, ids_col="token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("MinHash near-dedup", keep_one_near_duplicate),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_texts),
]

#: Learned and hashed stages have no SQL form; tests compare each stage with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
