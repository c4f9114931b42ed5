"""Documents to training sequences: quality, near duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and gives what the next one reads; all but the last give the
columns of ``documents``, with ``n_chars`` following the text. Nulls, empty texts and repeated rows are
treated as the operators in ``reelgrid.llm`` define them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import neardup, packing, pii, quality, substrings
from reelgrid.llm.common import stored, table, without


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    found = neardup.near_duplicates(docs, neardup.Similarity(shingle=5, percent=80))
    return without(docs, "doc_id", stored(found.filter("NOT kept").select("doc_id").distinct(), "dropped"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document or earlier in their own."""
    return substrings.without_repeats(docs, count_col="n_chars")


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.masked(docs, count_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", one_of_near),
    ("substring dedup", cut_repeats),
    ("personal data", mask_private),
    ("best-fit packing", pack),
]

# No stage is a SQL query: models are fitted, hashes sampled and tokens merged.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
