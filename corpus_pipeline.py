"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), with docs the rows its predecessor kept, and returns a frame; ``run`` writes
each stage's frame as Parquet in the shared folder and reads it again as the next one's docs.  All stages but the last
return the columns of documents.

Defined results, for every stage: an empty table stays empty; null texts count as empty; more columns are passed on
by the filtering stages; what each operator does with nulls, ties and repeated rows is in its module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import packing, passages, quality, simhash, toxicity
from millrace.llm.common import table
from millrace.llm.queries import vocabulary
from millrace.plans.staging import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    return quality.clean(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays."""
    return simhash.one_of_each(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id holds are cut out."""
    return passages.without_repeats(docs, "suffix")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences of 4096 tokens."""
    packed = packing.packed_documents(docs, vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("packing", packing_stage),
]

#: The fitted and hashed stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
