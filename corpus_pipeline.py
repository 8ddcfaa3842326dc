"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and rereads as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import op02_near, op03_lines, op05_chunks, op09_contain, op10_pieces
from attestor.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    return op03_lines.keep_good(docs, op03_lines.train(spark, docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks and passages that occur before; documents of which nothing is left go."""
    return op05_chunks.dedup(docs, fine=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (similarity 0.80 or more)."""
    return op02_near.keep_one(docs, bands=op02_near.WIDE_BANDS, link=op02_near.WIDE_LINK)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op09_contain.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return op10_pieces.round_trip(docs, op10_pieces.default_model())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

ORACLE_SQL = None  # line labels and rolling hashes are not SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
