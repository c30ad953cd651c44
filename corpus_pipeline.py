"""A corpus from raw documents: quality rules, near duplicates, repeated passages, mixing, pieces.

Each stage takes the documents that the one before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.llm import mixing, ngram_join, pieces, quality_rules, suffix_dedup
from stratiform.llm.stored import write_texts
from stratiform.session import new_folder

MODEL = os.environ.get("STRATIFORM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")

#: The model's fits, links and pieces have no form in SQL. A test holds every stage, row by row, against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie far from the others of their language and source."""
    return quality_rules.judge_quality(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by shingles."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-byte strings that a document with a smaller id has; ``n_chars`` follows, and no document is dropped."""
    out = suffix_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    return mixing.emit_copies(mixing.mix_sources(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and whether they decode to the text."""
    out = pieces.decode_pieces(pieces.encode_pieces(docs.select("doc_id", "source", "text"), MODEL), MODEL)
    n_pieces = F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(0)).cast("long")
    lossless = F.col("decoded").eqNullSafe(F.col("text"))
    return out.select("doc_id", "source", n_pieces.alias("n_pieces"), lossless.alias("lossless"), "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        folder = new_folder(spark, f"stage{i + 1}")
        write_texts(stage(spark, docs, sf_dir), folder)
        docs = spark.read.parquet(folder)
    return docs
