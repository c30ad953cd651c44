"""Queries of the operators that search vectors, tag toxic words and encode pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.llm import bloom_lm, pieces, topk, toxic_spans
from stratiform.llm.registry import query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

TOPK_SQL = """
WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


@query("op1_topk_search", TOPK_SQL)
def op1_topk_search(spark, folder):
    """The ten highest products of every query, a row whose id is divisible by 100."""
    return topk.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def _fold(column):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


@query("op6_toxicity")
def op6_toxicity(spark, folder):
    """Score, verdict and toxic spans of every document; a fifth of the labels is held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    texts, toxic, share = toxic_spans.training_rows(docs, labels, _fold("doc_id") != 0)
    model = toxic_spans.fit(texts, toxic, share)
    out = toxic_spans.tag_toxic(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted", "spans")


@query("op10_sentencepiece")
def op10_sentencepiece(spark, folder):
    """Ids of every document, their number, and whether decoding them gives the same text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = pieces.decode_pieces(pieces.encode_pieces(docs, MODEL), MODEL)
    n_pieces = F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(0)).cast("long")
    same = F.col("decoded").eqNullSafe(F.col("text"))
    return out.select(
        "doc_id", n_pieces.alias("n_pieces"), same.alias("lossless"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids"
    )


@query("op2_lm_scoring")
def op2_lm_scoring(spark, folder):
    """Unigram and model scores of every document; a seventh is held out of training."""
    docs = table(spark, folder, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = bloom_lm.score_texts(docs, fold)
    held_out = F.coalesce(fold, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
