"""Queries of the operators that compare documents with each other."""

from __future__ import annotations

from importlib import import_module

from stratiform.llm import ngram_join, suffix_dedup
from stratiform.llm.registry import query, table


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark, folder):
    """Set size and component of every document, by five-word shingles and a similarity of 0.8."""
    return ngram_join.link_documents(table(spark, folder, "documents"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, folder):
    """What is left of every document without the 50-byte strings that a document with a smaller id has."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("pipeline")
def pipeline(spark, folder):
    """The stages of the corpus pipeline, one after the other."""
    return import_module("corpus_pipeline").run(spark, folder)
