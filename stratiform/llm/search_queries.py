"""Queries of the operators that group spellings, find periodic runs and search vectors approximately."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.llm import ann, runs, spelling
from stratiform.llm.registry import query, table
from stratiform.llm.words import words


@query("op11_spelling_variants")
def op11_spelling_variants(spark, folder):
    """Form, root and near words of every word of at least five letters and three occurrences."""
    return spelling.group_variants(table(spark, folder, "documents"))


def _with_loops(docs):
    """Documents of which a tenth, by a hash, repeat a stretch of their words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, n, g = F.col("w"), F.size("w"), F.floor(h / 10)
    start = F.pmod(g, n)
    period = 1 + F.floor((n - start) / (3 + g % 8))
    place = lambda i: F.when(i < start, i).otherwise(start + F.pmod(i - start, period)).cast("int")
    looped = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.when(F.size("w") > 0, looped).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, folder):
    """Runs of every document, the one of the greatest exponent, and digests of all runs and of the words without repeats."""
    docs = _with_loops(table(spark, folder, "documents").select("doc_id", "text"))
    out = runs.find_runs(docs)
    # Of two exponents the greater one, in whole numbers.
    more = lambda a, b: (a["length"] * b["period"]) > (b["length"] * a["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda held, run: F.when(more(run, held), run).otherwise(held))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    text = F.concat(F.lit(""), F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), text.alias("listed"), "collapsed")
    return out.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_nearest_neighbours")
def op13_nearest_neighbours(spark, folder):
    """The five largest cosines found for every query, a row whose id is divisible by 50."""
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)
