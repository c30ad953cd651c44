"""Mixing sources to target weights: floor(rate) copies of a document, and one more with the rate's fraction as chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm.words import n_words
from stratiform.session import checkpointed

WEIGHTS = (5, 2, 1)
BITS = 13


def draw(key: Column, seed: str) -> Column:
    """A number from 0 up to 1 that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS), 16, 10).cast("double") / float(16**BITS)


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Each source with its words and its rank by code point, null last.

    Sources are sorted over many tasks; a rank is the place in the task plus the sources in the tasks before.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    ordered = checkpointed(ordered)
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))


    # One row for each task of the sort.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    ranked = ordered.withColumn("_place", place).join(F.broadcast(counts), "_part")
    return ranked.select("source", "source_size", (F.col("_place") + F.col("_before") - 1).alias("rank"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to every source: its share by weight, none above ``most`` times its size.

    What is over the limit goes to the others by weight, round after round, until none is above. Each round asks for
    two sums; the sources themselves stay where they are.
    """
    ranked = ranked_sources(sizes)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(
        ranked.withColumns({"weight": weight.cast("double"), "limit": F.col("source_size").cast("double") * most})
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = capped = None
    while True:
        over = F.lit(False) if level is None else F.col("limit") < F.col("weight") * F.lit(level[0]) / F.lit(level[1])
        held, rest, n = ranked.agg(
            F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight"))), F.sum(over.cast("long"))
        ).first()
        if n == capped or not rest:
            break
        level, capped = (share * total - (held or 0.0), rest), n
    top, rest = level or (0.0, 1.0)
    target = F.least("limit", F.col("weight") * F.lit(top) / F.lit(rest))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to every document.

    The rate of a source is its target over its words. A document is taken floor(rate) times, and once more when its
    draw is below the fraction, so repeated rows and reruns agree. Null text counts as empty, null is a source of its
    own (the last), and a source or corpus without words has target 0. Columns named like the new ones are replaced, all
    others come back as they were, whatever their names: they travel as one column.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sizes = checkpointed(docs.select("source", n_words(F.col("text")).alias("size")))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    out = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    out = out.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    return _with_copies(out, seed).select("row.*", "size", "source_size", "target", "copies", "taken")


def _with_copies(out: DataFrame, seed: str) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    out = out.withColumn("copies", (F.floor(rate) + extra).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_table(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The same figures per document without its text: words are counted once."""
    sizes = checkpointed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    out = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    out = _with_copies(out, seed)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Every document as often as it is taken."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixed.where("copies > 0").select(F.struct("*").alias("row"), times).select("row.*")
