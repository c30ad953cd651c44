"""Spelling variants: words one edit apart, met through two rare disjoint bigrams of the one among the first of the other.

Bigrams are put in one order for all words, rarest first. Of a word's bigrams the three first, and all that tie with the
third, are its prefix; two that don't overlap are its pivots. One edit leaves all letters up to the left pivot's end, or all
from the right pivot's start. Of two near words take the one whose prefix ends earlier in the order: its pivot on that side
stands in the other word at the same distance from that side's end, and not beyond the end of the other's prefix. So
pivots are looked up among prefixes by bigram, distance and the letters next to it, and every pair found is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm.stored import prepare, stored
from stratiform.llm.words import batches_of

#: After lower-casing A-Z. 90 letters, so there are 8,100 bigrams at most.
LETTERS = "[a-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, LEADS = 5, 3, 2
#: One occurrence in so many loses a letter, by a hash.
EVERY = 97
#: Words that a task counts before it passes the counts on.
TOGETHER = 1 << 18
PREFIX = 3
#: Letters beside a bigram that are part of its key, and by what part a letter more is taken to shorten the key's list.
BESIDE, RARER = 6, 0.3


def _emit(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
    )


def _count(every: int | None):
    """Occurrences of words by bounded groups of a task."""
    run = re.compile(LETTERS + f"{{{LEAST_LENGTH},}}")

    def count(batches):
        held: Counter = Counter()
        for batch in batches_of(batches):
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                found = Counter(run.findall(text.encode().lower().decode()))
                if every:
                    begun = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for word in list(found):
                        h = zlib.crc32(word.encode(), begun)
                        if h % every == 0:
                            at, n = h % len(word), found.pop(word)
                            if len(word) > LEAST_LENGTH:
                                held[word[:at] + word[at + 1 :]] += n
                held.update(found)
                if len(held) > TOGETHER:
                    yield _emit(held)
                    held = Counter()
        if held:
            yield _emit(held)

    return count


def frequent_words(docs: DataFrame, every: int | None = EVERY) -> DataFrame:
    """``word, n``: words of at least five letters that occur at least three times in all texts.

    A word is a run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased. With ``every``, an occurrence whose
    crc32 of ``<doc_id>:<word>`` that number divides loses the letter at crc32 % length; a null id counts as no text.
    """
    prepare(docs.sparkSession)
    counts = docs.select("doc_id", "text").mapInArrow(_count(every), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def pivots_of(places: list[int], left: list[float], right: list[float]) -> tuple[int, int]:
    """The two places, at least two apart, whose costs as left and as right pivot are least together; places ascend.

    Dynamic programming over the places: of those that leave room the cheapest left pivot is kept for the next right one.
    """
    best, room, behind = None, None, 0
    for place, cost in zip(places, right):
        while places[behind] <= place - 2:
            room = (left[behind], places[behind]) if room is None else min(room, (left[behind], places[behind]))
            behind += 1
        if room is not None and (best is None or room[0] + cost < best[0]):
            best = (room[0] + cost, room[1], place)
    return best[1], best[2]


GRAMS = "word string, n long, letters long, pairs long, size int, pivot boolean, key string, place int, ends int"


def _bits(values) -> int:
    """A signed 64-bit mask of numbers."""
    mask = 0
    for value in values:
        mask |= 1 << (value & 63)
    return mask - (1 << 64) if mask >> 63 else mask


def _grams(order):
    """Two rows for each prefix bigram of every word, by its distance from either end; a pivot is marked on its side."""

    def emit(batches):
        rank, number = order.value
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                size = len(word)
                ranks = [rank[word[i : i + 2]] for i in range(size - 1)]
                ends = sorted(ranks)[PREFIX - 1]
                places = [i for i, r in enumerate(ranks) if r <= ends]
                costs = [number[ranks[i]] for i in places]
                left = [c * RARER ** min(i, BESIDE) for c, i in zip(costs, places)]
                right = [c * RARER ** min(size - 2 - i, BESIDE) for c, i in zip(costs, places)]
                pivots = pivots_of(places, left, right)
                letters, pairs = _bits(map(ord, word)), _bits(ranks)
                for i in places:
                    keys = ((word[max(0, i - BESIDE) : i + 2], i + 1, pivots[0]), (word[i : i + 2 + BESIDE], i - size, pivots[1]))
                    for key, place, pivot in keys:
                        for held, value in zip(out, (word, n, letters, pairs, size, i == pivot, key, place, ends)):
                            held.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32())
            names = [c.split()[0] for c in GRAMS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return emit


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, n, near_n``: every pair of words (of four letters or more) one inserted, deleted or replaced letter apart, both ways round.

    ``words`` has distinct ``word`` and ``n``. Letters may be any characters; the table of bigrams that all tasks get is
    bounded by the square of the alphabet, 8,100 rows for the words of ``frequent_words``.
    """
    spark = words.sparkSession
    prepare(spark)
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substr(F.col("word"), i, F.lit(2)))).alias("gram"))
    grams = grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").toArrow()
    rank = {gram: i for i, gram in enumerate(grams.column("gram").to_pylist())}
    order = spark.sparkContext.broadcast((rank, grams.column("n").to_pylist()))
    rows = stored(words.select("word", "n").mapInArrow(_grams(order), GRAMS), "grams")
    own = rows.where("pivot").select(
        "key",
        "place",
        F.explode(F.array(*(F.col("size") + longer for longer in (-1, 0, 1)))).alias("size"),
        *(F.col(c).alias(f"own_{c}") for c in ("word", "n", "letters", "pairs", "ends")),
    )
    other = rows.select("key", "place", "size", "word", "n", "letters", "pairs", "ends")
    # One edit changes at most two of the letters there are, and four of the bigrams.
    differing = lambda mask: F.bit_count(F.col(f"own_{mask}").bitwiseXOR(F.col(mask)))
    met = own.join(other, ["key", "place", "size"]).where(
        (F.col("own_ends") <= F.col("ends"))
        & (differing("letters") <= 2)
        & (differing("pairs") <= 4)
        & (F.col("own_word") != F.col("word"))
        & (F.levenshtein("own_word", "word", 1) == 1)
    )
    sides = F.array(
        F.struct(F.col("own_word").alias("word"), F.col("word").alias("near"), F.col("own_n").alias("n"), F.col("n").alias("near_n")),
        F.struct(F.col("word").alias("word"), F.col("own_word").alias("near"), F.col("n").alias("n"), F.col("own_n").alias("near_n")),
    )
    return met.select(F.inline(sides)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain of forms, found by doubling the steps; counts double along a chain, so it is short."""
    hops, open_ = stored(forms.select("word", F.col("form").alias("at")), "hops"), True
    while open_:
        further = hops.select(F.col("word").alias("at"), F.col("at").alias("next"))
        hops = hops.select("word", "at").join(further.hint("merge"), "at", "left")
        hops = stored(hops.select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")), "hops")
        open_ = not hops.where("moved").isEmpty()
        hops = hops.select("word", "at")
    return hops.withColumnRenamed("at", "root")


def group_variants(docs: DataFrame, every: int | None = EVERY) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word of ``docs`` (``doc_id``, ``text``).

    ``form`` is the near word that occurs most often (ties: the smallest), if it occurs at least twice as often; ``root``
    the end of the chain of forms, or the word. Null and empty texts hold no words; a document given twice counts twice;
    other columns are not read; an empty table gives an empty one. A text is held whole by its task.
    """
    words = stored(frequent_words(docs, every), "words")
    pairs = stored(near_words(words), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("rest"), F.col("near").alias("near")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best.alias("best"))
    fits = -F.col("best.rest") >= LEADS * F.col("n")
    near = stored(
        near.select(
            "word",
            "n_near",
            F.when(fits, F.col("best.near")).alias("form"),
            F.when(fits, -F.col("best.rest")).alias("form_n"),
        ),
        "forms",
    )
    out = words.join(near.join(_roots(near.where("form is not null")), "word", "left"), "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
