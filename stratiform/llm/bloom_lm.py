"""Language-model scoring from a log-frequency Bloom filter of quantised n-gram counts.

The filter grows with the training tokens and is never in one place: its segments are made bucket by bucket, and the task
that fills a segment answers all groups of documents that ask for its n-grams.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm.packed import bits_for, by_bucket, cut_by_bucket, pack, unpack
from stratiform.llm.stored import prepare, stored
from stratiform.llm.words import batches_of, grams, mixed, word_hashes

ORDER = 2
#: Size of the filter: so many bits a training token and order, and its least size.
BITS_PER_TOKEN, MIN_BITS = 12, 1 << 16
#: Bytes of text of a group of documents that asks together, and of a token, about.
GROUP_BYTES, TOKEN_BYTES = 4 << 20, 6
#: Counts are quantised to powers of this base; words with exact counts on each worker.
BASE, HEAD = 1.5, 1 << 19
#: The lower order weighs as much as so many occurrences of the context, plus this multiple of the context's count.
PRIOR, SPREAD = 20.0, 2.0
#: Bytes of an n-gram's key that travel besides its bucket, and n-grams in a bucket.
WIDTH, PER_BUCKET = 6, 1 << 20
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens (words, then one end a row) and where each row's tokens start."""
    keys, first = word_hashes(column)
    rows = len(first) - 1
    first_token = first + np.arange(rows + 1)
    out = np.empty(len(keys) + rows, dtype=np.uint64)
    out[first_token[1:] - 1] = END
    word = np.ones(len(out), dtype=bool)
    word[first_token[1:] - 1] = False
    out[word] = keys
    return out, first_token


def ngram_keys(keys: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Key of the n-gram that ends at each token; before a row's first token stand start marks."""
    if n == 1:
        return mixed(keys ^ np.uint64(1))
    rows = len(first) - 1
    padded = np.full(len(keys) + rows * (n - 1), START, dtype=np.uint64)
    row = np.repeat(np.arange(1, rows + 1), np.diff(first))
    at = np.arange(len(keys)) + row * (n - 1)
    padded[at] = keys
    return grams(padded, n)[at - (n - 1)] ^ np.uint64(n)


def level_of(count: np.ndarray) -> np.ndarray:
    """Quantised count: 1 plus the whole part of its logarithm; never above the count itself."""
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def count_at(level: np.ndarray) -> np.ndarray:
    """The middle of the counts with that level, 0 for level 0."""
    low, high = np.ceil(BASE ** (level - 1.0) - 1e-9), np.ceil(BASE ** level.astype(float) - 1e-9) - 1
    return np.where(level > 0, (low + np.maximum(low, high)) / 2, 0.0)


def filter_shape(tokens: int, order: int, read: int = 0, bits_per_token: int = BITS_PER_TOKEN):
    """Bits of the filter, probes of a key, and bits of a bucket number.

    ``read`` is the number of all tokens, held out or not. Buckets grow in number with the n-grams that are entered or asked
    for, so that a segment and what a task holds stay small.
    """
    entries = max(1, tokens * order)
    bits = bits_for(max(entries, read * order), PER_BUCKET)
    size = 1 << int(np.ceil(np.log2(max(MIN_BITS, 1 << (bits + 10), entries * bits_per_token))))
    probes = int(min(8, max(1, round(math.log(2) * size / entries))))
    return size, probes, bits


def _places(keys: np.ndarray, level: int, probes: int, segment: int) -> list[np.ndarray]:
    h = mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(j) * step) & np.uint64(segment - 1)).astype(np.int64) for j in range(probes)]


def shortened(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of a key that travels: its bucket's bits and the next ``WIDTH`` bytes."""
    return keys >> np.uint64(64 - bits - 8 * WIDTH)


def build_segment(keys: np.ndarray, counts: np.ndarray, segment: int, probes: int) -> np.ndarray:
    """Bit table of one bucket: a key of level q is entered with each of the numbers 1 to q."""
    table = np.zeros(segment, dtype=bool)
    levels = level_of(counts)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(keys[levels >= level], level, probes, segment):
            table[place] = True
    return np.packbits(table, bitorder="little")


def probe(table: np.ndarray, keys: np.ndarray, probes: int) -> np.ndarray:
    """Level of each key of a bucket, as they travel: it is asked for with 1, 2, and so on until the first miss."""
    segment = len(table) * 8
    level = np.zeros(len(keys), dtype=np.int64)
    open_ = np.arange(len(keys))
    asked = 1
    while len(open_) and asked < 200:
        hit = np.ones(len(open_), dtype=bool)
        for at in _places(keys[open_], asked, probes, segment):
            hit &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        open_ = open_[hit]
        level[open_] = asked
        asked += 1
    return level


def asked_ngrams(keys: np.ndarray, first: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all orders as they travel, in order, and the place of every token's among them, a row an order."""
    every = np.concatenate([ngram_keys(keys, first, n) for n in range(1, order + 1)])
    asked, place = np.unique(shortened(every, bits), return_inverse=True)
    return asked, place.reshape(order, -1)


class Model:
    """What a worker needs besides the filter's answers: exact counts of the most frequent words, and the corpus totals."""

    def __init__(self, size, bits, probes, head, head_counts, tokens, distinct, order=ORDER, prior=PRIOR):
        self.size, self.bits, self.probes, self.order, self.prior = size, bits, probes, order, prior
        self.head, self.head_counts, self.tokens, self.distinct = head, head_counts, tokens, distinct
        # No other word is more frequent than those at hand (the end mark is there anyhow), and none is when all are.
        words = head_counts[head != END]
        self.most = 0 if distinct <= len(head) else int(words.min()) if len(words) else tokens

    def exact(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of tokens among the frequent ones, and which tokens those are."""
        if not len(self.head):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.head, keys), len(self.head) - 1)
        found = self.head[at] == keys
        return np.where(found, self.head_counts[at], 0), found

    def logs(self, keys: np.ndarray, first: np.ndarray, exact: np.ndarray, found: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """log10 probability of each token, each order mixed with the one below by its context's count.

        ``levels`` has what the filter says of the n-gram that ends at each token, a row an order.
        """
        single = np.where(found, exact, np.minimum(count_at(levels[0]), self.most))
        chance = (single + 1.0) / (self.tokens + self.distinct + 1.0)
        starts = np.zeros(len(keys), dtype=bool)
        starts[first[:-1][first[:-1] < len(keys)]] = True
        rows = float(self.head_counts[np.searchsorted(self.head, END)]) if contains_one(self.head, END) else 0.0
        seen = np.concatenate([[rows], single[:-1]]) if len(single) else single
        seen[starts] = rows
        below = single
        for n in range(2, self.order + 1):
            # An n-gram is at most as frequent as the shorter ones in it.
            limit = np.minimum(seen, below)
            held = np.minimum(count_at(levels[n - 1]), limit)
            weight = self.prior + SPREAD * seen
            chance = (held + weight * chance) / (seen + weight)
            below = held
            if n < self.order:
                before = np.concatenate([[0.0], held[:-1]]) if len(held) else held
                before[starts] = rows
                seen = before
        return np.log10(chance)


def contains_one(table: np.ndarray, key: np.uint64) -> bool:
    at = int(np.searchsorted(table, key))
    return at < len(table) and table[at] == key


def _count_tokens(text: str):
    """Counts of the distinct tokens of each batch."""

    def count(batches):
        for batch in batches_of(batches):
            keys, _ = sequences(batch.column(text))
            keys, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["token", "n"])

    return count


def _ask(order: int, bits: int):
    """n-grams of a group of rows, one row a bucket; with their counts where the group is for training."""

    def ask(rows: pa.Table) -> pa.Table:
        home, held_out = rows.column("bucket")[0], rows.column("held_out")[0].as_py()
        keys, first = sequences(rows.column("text").combine_chunks())
        asked, place = asked_ngrams(keys, first, order, bits)
        counts = np.bincount(place.reshape(-1), minlength=len(asked))
        cuts = cut_by_bucket(asked << np.uint64(64 - bits - 8 * WIDTH), bits)
        slices = [(b, slice(i, j)) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in slices], pa.int32()),
                "home": pa.array([home.as_py()] * len(slices), pa.int64()),
                "keys": pa.array([pack(asked[x], WIDTH) for _, x in slices], pa.binary()),
                "counts": pa.array([None if held_out else pack(counts[x], 5) for _, x in slices], pa.binary()),
            }
        )

    return ask


ASKED = "bucket int, home long, keys binary, counts binary"
ANSWERS = "bucket long, part int, levels binary"


def _answer(bits: int, segment: int, probes: int):
    """Fills a bucket's segment from the training rows, and tells each group the levels of the n-grams it asks for."""

    def answer(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        asked = [unpack(x, WIDTH) for x in rows.column("keys").to_pylist()]
        counts = [
            np.zeros(len(keys), dtype=np.int64) if x is None else unpack(x, 5).astype(np.int64)
            for keys, x in zip(asked, rows.column("counts").to_pylist())
        ]
        sizes = [len(x) for x in asked]
        keys, counts = np.concatenate(asked), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        heads = np.flatnonzero(new)
        keys, counts = ordered[heads] | (np.uint64(bucket) << np.uint64(8 * WIDTH)), np.add.reduceat(counts[order], heads)
        learnt = counts > 0
        table = build_segment(keys[learnt], counts[learnt], segment, probes)
        levels = np.empty(len(order), dtype=np.uint8)
        levels[order] = probe(table, keys, probes)[np.cumsum(new) - 1]
        ends = np.cumsum(sizes).tolist()
        return pa.table(
            {
                "bucket": rows.column("home"),
                "part": rows.column("bucket"),
                "levels": pa.array([levels[j - n : j].tobytes() for j, n in zip(ends, sizes)], pa.binary()),
            }
        )

    return answer


def train(
    docs: DataFrame, order: int = ORDER, prior: float = PRIOR, head: int = HEAD, read: int = 0
) -> tuple[Model, DataFrame]:
    """Totals and frequent words of the ``text`` of all rows, with the exact count of every token.

    Tokens are counted by Spark; the most frequent ones (a stated number) and the totals go to the workers. ``read`` is about
    the number of tokens that will be scored.
    """
    prepare(docs.sparkSession)
    docs = docs.select("text")
    counts = docs.mapInArrow(_count_tokens("text"), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = stored(counts, "tokens")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The end mark is a context's count, so it is always among the words at hand.
    frequent = counts.orderBy((F.col("token") == int(END.view(np.int64))).desc(), F.col("n").desc(), "token").limit(head).toArrow()
    keys, n = frequent.column("token").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    place = np.argsort(keys)
    size, probes, bits = filter_shape(tokens, order, read)
    return Model(size, bits, probes, keys[place], n[place], tokens, distinct, order, prior), counts


def ask_filter(grouped: DataFrame, model: Model) -> DataFrame:
    """What the filter of the rows not held out says of each group's n-grams, a row a group (``bucket``) and segment (``part``).

    n-grams travel to their segment's bucket once, to be counted and to be answered; a task holds one segment at a time.
    """
    asked = by_bucket(grouped.select("bucket", "held_out", "text"), _ask(model.order, model.bits), ASKED)
    return by_bucket(asked, _answer(model.bits, model.size >> model.bits, model.probes), ANSWERS)


SCORED = (
    "doc_id long, text_key long, n_tokens long, known long, logs double, score double, "
    "rare array<struct<token: long, n: long>>"
)


def _score(shared):
    def score(rows: pa.Table) -> pa.Table:
        """Scores a group's documents; rows without a text key are the filter's answers."""
        model: Model = shared.value
        own = pc.is_valid(rows.column("text_key"))
        docs, answers = rows.filter(own), rows.filter(pc.invert(own))
        keys, first = sequences(docs.column("text").combine_chunks())
        asked, place = asked_ngrams(keys, first, model.order, model.bits)
        parts, held = answers.column("part").to_numpy(), answers.column("levels").to_pylist()
        levels = np.frombuffer(b"".join(held[i] for i in np.argsort(parts)), dtype=np.uint8)
        if len(levels) != len(asked):
            raise ValueError("the documents changed between two readings")
        exact, found = model.exact(keys)
        logs = model.logs(keys, first, exact, found, levels[place].astype(np.int64))
        sums = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x  # noqa: E731  every row has its end
        rare = np.flatnonzero(~found)
        row = np.searchsorted(first, rare, side="right") - 1
        order = np.lexsort((keys[rare], row))
        row, token = row[order], keys[rare][order]
        heads = np.flatnonzero(
            np.concatenate([[True], (row[1:] != row[:-1]) | (token[1:] != token[:-1])]) if len(row) else row
        )
        n = np.diff(np.concatenate([heads, [len(row)]]))
        starts = np.searchsorted(row[heads], np.arange(len(first)))
        pairs = pa.StructArray.from_arrays(
            [pa.array(token[heads].view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"]
        )
        return pa.table(
            [
                docs.column("doc_id").cast(pa.int64()),
                docs.column("text_key"),
                pa.array(np.diff(first).astype(np.int64)),
                pa.array(sums((exact > 0).astype(np.int64))),
                pa.array(sums(np.log10(np.where(found, exact, 0) + 1.0))),
                pa.array(sums(logs)),
                pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pairs),
            ],
            names=["doc_id", "text_key", "n_tokens", "known", "logs", "score", "rare"],
        )

    return score


def score_texts(docs: DataFrame, held_out: Column, order: int = ORDER, prior: float = PRIOR, **limits) -> DataFrame:
    """Scores every row's whole text by a model learnt from the rows that aren't held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row for each input row. Tokens
    are the words in lower case and one end a text, so null and empty texts have one token. A null fold counts as not
    held out. ``base_score`` uses exact counts: those of frequent tokens are at hand, the others are joined. Without
    training rows every token is unknown. Other columns are not read.
    """
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    model, counts = train(docs.where("not held_out"), order, prior, read=size // TOKEN_BYTES, **limits)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    # Rows that share id and text get the same figures, so the pair serves as key and repeats are counted.
    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    # Groups hold the same rows whenever they are made, and only training rows or only others.
    home = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(size // GROUP_BYTES + 1)) * 2 + F.col("held_out").cast("long")
    grouped = keyed.withColumn("bucket", home)
    answers = stored(ask_filter(grouped, model), "levels")
    met = grouped.drop("held_out").unionByName(answers, allowMissingColumns=True)
    scored = stored(by_bucket(met, _score(shared), SCORED), "scored")
    rare = scored.select("doc_id", "text_key", F.inline("rare")).join(
        counts.withColumnRenamed("n", "held"), "token"
    )
    rare = rare.groupBy("doc_id", "text_key").agg(
        F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("held") + 1.0)).alias("more_logs")
    )
    key = ["doc_id", "text_key"]
    times = scored.drop("rare").groupBy(*key).agg(
        F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("n_tokens", "known", "logs", "score"))
    )
    match = F.col("s.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("s.text_key") == F.col("r.text_key"))
    out = times.alias("s").join(rare.alias("r"), match, "left")
    each = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("times")
    total = float(model.tokens + model.distinct + 1)
    out = out.select(
        F.col("s.doc_id").alias("doc_id"),
        "times",
        "n_tokens",
        (F.col("known") + each("more_known").cast("long")).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + each("more_logs") - F.col("n_tokens") * F.log10(F.lit(total))).alias("base_score"),
        "score",
    )
    return out.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_each", "times")
