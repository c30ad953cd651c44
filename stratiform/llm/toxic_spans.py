"""Toxicity: a linear-chain conditional random field marks toxic words; its marginals make up a document's score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from stratiform.llm.words import FOLD, batches_of, blocks, bytes_of, stretch, sums, word_bounds
from stratiform.llm.stored import prepare

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = 2500
#: Size of the table of feature weights, features of a word, and the length of training stretches.
SLOTS, SEGMENT = 1 << 20, 64
FEATURES = 5
#: A word of a toxic document is labelled toxic when one of its features is in so many toxic documents of the sample,
#: and so many times as often as in clean ones.
SUPPORT, RATIO = 8, 20.0
STEPS, RATE, DECAY = 60, 0.3, 1e-4
#: Documents whose features are counted at a time.
COUNTED = 256


def word_features(column: pa.Array):
    """Slots of every word's features, and the words' bytes: ``slots, start, stop, first word of each row, bytes, row starts``.

    Features are the word in lower case, its first five and four bytes, its last five, and its length.
    """
    data, offsets = bytes_of(column)
    start, stop = word_bounds(data, offsets)
    slots = np.empty((FEATURES, len(start)), dtype=np.int32)
    for words, a, b in blocks(start, stop):
        running = sums(FOLD[data[a:b]])
        i, j = start[words] - a, stop[words] - a
        keys = (
            stretch(running, i, j),
            stretch(running, i, np.minimum(i + 5, j)) + np.uint64(1),
            stretch(running, i, np.minimum(i + 4, j)) + np.uint64(2),
            stretch(running, np.maximum(j - 5, i), j) + np.uint64(3),
            np.minimum(j - i, 30).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(4),
        )
        for slot, key in zip(slots, keys):
            slot[words] = (key % np.uint64(SLOTS)).astype(np.int32)
    return slots, start, stop, np.searchsorted(start, offsets), data, offsets


def marginals(scores: np.ndarray, first: np.ndarray, jumps: np.ndarray) -> np.ndarray:
    """Chance of state 1 of every word, by the forward-backward recursion over all rows at once.

    ``scores`` are log-odds of the words alone, ``jumps`` the 2 x 2 log transition weights. Rows are walked in step,
    the longest first, so that the rows still open are a head of the list; the recursion keeps log-odds only.
    """
    sizes = np.diff(first)
    rows = np.argsort(-sizes, kind="stable")
    sizes = sizes[rows]
    left, right = first[:-1][rows], first[1:][rows] - 1
    weight = np.exp(jumps)
    forward, backward = np.empty(len(scores)), np.empty(len(scores))
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    ahead = behind = None
    for t, n in enumerate(alive):
        at = left[:n] + t
        if t:
            odds = np.exp(np.clip(ahead[:n], -60, 60))
            ahead = np.log((weight[0, 1] + weight[1, 1] * odds) / (weight[0, 0] + weight[1, 0] * odds)) + scores[at]
        else:
            ahead = scores[at]
        forward[at] = ahead
        at = right[:n] - t
        if t:
            odds = np.exp(np.clip(behind[:n] + scores[at + 1], -60, 60))
            behind = np.log((weight[1, 0] + weight[1, 1] * odds) / (weight[0, 0] + weight[0, 1] * odds))
        else:
            behind = np.zeros(n)
        backward[at] = behind
    return 1.0 / (1.0 + np.exp(-np.clip(forward + backward, -60, 60)))


def _chance(ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    x = ahead + behind
    np.clip(x, -60, 60, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.divide(1.0, x, out=x)


def pair_marginals(scores: np.ndarray, jumps: np.ndarray):
    """For stretches of equal length (rows x words): chances of state 1, and expected counts of the transitions."""
    rows, size = scores.shape
    weight = np.exp(jumps)
    ahead, behind = np.empty((size, rows)), np.zeros((size, rows))
    ahead[0] = scores[:, 0]
    for t in range(1, size):
        odds = np.exp(np.clip(ahead[t - 1], -60, 60))
        ahead[t] = np.log((weight[0, 1] + weight[1, 1] * odds) / (weight[0, 0] + weight[1, 0] * odds)) + scores[:, t]
    for t in range(size - 2, -1, -1):
        odds = np.exp(np.clip(behind[t + 1] + scores[:, t + 1], -60, 60))
        behind[t] = np.log((weight[1, 0] + weight[1, 1] * odds) / (weight[0, 0] + weight[0, 1] * odds))
    chance = _chance(ahead, behind)
    counts = np.zeros((2, 2))
    before = ahead[:-1]
    behind += scores.T
    after = behind[1:]
    # One transition at a time: the four tables together would be the largest thing in the fit.
    joint = lambda a, b: jumps[a, b] + a * before + b * after
    steps = [(a, b) for a in (0, 1) for b in (0, 1)]
    top = joint(*steps[0])
    for step in steps[1:]:
        np.maximum(top, joint(*step), out=top)

    def weighed(step) -> np.ndarray:
        x = joint(*step)
        x -= top
        return np.exp(x, out=x)

    total = np.zeros_like(top)
    for step in steps:
        total += weighed(step)
    for step in steps:
        x = weighed(step)
        x /= total
        counts[step] = x.sum()
    return chance.T, counts


class Model:
    """Feature weights, transitions and the step from marginals to a document's score."""

    def __init__(self, weights, bias, jumps, final):
        self.weights, self.bias, self.jumps, self.final = weights, bias, jumps, final

    def words(self, slots: np.ndarray) -> np.ndarray:
        scores = np.full(slots.shape[1], self.bias)
        for feature in slots:
            scores += self.weights[feature]
        return scores

    def summary(self, chance: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per row: log-odds of the most toxic word, log of the expected number of toxic words; neutral where empty."""
        sizes = np.diff(first)
        top, total = np.zeros(len(sizes)), np.zeros(len(sizes))
        filled = np.flatnonzero(sizes > 0)
        if len(filled):
            top[filled] = np.maximum.reduceat(chance, first[:-1][filled])
            total[filled] = np.add.reduceat(chance, first[:-1][filled])
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.stack([np.log(top / (1 - top)), np.log(total + 1e-3)], axis=1)

    def score(self, chance: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = self.summary(chance, first)
        return 1.0 / (1.0 + np.exp(-np.clip(self.final[0] + x @ self.final[1:], -60, 60)))


def _document_counts(slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In how many rows each slot occurs."""
    out = np.zeros(SLOTS, dtype=np.int64)
    # A row's words stand together, so rows are counted some at a time.
    cuts = np.flatnonzero(np.diff(rows // COUNTED)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
        pairs = np.unique(np.concatenate([rows[i:j].astype(np.int64) * SLOTS + s[i:j] for s in slots]))
        out += np.bincount(pairs % SLOTS, minlength=SLOTS)
    return out


def fit(texts: list[str | None], toxic: np.ndarray, share: float) -> Model:
    """Fits the field on labelled texts; ``share`` is the share of toxic rows among all labelled rows.

    Words of toxic documents with a telling feature are labelled toxic, all others clean; the field maximises the
    likelihood of these labels over stretches of words, and a logistic step maps marginals to document labels. With one
    class only, every score is that class's share.
    """
    toxic = np.asarray(toxic, dtype=bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        edge = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(np.zeros(SLOTS), 0.0, np.zeros((2, 2)), np.array([edge, 0.0, 0.0]))
    slots, _, _, first, _, _ = word_features(pa.array(texts, pa.string()))
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    in_toxic = toxic[row]
    held = _document_counts(slots[:, in_toxic], row[in_toxic])
    other = _document_counts(slots[:, ~in_toxic], row[~in_toxic])
    ratio = (held / toxic.sum()) / ((other + 0.5) / (~toxic).sum())
    telling = (held >= SUPPORT) & (ratio >= RATIO)
    target = np.zeros(len(row), dtype=bool)
    for feature in slots:
        target |= telling[feature]
    target &= in_toxic
    del row, in_toxic
    usable = len(target) // SEGMENT * SEGMENT
    if not usable:
        slots, target = np.tile(slots, (1, SEGMENT)), np.tile(target, SEGMENT)
        usable = len(target) // SEGMENT * SEGMENT
    slots, target = slots[:, :usable], target[:usable].astype(float)
    held = np.zeros(SLOTS, dtype=bool)
    for feature in slots:
        held[feature] = True
    used = np.flatnonzero(held)
    # Places among the used slots, in the room of the slots themselves, which are made again for the last step.
    places = np.zeros(SLOTS, dtype=np.int32)
    places[used] = np.arange(len(used), dtype=np.int32)
    compact = slots
    for feature in compact:
        feature[:] = places[feature]
    weights, bias, jumps = np.zeros(len(used)), -2.0, np.zeros((2, 2))
    wanted = target.reshape(-1, SEGMENT)
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((wanted[:, :-1] == a) & (wanted[:, 1:] == b)).sum()
    squares, bias_square, jump_squares = np.full(len(used), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(STEPS):
        scores = np.zeros(compact.shape[1])
        for c in compact:
            scores += weights[c]
        scores += bias
        chance, counts = pair_marginals(scores.reshape(-1, SEGMENT), jumps)
        error = target - chance.reshape(-1)
        del scores, chance
        slope = sum(np.bincount(c, error, minlength=len(used)) for c in compact) - DECAY * len(target) * 1e-2 * weights
        squares += slope**2
        weights += RATE * slope / np.sqrt(squares)
        bias_slope = error.sum()
        bias_square += bias_slope**2
        bias += RATE * bias_slope / np.sqrt(bias_square)
        jump_slope = seen - counts
        jump_squares += jump_slope**2
        jumps += RATE * jump_slope / np.sqrt(jump_squares)
    del slots, compact, error
    table = np.zeros(SLOTS)
    table[used] = weights
    model = Model(table, float(bias), jumps, np.zeros(3))
    slots, _, _, first, _, _ = word_features(pa.array(texts, pa.string()))
    x = model.summary(marginals(model.words(slots), first, jumps), first)
    model.final = _logistic(x, toxic.astype(float), np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean())))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small penalty."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(curve, x.T @ (weight * (y - p)) - 0.1 * beta)
    return beta


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = SAMPLE) -> tuple[list, np.ndarray, float]:
    """Texts and labels of at most ``per_class`` labelled documents a class, picked by a hash of the id, and the toxic share.

    Rows without a label or a document don't count; of several labels of one id the highest counts.
    """
    labels = labels.where("toxic is not null and doc_id is not null").where(use)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sizes = {int(r["toxic"] > 0): r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts, toxic = [], []
    for value in (0, 1):
        chosen = labels.where(F.col("toxic") > 0 if value else F.col("toxic") <= 0).orderBy(*order).limit(per_class)
        chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id")))
        rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text")
        rows = sorted(rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect(), key=lambda r: r["doc_id"])
        texts += [r["text"] for r in rows]
        toxic += [value] * len(rows)
    total = sum(sizes.values())
    return texts, np.array(toxic, dtype=int), sizes.get(1, 0) / total if total else 0.0


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))


def tag_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted`` and ``spans``, the character ranges of words more likely toxic than not.

    Every whole text is read, by its words alone; null counts as empty, an empty text gets the score of a text without
    toxic words, spans of neighbouring words are joined. Columns named like the new ones are replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("score", "predicted", "spans")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.jumps, model.final))
    schema = StructType(list(docs.schema.fields)).add("score", DoubleType()).add("predicted", IntegerType()).add("spans", SPANS)

    def tag(batches):
        held = Model(*shared.value)
        for batch in batches_of(batches):
            slots, start, stop, first, data, offsets = word_features(batch.column(text))
            chance = marginals(held.words(slots), first, held.jumps)
            score = held.score(chance, first)
            spans = _spans(chance, start, stop, first, data, offsets)
            out = batch
            for name, column in (("score", pa.array(score)), ("predicted", pa.array((score >= 0.5).astype(np.int32))), ("spans", spans)):
                out = out.append_column(name, column)
            yield out

    return docs.mapInArrow(tag, schema)


def _spans(chance, start, stop, first, data, offsets) -> pa.Array:
    hot = chance >= 0.5
    heads = np.zeros(len(hot), dtype=bool)
    heads[first[:-1][first[:-1] < len(hot)]] = True
    begin = hot & (heads | ~np.concatenate([[False], hot[:-1]])) if len(hot) else hot
    following = np.concatenate([hot[1:], [False]]) if len(hot) else hot
    next_head = np.concatenate([heads[1:], [True]]) if len(hot) else heads
    end = hot & (next_head | ~following)
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.searchsorted(first, begin, side="right") - 1
    base = chars[offsets[:-1][row]] if len(row) else np.zeros(0, dtype=np.int64)
    pairs = pa.StructArray.from_arrays(
        [
            pa.array((chars[start[begin]] - base).astype(np.int32)),
            pa.array((chars[stop[end]] - base).astype(np.int32)),
        ],
        names=["start", "stop"],
    )
    counts = np.bincount(row, minlength=len(offsets) - 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pairs)
