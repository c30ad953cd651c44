"""Approximate nearest neighbours by cosine: inverted lists, and an adaptive scan of rotated vectors by column blocks.

Vectors of length one are rotated at random, so that any few of their dimensions stand for all: the squared distance over d
of D dimensions, times D/d, comes near the whole. Each list is scanned in blocks of vectors stored dimension by dimension.
A query adds up distances over growing column blocks, and after each one gives up the candidates whose distance so far
says, by a hypothesis test, that they lie beyond its nearest ones. What is left at the end is ranked; cosines of the
results are computed on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm.stored import prepare, stored

#: Vectors that the index is fitted on, chosen by a hash; queries among them that fix the number of lists to probe; and
#: the share of their nearest neighbours within the sample that the lists must hold.
SAMPLE, TRIALS, RECALL = 16384, 256, 0.985
#: Lists at most, vectors of a list's part, vectors scanned at once, and steps of the clustering.
LISTS, PART, BLOCK, STEPS = 1024, 16384, 2048, 12
#: Dimensions of the first column block, and the test's margin: larger is safer and slower.
COLUMNS, MARGIN = 8, 2.1
#: Results that are ranked exactly, for each one wanted.
SPARE = 3


def distinct_vectors(vectors: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """Vectors that take part, and each different one with the smallest ``copies`` ids that have it.

    The first is ``vec_id, high, low`` (128 bits that stand for the vector), the second ``rep, embedding, ids``. Vectors
    that are null, zero or hold null or non-finite components take no part, nor do rows without an id; of rows that share
    an id the smallest vector counts.
    """
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select("vec_id", "embedding").where(x.isNotNull() & F.col("vec_id").isNotNull() & sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("embedding"))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = stored(rows.select("*", F.xxhash64("embedding").alias("high"), F.xxhash64(F.lit(1), "embedding").alias("low")), "vectors")
    ids = rows.select("vec_id", "high", "low")
    rank = F.row_number().over(Window.partitionBy("high", "low").orderBy("vec_id"))
    some = ids.withColumn("rank", rank).where(F.col("rank") <= copies)
    some = some.groupBy("high", "low").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = some.select(F.get("ids", F.lit(0)).alias("rep"), "ids")
    return ids, stored(rows.select(F.col("vec_id").alias("rep"), "embedding").join(classes, "rep"), "classes")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as numbers, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the range of numbers."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Index:
    """A rotation, the centres of the lists, and how many lists a query probes."""

    def __init__(self, sample: np.ndarray, width: int, k: int, total: int):
        draw = np.random.default_rng(29)
        q, r = np.linalg.qr(draw.standard_normal((width, width)))
        self.rotation = q * np.sign(np.diag(r))
        rows = _unit(sample) @ self.rotation
        lists = int(min(LISTS, max(1, np.sqrt(total) / 2), len(rows)))
        self.centres = rows[draw.choice(len(rows), lists, replace=False)]
        for _ in range(STEPS):
            near = self.order(rows, 1)[:, 0]
            total_of = np.zeros_like(self.centres)
            np.add.at(total_of, near, rows)
            length = np.linalg.norm(total_of, axis=1)
            self.centres = np.where(length[:, None] > 0, total_of / np.maximum(length, 1e-300)[:, None], self.centres)
        self.probes = self._probes(rows, k)

    def order(self, rows: np.ndarray, count: int) -> np.ndarray:
        """The nearest lists of each row, nearest first."""
        score = -(rows @ self.centres.T)
        if count >= len(self.centres):
            return np.argsort(score, axis=1, kind="stable")
        some = np.argpartition(score, count - 1, axis=1)[:, :count]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(score, some, axis=1), axis=1, kind="stable"), axis=1)

    def _probes(self, rows: np.ndarray, k: int) -> int:
        """So many lists that they hold the wanted share of the nearest neighbours of some of the sample."""
        tried = rows[:TRIALS]
        score = tried @ rows.T
        score[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
        near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
        if not near.size:
            return len(self.centres)
        home = self.order(rows, 1)[:, 0]
        place = np.argsort(self.order(tried, len(self.centres)), axis=1)
        ranks = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1


PLACED = "rep long, list int, point binary, probes array<int>"


def _place(index, width: int):
    """List and rotated vector of every row, and the lists that a query probes."""

    def place(batches):
        held: Index = index.value
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                rows = _unit(_matrix(part.column("embedding"), width)) @ held.rotation
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                home, probes = held.order(rows, 1)[:, 0], held.order(rows[asks], held.probes)
                cuts = np.concatenate([[0], np.cumsum(np.where(asks, probes.shape[1], 0))])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(probes.ravel().astype(np.int32)))
                points = pa.array([x.tobytes() for x in rows.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), pa.array(home.astype(np.int32)), points, lists], names=["rep", "list", "point", "probes"]
                )

    return place


class Scan:
    """Nearest candidates of a query within one part of a list, which is held in blocks of vectors by dimension."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, keep: int):
        self.keep, self.width = keep, points.shape[1]
        self.blocks = [(ids[i : i + BLOCK], np.ascontiguousarray(points[i : i + BLOCK].T)) for i in range(0, len(ids), BLOCK)]
        self.given_up = self.finished = 0
        cuts, size = [0], COLUMNS
        while cuts[-1] < self.width:
            cuts.append(min(self.width, cuts[-1] + size))
            size *= 2
        self.cuts = cuts

    def nearest(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, best = np.zeros(0, np.int64), np.zeros(0, np.float32)
        for names, columns in self.blocks:
            limit = best[-1] if len(best) == self.keep else np.inf
            rows, sofar = None, np.zeros(columns.shape[1], np.float32)
            for a, b in zip(self.cuts[:-1], self.cuts[1:]):
                part = columns[a:b] if rows is None else columns[a:b, rows]
                sofar = sofar + ((part - query[a:b, None]) ** 2).sum(axis=0)
                if b < self.width and np.isfinite(limit):
                    # Rejected: the distance estimated from b dimensions is too far above the limit to be chance.
                    near = sofar * (self.width / b) <= limit * (1 + MARGIN / np.sqrt(b)) ** 2
                    rows = np.flatnonzero(near) if rows is None else rows[near]
                    sofar = sofar[near]
            self.given_up += columns.shape[1] - len(sofar)
            self.finished += len(sofar)
            ids = np.concatenate([ids, names if rows is None else names[rows]])
            best = np.concatenate([best, sofar])
            order = np.lexsort((ids, best))[: self.keep]
            ids, best = ids[order], best[order]
        return ids, best


FOUND = "query long, rep long, distance float"


def _scan(keep: int):
    """Answers the queries of each part of a list; its candidates come first and are held, the queries stream by."""

    def work(batches):
        current, ids, points, scan = None, [], [], None
        for batch in batches:
            lists, parts = batch.column("list").to_numpy(), batch.column("part").to_numpy()
            asks, reps = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("rep").to_numpy()
            out: list[tuple] = []
            for i, point in enumerate(batch.column("point")):
                if current != (lists[i], parts[i]):
                    current, ids, points, scan = (lists[i], parts[i]), [], [], None
                row = np.frombuffer(point.as_buffer(), dtype=np.float32)
                if not asks[i]:
                    ids.append(reps[i])
                    points.append(row)
                elif ids:
                    scan = scan or Scan(np.array(ids), np.array(points), keep)
                    names, best = scan.nearest(row)
                    out.append((np.full(len(names), reps[i]), names, best))
            if out:
                columns = [np.concatenate(v) for v in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["query", "rep", "distance"])

    return work


def _cosines(batches):
    for batch in batches:
        score = np.empty(len(batch))
        for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"))):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            n = min(len(a), len(b))
            score[i] = float(a[:n] @ b[:n]) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b)))
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("rep"), pa.array(score)], names=["query", "rep", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """Each query's ``k`` nearest found among all other vectors: ``query_id, rank, vec_id, score``, score the cosine.

    ``vectors`` has ``vec_id`` and ``embedding``; the column ``is_query`` (over ``vec_id``) picks the queries. Ties go to the smaller
    id; with fewer candidates all are returned; shorter vectors count as padded with zeros; other columns are not read; no
    query or no vector gives no rows. The index is fitted on ``SAMPLE`` vectors and holds all.

    Equal vectors are indexed and searched once and stand for the smallest k + 1 of their ids, which is all that a result
    can need; so a group of copies costs a row each. A large list is dealt to parts by a hash, each held by one task
    while queries stream by; queries go to all parts of the lists they probe.
    """
    spark = vectors.sparkSession
    prepare(spark)
    ids, classes = distinct_vectors(vectors, k + 1)
    asking = ids.where(is_query)
    total, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    # As many rows as SAMPLE at most.
    sample = classes.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
    rows = _matrix(sample.column("embedding").combine_chunks(), width)
    index = spark.sparkContext.broadcast(Index(rows, width, k, total))

    firsts = ids.join(asking.select("high", "low").distinct(), ["high", "low"], "left_semi")
    firsts = firsts.groupBy("high", "low").agg(F.min("vec_id").alias("rep"))
    firsts = stored(firsts, "asked")
    asked = firsts.select("rep", F.lit(True).alias("asks"))
    placed = classes.select("rep", "embedding").join(asked, "rep", "left")
    placed = placed.select("rep", "embedding", F.coalesce("asks", F.lit(False)).alias("asks"))
    placed = stored(placed.mapInArrow(_place(index, width), PLACED), "placed")
    # One row a list, LISTS at most.
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    there = placed.join(F.broadcast(parts), "list")
    there = there.select("list", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "rep", "point")
    probing = placed.where(F.size("probes") > 0).select("rep", "point", F.explode("probes").alias("list")).join(F.broadcast(parts), "list")
    probing = probing.select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "rep", "point"
    )
    # A query's own class is among what it finds, so one more is asked for; and some more, as distances are rounded.
    keep = (k + 1) * SPARE
    dealt = there.unionAll(probing).repartition("list", "part").sortWithinPartitions("list", "part", "asks")
    found = dealt.mapInArrow(_scan(keep), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "rep"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= keep).select("query", "rep")
    pairs = found.join(classes.select(F.col("rep").alias("query"), F.col("embedding").alias("a")), "query")
    pairs = pairs.join(classes.select("rep", F.col("embedding").alias("b")), "rep")
    scored = stored(pairs.select("query", "rep", "a", "b").mapInArrow(_cosines, "query long, rep long, score double"), "scored")

    queries = asking.join(firsts, ["high", "low"]).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    best = scored.join(classes.select("rep", "ids"), "rep").groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "rep", "ids"))).alias("found")
    )
    out = queries.join(best, "query").select("query_id", F.inline("found")).select("query_id", (-F.col("far")).alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = out.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
