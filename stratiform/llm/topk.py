"""Exact top-k inner products: candidates grouped by length, pruned by local cosine thresholds, then multiplied out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm.stored import prepare
from stratiform.session import checkpointed

#: Queries held by a task at once, and candidates in a bucket.
BLOCK, BUCKET = 2048, 1024
#: From this local threshold on, single coordinates prune better than lengths; and how many of them are tried.
STEEP, FOCUS = 0.3, 4
LONG = (-(1 << 63), (1 << 63) - 1)
SCHEMA = "query_id long, vec_id long, score long, part int"


def whole_vectors(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """``vec_id`` and the vector floor(scale * x), with its length; one row an id, sorted into norm bands.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Of rows that
    share an id the smallest vector counts. Components saturate at the limits of a long.
    """
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(x.isNotNull() & F.col("vec_id").isNotNull() & sound)
    rows = rows.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("whole"))
    rows = rows.groupBy("vec_id").agg(F.min("whole").alias("whole"))
    squares = F.aggregate("whole", F.lit(0.0), lambda held, c: held + c.cast("double") * c.cast("double"))
    return rows.withColumn("length", F.sqrt(squares))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _fit(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Search:
    """Best products of a block of queries over the buckets seen so far."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, k: int):
        self.ids, self.whole, self.k = ids, whole, k
        self.length = np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1))
        self.least = np.full(len(ids), -np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.pruned = self.verified = 0

    def products(self, rows: np.ndarray, query: int | np.ndarray) -> np.ndarray:
        """Integer products; exact in floating point below 2^53, else by Python integers cut at a long's limits."""
        width = max(rows.shape[1], self.whole.shape[1])
        a, b = _fit(rows, width), _fit(np.atleast_2d(self.whole[query]), width)
        if width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
            return (b.astype(np.float64) @ a.astype(np.float64).T).astype(np.int64)
        exact = b.astype(object) @ a.astype(object).T
        return np.clip(exact, *LONG).astype(np.int64)

    def keep(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        use = (scores >= self.least[query]) & (ids != self.ids[query])
        if not use.any():
            return
        held_scores, held_ids = self.best[query]
        scores, ids = np.concatenate([held_scores, scores[use]]), np.concatenate([held_ids, ids[use]])
        order = np.lexsort((ids, ~scores))[: self.k]
        self.best[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[query] = np.nextafter(float(scores[order[-1]]), -np.inf)

    def bucket(self, ids: np.ndarray, whole: np.ndarray, length: np.ndarray) -> None:
        """One bucket, longest vector first."""
        longest = float(length.max(initial=0.0))
        reach = self.length * longest
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, self.least / reach, np.where(self.least > 0, np.inf, -np.inf))
        local = local - 1e-9 * np.abs(local) - 1e-9
        open_queries = np.flatnonzero(local <= 1.0)
        self.pruned += (len(self.ids) - len(open_queries)) * len(ids)
        steep = open_queries[local[open_queries] > STEEP]
        flat = open_queries[local[open_queries] <= STEEP]
        if len(flat):
            # Length pruning: only the head of the bucket is long enough for the most lenient of these queries.
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.length[flat] > 0, self.least[flat] / self.length[flat], -np.inf)
            shortest = float(need.min()) * (1 - 1e-9) - 1e-9
            head = int(np.searchsorted(-length, -shortest, side="right")) if shortest > 0 else len(ids)
            scores = self.products(whole[:head], flat)
            self.verified += scores.size
            for row, query in zip(scores, flat):
                self.keep(query, ids[:head], row)
        if len(steep):
            unit = whole / np.where(length > 0, length, 1.0)[:, None]
            for query in steep:
                rows = self.feasible(query, float(local[query]), unit)
                self.pruned += len(ids) - len(rows)
                if len(rows):
                    self.verified += len(rows)
                    self.keep(query, ids[rows], self.products(whole[rows], query)[0])

    def feasible(self, query: int, cosine: float, unit: np.ndarray) -> np.ndarray:
        """Rows whose largest query coordinates lie where a vector of that cosine must have them."""
        q = self.whole[query] / self.length[query]
        rows = np.arange(len(unit))
        rest = 1.0 - min(cosine, 1.0) ** 2
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            if f >= unit.shape[1]:
                continue
            width = np.sqrt(max(0.0, (1.0 - q[f] ** 2) * rest)) + 1e-9
            low = -np.inf if q[f] < 0 and -q[f] >= cosine else q[f] * cosine - width
            high = np.inf if q[f] > 0 and q[f] >= cosine else q[f] * cosine + width
            at = unit[rows, f]
            rows = rows[(at >= low) & (at <= high)]
        return rows


def _searcher(queries, k: int, salts: int):
    def search(batches):
        from pyspark import TaskContext

        ids, whole = queries.value
        held = Search(ids, whole, k)
        for batch in batches:
            every, lengths = batch.column("vec_id").to_numpy(), batch.column("length").to_numpy()
            rows = _matrix(batch.column("whole"))
            for at in range(0, len(every), BUCKET):
                part = slice(at, at + BUCKET)
                order = np.argsort(-lengths[part], kind="stable")
                held.bucket(every[part][order], rows[part][order], lengths[part][order])
        sizes = [len(x) for _, x in held.best]
        part = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(held.ids, sizes), pa.int64()),
                pa.array(np.concatenate([x for _, x in held.best] or [np.zeros(0, np.int64)]), pa.int64()),
                pa.array(np.concatenate([x for x, _ in held.best] or [np.zeros(0, np.int64)]), pa.int64()),
                pa.array(np.full(sum(sizes), part, np.int32)),
            ],
            names=["query_id", "vec_id", "score", "part"],
        )

    return search


def top_products(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """Each query's ``k`` highest products with all other vectors: ``query_id, rank, vec_id, score``.

    ``vectors`` has ``vec_id`` and ``embedding``; the column ``is_query`` picks the queries. Ties go to the smaller id;
    with fewer candidates all are returned; vectors of fewer components count as padded with zeros; other columns are
    not read; no query or no vector gives no rows.

    Candidates are dealt by length (equal lengths by id, so that copies spread) and stored once. Queries go out in
    blocks of bounded size, each answered in one pass: a task skips, query by query, the buckets whose longest vector
    can't reach the query's k-th best product, and prunes the others by length, or by coordinates where the cosine they
    need is high. A task returns k rows a query, and these are merged in two steps.
    """
    prepare(vectors.sparkSession)
    spark = vectors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = whole_vectors(vectors, scale)
    rows = rows.repartitionByRange(parts, F.col("length").desc(), "vec_id").sortWithinPartitions(F.col("length").desc())
    rows = checkpointed(rows)
    queries = rows.where(is_query)
    blocks = -(-queries.count() // BLOCK)
    out = spark.createDataFrame([], SCHEMA)
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).select("vec_id", "whole").toArrow()
        if not len(mine):
            continue
        order = np.argsort(mine.column("vec_id").to_numpy())
        held = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy()[order], _matrix(mine.column("whole"))[order]))
        out = out.unionAll(rows.select("vec_id", "whole", "length").mapInArrow(_searcher(held, k, 64), SCHEMA))
    best = [F.col("score").desc(), F.col("vec_id").asc()]
    for keys in (["query_id", "part"], ["query_id"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
