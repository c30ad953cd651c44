"""Sorted 64-bit keys and counts packed into binary columns, so that many small rows travel as few large ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned 64-bit values, byte plane by byte plane, which compresses well when sorted."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def cut_by_bucket(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket (the first ``bits`` bits of a 64-bit key) starts among sorted keys; buckets + 1 entries."""
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_keys, tops), [len(sorted_keys)]])


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def bits_for(rows: int, per_bucket: int, least: int = 6, most: int = 16) -> int:
    """Bits of a bucket number such that a bucket holds about ``per_bucket`` rows."""
    return int(min(most, max(least, np.ceil(np.log2(max(1, rows / per_bucket))))))


def by_bucket(rows: DataFrame, work, schema: str) -> DataFrame:
    """Applies a function of one table to all rows of each bucket; a task holds one bucket at a time."""

    def run(batches):
        held, current = [], None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j > i:
                    if held and bucket[i] != current:
                        yield from work(pa.Table.from_batches(held)).to_batches()
                        held = []
                    current = bucket[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
