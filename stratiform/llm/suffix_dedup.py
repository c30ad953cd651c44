"""Suffix-array dedup: a radix sort of suffixes that stops at the threshold; equal groups are the repeated windows.

The key of a suffix is its first ``length`` bytes, read digit by digit, most significant first. The first digit is the
least gram of those bytes by hash: all suffixes that share it stand in a row, so they are dealt out as one run, and the
bucket of the gram's hash is the shuffle's key. The second digit is the run's text; equal runs hold equal windows at equal
places. Only runs that share a gram with another document but differ in text are sorted by their last digit, the whole
window; there a run is needed once, in its first document. Groups of one document leave after each pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from stratiform.llm.packed import bits_for, by_bucket, contains, cut_by_bucket, pack, unpack
from stratiform.llm.stored import prepare, stored
from stratiform.llm.words import batches_of, bytes_of, mixed, powers, stretch, sums

LENGTH, GRAM = 50, 20
#: Window starts looked at together, and runs in a bucket.
PIECE, PER_BUCKET = 1 << 20, 1 << 18
#: Bytes that travel of a gram's hash (besides its bucket) and of a run's.
GRAM_WIDTH, RUN_WIDTH = 4, 6
_LOW = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with the same least gram: hash of the gram, hash of the text, first and last start.

    A window is ``length`` bytes inside one row. Of equal least grams the first counts, so that equal windows have equal
    ones wherever they stand. Long data are looked at in pieces, each with the window before it and as many after it as a
    run can go on for, so that a run is the same wherever the pieces and batches are cut.
    """
    starts = len(data) - length + 1
    found = []
    if starts > 0:
        closed = np.zeros(starts + 1, dtype=np.int32)
        np.add.at(closed, np.clip(offsets[1:] - length + 1, 0, starts), 1)
        np.add.at(closed, np.clip(offsets[1:], 0, starts), -1)
        valid = np.cumsum(closed[:-1], dtype=np.int32) == 0
        for at in range(0, starts, PIECE):
            # All windows of a run hold its gram, so it has at most length - gram + 1 of them.
            low, high = max(at - 1, 0), min(at + PIECE + length - gram, starts)
            piece = _piece(data[low : high + length - 1], valid[low:high], low, length, gram)
            own = (piece[2] >= at) & (piece[2] < at + PIECE)
            found.append(tuple(x[own] for x in piece))
    if not found:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _piece(data: np.ndarray, valid: np.ndarray, at: int, length: int, gram: int):
    running = sums(data)
    n = len(data) - gram + 1
    grams = mixed((running[gram:] - running[:-gram]) * powers(len(running))[1][:n])
    least = (grams & ~_LOW) | np.arange(n, dtype=np.uint64)
    width, wanted = 1, length - gram + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = (least & _LOW).astype(np.int64)
    differs = place[1:] != place[:-1]
    first, last = valid.copy(), valid.copy()
    first[1:] &= differs | ~valid[:-1]
    last[:-1] &= differs | ~valid[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    # Least hashes are small ones, so they are mixed once more to spread over the buckets.
    return mixed(grams[place[first]] ^ np.uint64(1)), stretch(running, first, last + length), first + at, last + at


def _short(grams: np.ndarray, texts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return grams >> np.uint64(64 - bits - 8 * GRAM_WIDTH), texts >> np.uint64(64 - 8 * RUN_WIDTH)


def _key(gram: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number for a gram and a run as they travel."""
    return mixed(gram * np.uint64(0x9E3779B97F4A7C15) + mixed(text))


def _bucket_rows(order_keys: np.ndarray, bits: int):
    """Order by key, and the slices of the buckets that have rows."""
    order = np.argsort(order_keys, kind="stable")
    cuts = cut_by_bucket(order_keys[order], bits)
    return [(b, order[i:j]) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]


def _once(texts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One of the equal runs of each row: a text may repeat itself many times."""
    parts = [i + np.unique(texts[i:j], return_index=True)[1] for i, j in zip(at[:-1].tolist(), at[1:].tolist()) if j > i]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)


def _emit_runs(bits: int, length: int, gram: int):
    """First pass: the runs of each batch, one row a bucket."""

    def emit(batches):
        for batch in batches_of(batches, rows=1 << 16):
            data, offsets = bytes_of(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            grams, texts, first, _ = runs(data, offsets, length, gram)
            once = _once(texts, np.searchsorted(first, offsets))
            grams, texts, first = grams[once], texts[once], first[once]
            row = (np.searchsorted(offsets, first, side="right") - 1).astype(np.uint64)
            short, text = _short(grams, texts, bits)
            rows = _bucket_rows(grams, bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in rows], pa.int32()),
                    pa.array([pack(short[x], GRAM_WIDTH) for _, x in rows], pa.binary()),
                    pa.array([pack(text[x], RUN_WIDTH) for _, x in rows], pa.binary()),
                    pa.array([pack(row[x], 2) for _, x in rows], pa.binary()),
                    pa.array([pack(ids.astype(np.uint64), 8)] * len(rows), pa.binary()),
                ],
                names=["bucket", "grams", "texts", "rows", "ids"],
            )

    return emit


RUNS = "bucket int, grams binary, texts binary, rows binary, ids binary"
HITS = "doc_id long, key long, whole boolean"


def _match_runs(rows: pa.Table) -> pa.Table:
    """Of a bucket's runs, those whose text is in a smaller document, and the first of each text where texts differ."""
    bucket = np.uint64(rows.column("bucket")[0].as_py())
    column = lambda name: rows.column(name).to_pylist()
    gram = np.concatenate([unpack(x, GRAM_WIDTH) for x in column("grams")])
    text = np.concatenate([unpack(x, RUN_WIDTH) for x in column("texts")])
    doc = np.concatenate(
        [unpack(ids, 8).view(np.int64)[unpack(x, 2).astype(np.int64)] for x, ids in zip(column("rows"), column("ids"))]
    )
    order = np.lexsort((doc, text, gram))
    gram, text, doc = gram[order], text[order], doc[order]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new_text = new_gram | np.concatenate([[True], text[1:] != text[:-1]])
    heads = np.flatnonzero(new_text)
    least = doc[heads][np.cumsum(new_text) - 1]
    whole = doc > least
    # Texts of a gram that first stand in different documents go on to the next digit.
    head_gram = np.cumsum(new_gram)[heads] - 1
    lowest = np.full(head_gram[-1] + 1, np.iinfo(np.int64).max)
    highest = np.full(head_gram[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(lowest, head_gram, doc[heads])
    np.maximum.at(highest, head_gram, doc[heads])
    part = heads[(lowest != highest)[head_gram]]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | new_text[1:]])
    full = np.flatnonzero(whole & fresh)
    key = _key(gram | (bucket << np.uint64(8 * GRAM_WIDTH)), text).view(np.int64)
    return pa.table(
        {
            "doc_id": pa.array(np.concatenate([doc[full], doc[part]])),
            "key": pa.array(np.concatenate([key[full], key[part]])),
            "whole": pa.array(np.concatenate([np.ones(len(full), bool), np.zeros(len(part), bool)])),
        }
    )


OPEN = "bucket int, data binary, sizes binary, docs binary, keys binary"


def _emit_open(bits: int, length: int, gram: int):
    """Second pass: the text of the runs still open, one row a bucket."""

    def emit(batches):
        for batch in batches_of(batches):
            data, offsets = bytes_of(batch.column("text"))
            ids, wanted = batch.column("doc_id").to_numpy(), batch.column("open").to_pylist()
            grams, texts, first, last = runs(data, offsets, length, gram)
            key = _key(*_short(grams, texts, bits))
            at = np.searchsorted(first, offsets)
            use = []
            for i, x in enumerate(wanted):
                if x:
                    own = at[i] + np.unique(key[at[i] : at[i + 1]], return_index=True)[1]
                    use.append(own[contains(np.sort(np.array(x, dtype=np.int64).view(np.uint64)), key[own])])
            use = np.concatenate(use) if use else np.zeros(0, dtype=np.int64)
            row = np.searchsorted(offsets, first[use], side="right") - 1
            rows = []
            for bucket, x in _bucket_rows(grams[use], bits):
                begin, end = first[use[x]], last[use[x]] + length
                rows.append(
                    (
                        bucket,
                        b"".join(data[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist())),
                        (end - begin).astype(np.uint32).tobytes(),
                        ids[row[x]].astype(np.int64).tobytes(),
                        key[use[x]].tobytes(),
                    )
                )
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), kind) for x, kind in zip(columns, kinds)], names=["bucket", "data", "sizes", "docs", "keys"]
            )

    return emit


def _match_windows(length: int):
    def match(rows: pa.Table) -> pa.Table:
        """Windows of a bucket's open runs that also start in a smaller document, as a bit mask of each run."""
        column = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=kind)
        data, sizes = column("data", np.uint8), column("sizes", np.uint32).astype(np.int64)
        docs, keys = column("docs", np.int64), column("keys", np.int64)
        begin = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        run = np.repeat(np.arange(len(sizes)), windows)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begin[run] + offset
        running = sums(data)
        window = stretch(running, at, at + length)
        doc = docs[run]
        order = np.lexsort((doc, window))
        head = np.concatenate([[True], window[order][1:] != window[order][:-1]])
        least = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        hit = np.zeros(len(run), dtype=bool)
        hit[order] = doc[order] > least
        mask = np.zeros(len(sizes), dtype=np.int64)
        np.bitwise_or.at(mask, run[hit], np.int64(1) << offset[hit])
        some = np.flatnonzero(mask)
        return pa.table({"doc_id": pa.array(docs[some]), "key": pa.array(keys[some]), "mask": pa.array(mask[some])})

    return match


def _removed(data, offsets, whole, keys, masks, bits, length, gram) -> np.ndarray:
    """Which bytes of a batch are covered by windows that a smaller document has."""
    grams, texts, first, last = runs(data, offsets, length, gram)
    key = _key(*_short(grams, texts, bits))
    at = np.searchsorted(first, offsets)
    change = np.zeros(len(data) + length + 1, dtype=np.int32)
    for i in range(len(offsets) - 1):
        own = slice(at[i], at[i + 1])
        if whole[i]:
            hit = contains(np.sort(np.array(whole[i], dtype=np.int64).view(np.uint64)), key[own])
            np.add.at(change, first[own][hit], 1)
            np.add.at(change, last[own][hit] + length, -1)
        if keys[i]:
            table = np.array(keys[i], dtype=np.int64).view(np.uint64)
            order = np.argsort(table)
            table, mask = table[order], np.array(masks[i], dtype=np.int64)[order]
            place = np.minimum(np.searchsorted(table, key[own]), len(table) - 1)
            for run in np.flatnonzero(table[place] == key[own]):
                starts = first[own][run] + np.flatnonzero((mask[place[run]] >> np.arange(length - gram + 1)) & 1)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + length, -1)
    return np.cumsum(change, dtype=np.int32)[: len(data)] > 0


def _apply(bits: int, length: int, gram: int, names: list[str]):
    def apply(batches):
        for batch in batches_of(batches):
            data, offsets = bytes_of(batch.column("text"))
            lists = (batch.column(x).to_pylist() for x in ("_whole", "_keys", "_masks"))
            removed = _removed(data, offsets, *lists, bits, length, gram)
            begins = removed.copy()
            if len(begins):
                begins[1:] &= ~removed[:-1]
                heads = offsets[:-1][np.diff(offsets) > 0]
                begins[heads] = removed[heads]
            total, spans = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (removed, begins))
            # A character goes when one of its bytes does.
            lead = np.cumsum((data & 0xC0) != 0x80) - 1
            hurt = np.zeros(int(lead[-1]) + 1 if len(lead) else 0, dtype=bool)
            hurt[lead[removed]] = True
            stays = ~hurt[lead] if len(lead) else ~removed
            digests, texts = [], []
            valid = batch.column("text").is_valid().to_pylist()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                digests.append(hashlib.sha256(data[a:b][~removed[a:b]].tobytes()).hexdigest())
                texts.append(data[a:b][stays[a:b]].tobytes().decode() if valid[i] else None)
            columns = {
                "text": pa.array(texts, pa.string()),
                "n_bytes": pa.array(np.diff(offsets)),
                "n_removed": pa.array(np.diff(total).astype(np.int64)),
                "n_spans": pa.array(np.diff(spans).astype(np.int64)),
                "kept_sha256": pa.array(digests, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([columns.get(x) if x in columns else batch.column(x) for x in names], names=names)

    return apply


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    ``text`` becomes what is left (a character goes when one of its bytes does); added are ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept_sha256`` of the remaining bytes. Strings are judged on the input.
    Rows that share an id are one document, so they don't repeat each other. Rows without an id neither lose nor
    give strings. A null text stays null and counts as empty; texts shorter than ``length`` are kept. Columns named like
    the new ones are replaced.
    """
    if not 8 <= gram <= length <= gram + 62:
        raise ValueError("a gram has 8 bytes or more, and a window at most 62 more than its gram")
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*ADDED, "_whole", "_keys", "_masks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = bits_for(2 * size // (length - gram + 2), PER_BUCKET)
    found = texts.mapInArrow(_emit_runs(bits, length, gram), RUNS)
    found = stored(by_bucket(found, _match_runs, HITS), "runs")
    open_ = found.where("not whole").groupBy("doc_id").agg(F.collect_list("key").alias("open"))
    windows = texts.join(open_, "doc_id").select("doc_id", "text", "open").mapInArrow(_emit_open(bits, length, gram), OPEN)
    windows = stored(by_bucket(windows, _match_windows(length), "doc_id long, key long, mask long"), "windows")
    # A document's own hits are at most as many as its runs.
    hits = found.where("whole").select("doc_id", "key", F.lit(None).cast("long").alias("mask")).unionAll(windows)
    pairs = F.collect_list(F.when(F.col("mask").isNotNull(), F.struct("key", "mask")))
    hits = hits.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.when(F.col("mask").isNull(), F.col("key"))).alias("_whole"), pairs.alias("_pairs")
    )
    hits = hits.select("_id", "_whole", F.col("_pairs.key").alias("_keys"), F.col("_pairs.mask").alias("_masks"))
    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(ADDED, (LongType(), LongType(), LongType(), StringType())):
        schema = schema.add(name, kind)
    rows = docs.join(hits, docs["doc_id"] == hits["_id"], "left").drop("_id")
    return rows.mapInArrow(_apply(bits, length, gram, schema.names), schema)
