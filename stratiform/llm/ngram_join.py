"""N-gram Jaccard join: subsets of a fixed size for small sets, inverted lists for large ones, links checked exactly.

Shingles are put in one order for all documents: rare ones first, frequent ones by their number, the rest by hash. Of two sets that are similar enough,
the first tokens of both share at least one (lists) or two (subsets); Jaccard similarity fixes how many first tokens that
takes. A row of a list holds how many tokens its set has from there on: two documents meet in a list only if both have
as many left as a link between their sizes must share. Lists of one document are dropped where they arise. Documents are
then linked in rounds. While the lists hold many pairs, a round compares a document with a few leaders of each of its
lists, so a group of copies costs some rows a copy and not one a pair; documents that find others in most of their lists
lead, as the text that copies were made from does. The last round takes all pairs that meet and whose documents are
still in different components. All rounds drop pairs that can't be links by the parities of their sets, and check the others by
their whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm.graph import components
from stratiform.llm.packed import contains
from stratiform.llm.stored import discard, prepare, stored
from stratiform.llm.words import batches_of, grams, mixed, sequence_hash, word_hashes

SHINGLE = 5
#: Similarity as a fraction.
OVER, UNDER = 4, 5
SUBSET = 2
#: Tokens found so often within batches of documents count as frequent; so many of them are known to all tasks (8 MB).
#: Only the order of tokens depends on this, not which links are found.
FREQUENT, KNOWN = 8, 1 << 20
#: Largest size at which subsets may be tried, and the cost of meeting a document in a list against writing a row.
SMALL, MEET = 64, 0.5
#: Leaders of a list in a round, and leaders that a document tries. Lists with more than so many pairs a row get leaders;
#: another round follows while there are any, and the round before found more than one in so many of the rounds' links.
LEADERS, TRIED, MANY, GAIN = 3, 2, 2, 8
#: Slots of the table of documents that need checking; it spares the others' sets the shuffle.
SLOTS = 1 << 24
#: Steps of the number of documents that doubling it makes, when frequent tokens are put in order.
FINE = 4


def whole_sets(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingles of every row, sorted; a row of fewer words has its whole sequence, one without words nothing."""
    keys, first = word_hashes(column)
    every = grams(keys, n) >> np.uint64(1)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= n:
            out.append(np.unique(every[i : j - n + 1]))
        elif j > i:
            out.append(np.array([sequence_hash(keys[i:j]) >> np.uint64(1)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(tokens):
        return 0, 0
    size = np.uint64(len(tokens))
    a = mixed(np.array([np.bitwise_xor.reduce(mixed(tokens)) + size], dtype=np.uint64))
    b = mixed(np.array([np.add.reduce(mixed(tokens ^ np.uint64(0x5DEECE66D)))], dtype=np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _first_of_copies(ids: list, sets: list[np.ndarray], digests: list) -> list[int]:
    """Positions of one row for each distinct set with words and an id: the one with the smallest id."""
    best: dict = {}
    for i, (key, tokens, digest) in enumerate(zip(ids, sets, digests)):
        if key is not None and len(tokens) and (digest not in best or key < ids[best[digest]]):
            best[digest] = i
    return list(best.values())


def _parities(tokens: np.ndarray) -> bytes:
    """For each of as many slots as the set has tokens, or up to twice as many, whether an odd number of them falls there.

    Tokens that two sets share cancel out: their parities differ in no more slots than there are tokens in one set only.
    """
    slots = 1 << max(6, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Slots in which parities differ; those of the larger set are folded to as few slots as the other has."""
    x, y = sorted((x, y), key=len)
    slots, a, b = 8 * len(y), int.from_bytes(x, "little"), int.from_bytes(y, "little")
    while slots > 8 * len(x):
        slots //= 2
        b = (b >> slots) ^ (b & ((1 << slots) - 1))
    return (a ^ b).bit_count()


SIGNED = "doc_id long, n_shingles long, high long, low long, parities binary, tokens array<struct<token: long, n: long>>, met double"


#: Tokens that a task counts together, and the size that marks a row of counts among the signatures.
TOGETHER, COUNTS = 1 << 21, -1


def _sign(n: int):
    """Size and digest of every row, parities once for each distinct set of a batch, and rows of the tokens that a task has
    met repeatedly, in bounded groups."""

    def counted(held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        met = float((counts.astype(float) ** 2).sum()) / max(1, counts.sum())
        more = pa.StructArray.from_arrays(
            [pa.array(tokens[counts > 1].view(np.int64)), pa.array(counts[counts > 1].astype(np.int64))], names=["token", "n"]
        )
        more = pa.ListArray.from_arrays(pa.array([0, len(more)], pa.int32()), more)
        return row_of([None], [COUNTS], [0], [0], [None], more, [met])

    def row_of(ids, sizes, high, low, parities, tokens, met):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(high, pa.int64()),
                pa.array(low, pa.int64()),
                pa.array(parities, pa.binary()),
                tokens,
                pa.array(met, pa.float64()),
            ],
            names=["doc_id", "n_shingles", "high", "low", "parities", "tokens", "met"],
        )

    def sign(batches):
        held, seen = [], 0
        for batch in batches_of(batches):
            ids, sets = batch.column("doc_id").to_pylist(), whole_sets(batch.column("text"), n)
            digests = [_digest(x) for x in sets]
            first = _first_of_copies(ids, sets, digests)
            new, parities = [sets[i] for i in first], [None] * len(ids)
            for i in first:
                parities[i] = _parities(sets[i])
            held, seen = held + new, seen + sum(map(len, new))
            none = pa.nulls(len(ids), pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())])))
            high, low = [d[0] for d in digests], [d[1] for d in digests]
            yield row_of(ids, [len(x) for x in sets], high, low, parities, none, [None] * len(ids))
            if seen > TOGETHER:
                yield counted(held)
                held, seen = [], 0
        if held:
            yield counted(held)

    return sign


def least_shared(size):
    """Tokens that a set of this size shares with a similar one at least."""
    return -(-OVER * size // UNDER)


def boundary(sizes: dict[int, int], met: float) -> int:
    """Size up to which subsets cost less than lists: rows written, and documents met in the lists.

    ``sizes`` counts sets by size, ``met`` is the mean number of documents in a list.
    """
    def cost(limit: int) -> float:
        total = 0.0
        for size, count in sizes.items():
            first = size - least_shared(size) + SUBSET
            if size <= limit:
                total += count * first * (first - 1) / 2
            if size * UNDER >= limit * OVER:
                total += count * (first - 1) * (1 + MEET * met)
        return total

    return min(range(SMALL + 1), key=lambda limit: (cost(limit), limit))


LISTED = "token long, doc_id long, size int, room int, keys int"


def _list(n: int, limit: int, frequent):
    """Rows of the lists: first tokens of large sets, pairs of first tokens of small ones.

    ``room`` is the most tokens that a set can share with one it first meets in this list, ``keys`` the number of its rows.
    """

    def emit(batches):
        known, level = frequent.value
        for batch in batches_of(batches):
            ids, sets = batch.column("doc_id").to_pylist(), whole_sets(batch.column("text"), n)
            digests = [_digest(x) for x in sets]
            keys, docs, sizes, rooms, totals = [], [], [], [], []
            for i in _first_of_copies(ids, sets, digests):
                tokens, size = sets[i], len(sets[i])
                rank = np.where(contains(known, tokens), level[np.minimum(np.searchsorted(known, tokens), len(level) - 1)], 0)
                ordered = tokens[np.argsort(rank, kind="stable")]
                first = size - least_shared(size) + 1
                parts = []
                if size * UNDER >= limit * OVER or size < SUBSET:
                    parts.append((ordered[:first], size - np.arange(first)))
                if SUBSET <= size <= limit:
                    head = ordered[: first + 1]
                    a, b = np.triu_indices(len(head), 1)
                    parts.append((mixed(head[a] * np.uint64(0x9E3779B97F4A7C15) + head[b]), size - b + SUBSET - 1))
                total = sum(len(part) for part, _ in parts)
                for part, room in parts:
                    keys.append(part)
                    docs.append(np.full(len(part), ids[i], dtype=np.int64))
                    sizes.append(np.full(len(part), size, dtype=np.int32))
                    rooms.append(room.astype(np.int32))
                    totals.append(np.full(len(part), total, dtype=np.int32))
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(join(keys, np.uint64).view(np.int64)),
                    pa.array(join(docs, np.int64)),
                    pa.array(join(sizes, np.int32)),
                    pa.array(join(rooms, np.int32)),
                    pa.array(join(totals, np.int32)),
                ],
                names=["token", "doc_id", "size", "room", "keys"],
            )

    return emit


def _shared_only(batches):
    """Of rows sorted by token, those whose token has another row; holds one batch, and the last row of the one before."""
    held, held_same = None, False
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        token = rows.column("token").to_numpy()
        follows = token[1:] == token[:-1]
        same = np.concatenate([[held_same], follows])
        keep = same.copy()
        keep[:-1] |= follows
        yield rows.slice(0, len(rows) - 1).filter(pa.array(keep[:-1]))
        held, held_same = rows.slice(len(rows) - 1), bool(same[-1])
    if held is not None and held_same:
        yield held


def _sets_of(n: int, wanted):
    """Sets of the rows whose id may need checking, once for each distinct set of a batch."""

    def emit(batches):
        slots = wanted.value
        for batch in batches_of(batches):
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            place = _slot(batch.column("doc_id").fill_null(0))
            asked = (slots[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            part = batch.filter(pa.array(known & asked))
            sets = whole_sets(part.column("text"), n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["doc_id", "tokens"],
            )

    return emit


def _slot(ids: pa.Array) -> np.ndarray:
    return (mixed(ids.to_numpy().astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def _slots_of(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column("doc_id"))))], names=["slot"])


def _check(batches):
    """Pairs that are similar enough by their whole sets."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x_tokens"), batch.column("y_tokens")):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(UNDER * both >= OVER * (len(x) + len(y) - both))
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def _can_link(batches):
    """Pairs whose parities differ in no more slots than the sets of a link of their sizes have tokens apart."""
    for batch in batches:
        keep = []
        for x_size, y_size, x, y in zip(*(batch.column(c).to_pylist() for c in ("x_size", "y_size", "x_parities", "y_parities"))):
            least = -(-OVER * (x_size + y_size) // (OVER + UNDER))
            keep.append(differing(x, y) <= x_size + y_size - 2 * least)
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (``x``, ``y``) of representatives that can be links by the parities of their sets; loses no link.

    Parities take a bit or two a token, so whole sets move for few pairs besides the links.
    """
    side = lambda name: classes.select(
        F.col("rep").alias(name), F.col("n_shingles").alias(f"{name}_size"), F.col("parities").alias(f"{name}_parities")
    )
    return pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_can_link, "x long, y long").distinct()


def checked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """The pairs (``x``, ``y``) of representatives that are links, as ``a`` and ``b``."""
    spark = docs.sparkSession
    pairs = stored(possible(pairs.select("x", "y"), classes), "pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    slots = ids.mapInArrow(_slots_of, "slot long")
    slots = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")
    )
    # As many rows as the table has words at most: 262,144.
    slots = slots.toArrow()
    table = np.zeros(SLOTS // 64, dtype=np.int64)
    table[slots.column("word").to_numpy()] = slots.column("bits").to_numpy()
    wanted = spark.sparkContext.broadcast(table.view(np.uint8))
    sets = docs.select("doc_id", "text").mapInArrow(_sets_of(n, wanted), "doc_id long, tokens binary")
    sets = stored(sets.join(ids, "doc_id", "left_semi").distinct(), "sets")
    rows = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("tokens").alias("x_tokens")), "x")
    rows = rows.join(sets.select(F.col("doc_id").alias("y"), F.col("tokens").alias("y_tokens")), "y")
    rows = rows.select("x", "y", "x_tokens", "y_tokens").mapInArrow(_check, "x long, y long")
    rows = stored(rows.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "checked")
    discard(pairs, sets)
    wanted.unpersist()
    return rows


def _round(size: Column, part: tuple[int, int]) -> Column:
    """The whole part of size times a fraction, rounded up."""
    return F.floor((size * part[0] + part[1] - 1) / part[1])


def _can_meet(a_size: str, a_room: str, b_size: str, b_room: str) -> Column:
    """Whether two documents can be linked if they first meet in this list, by their sizes and what is left of them.

    With the least size and the most room of a component, whether any of its documents can.
    """
    need = _round(F.col(a_size) + F.col(b_size), (OVER, OVER + UNDER))
    return (F.col(a_room) >= need) & (F.col(b_room) >= need)


def _with_leaders(held: DataFrame, number: int) -> DataFrame:
    """Pairs of a document and a leader of its lists that share several of them and aren't linked yet.

    Leaders are the documents of a list that find others in most of their lists, weighed by chance but for the first one
    of the first round: weights change with each round but not with the list, so the same few documents lead all lists
    of a group of copies.
    """
    near = F.floor(F.log("size") / F.log(F.lit(UNDER / OVER))).alias("near")
    rows = held.where(F.col("pairs") > MANY).withColumn("near", near)

    def order(i: int) -> Column:
        chance = F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(1 << 20)) / (1 << 20)
        return F.col("central") * (1.0 if i == 0 else 0.5 + chance / 2)

    row = F.struct("doc_id", "component", "size", "room")
    most = [F.max_by(row, F.struct(order(number * LEADERS + i), F.xxhash64("doc_id"))) for i in range(LEADERS)]
    leaders = rows.groupBy("token", "near").agg(F.array(*most).alias("most"), F.count("*").alias("n")).where("n > 1")
    leaders = leaders.select("token", "near", F.explode(F.array_distinct("most")).alias("l"))
    leaders = leaders.select("token", "near", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("doc_id", "component", "size", "room")])
    rows = rows.join(leaders, ["token", "near"])
    rows = rows.where((F.col("component") != F.col("l_component")) & _can_meet("size", "room", "l_size", "l_room"))
    rows = rows.groupBy(F.col("l_doc_id").alias("x"), F.col("doc_id").alias("y")).agg(F.count("*").alias("n"))
    # A document tries the leaders that share most with it; the last round misses none of the others.
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", "x")), asc=False), 1, TRIED)
    rows = rows.groupBy("y").agg(best.alias("best")).select("y", F.explode("best.x").alias("x"))
    return rows.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _with_components(held: DataFrame, found: DataFrame) -> DataFrame:
    held = held.drop("component").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return held.withColumn("component", F.coalesce("component", "doc_id"))


def _open_lists(held: DataFrame) -> DataFrame:
    """Rows of the lists that hold more than one component, with the pairs of a list for each row that can meet its like.

    The smaller document of a pair that can meet lies early enough to meet one of its own size; those are counted.
    """
    early = F.when(_can_meet("size", "room", "size", "room"), 1.0).otherwise(0.0)
    parts = held.groupBy("token", "component").agg(F.sum(early).alias("n"))
    total, same = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    lists = parts.groupBy("token").agg(F.count("*").alias("parts"), total.alias("early"), ((total * total - same) / 2).alias("pairs"))
    lists = lists.where("parts > 1 and early > 0").select("token", (F.col("pairs") / F.col("early")).alias("pairs"))
    return stored(held.drop("pairs").join(lists, "token"), "open")


def _between(held: DataFrame) -> DataFrame:
    """Pairs of documents that differ in component and can be linked if they first meet in a list that both are in.

    Components meet first and their documents then, so those of a large component are never set against each other.
    """
    groups = held.groupBy("token", "component").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max("room").alias("room"))
    side = lambda df, name, *keep: df.select("token", *[F.col(c).alias(f"{name}_{c}") for c in keep])
    near = lambda large, small: F.col(large) * UNDER >= F.col(small) * OVER
    row = ["component", "least", "most", "room"]
    met = side(groups, "a", *row).join(side(groups, "b", *row), "token")
    met = met.where((F.col("a_component") < F.col("b_component")) & near("a_most", "b_least") & near("b_most", "a_least"))
    met = met.where(_can_meet("a_least", "a_room", "b_least", "b_room")).select("token", "a_component", "b_component", "b_least", "b_most", "b_room")
    row = ["component", "doc_id", "size", "room"]
    # The documents of the first component that can meet the second one, and then the documents of the second one.
    a = side(held, "a", *row).withColumnsRenamed({"a_room": "a_left"})
    rows = met.join(a, ["token", "a_component"])
    rows = rows.where(near("a_size", "b_least") & near("b_most", "a_size") & _can_meet("a_size", "a_left", "b_least", "b_room"))
    b = side(held, "b", *row).withColumnsRenamed({"b_room": "b_left"})
    rows = rows.join(b, ["token", "b_component"])
    rows = rows.where(near("a_size", "b_size") & near("b_size", "a_size") & _can_meet("a_size", "a_left", "b_size", "b_left"))
    return rows.select(F.least("a_doc_id", "b_doc_id").alias("x"), F.greatest("a_doc_id", "b_doc_id").alias("y")).distinct()


def link_documents(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Signatures of all rows: ``doc_id, n_shingles, component_id``, one row for each input row.

    Documents are linked when the Jaccard similarity of their shingle sets is 0.8 or more; the component is the smallest
    id that links reach. Words are lower-cased for A-Z. Null, empty and blank texts have an empty set and are linked
    with nothing; a text of fewer words has one shingle. Rows without an id are linked with nothing and have no
    component. Rows that share an id count as one document: what links one of them links the id. Other columns are not
    read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(_sign(n), SIGNED), "signatures")
    counts, signed = signed.where(F.col("n_shingles") == COUNTS), signed.where(F.col("n_shingles") != COUNTS)
    key = ["n_shingles", "high", "low"]
    classes = signed.where("doc_id is not null and n_shingles > 0").groupBy(*key).agg(
        F.min("doc_id").alias("rep"), F.first("parities", ignorenulls=True).alias("parities")
    )
    classes = stored(classes, "classes")

    frequent = counts.select(F.inline("tokens")).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = frequent.orderBy(F.col("n").desc(), "token").limit(KNOWN).orderBy("token").toArrow()
    # The last entry stands for no token: shingles have 63 bits.
    known = np.append(frequent.column("token").to_numpy(), -1).astype(np.uint64)
    level = np.append(np.minimum(63, 1 + FINE * np.log2(frequent.column("n").to_numpy() / FREQUENT + 1)), 0).astype(np.uint8)
    frequent = spark.sparkContext.broadcast((known, level))
    sizes = classes.groupBy(F.least("n_shingles", F.lit(4 * SMALL)).alias("size")).agg(F.count("*").alias("n")).collect()
    met = counts.agg(F.avg("met"), F.count("met")).first()
    mean = 1 + max(0.0, (met[0] or 1.0) - 1) * (met[1] or 1)
    limit = boundary({row["size"]: row["n"] for row in sizes}, mean)

    lists = docs.mapInArrow(_list(n, limit, frequent), LISTED)
    lists = lists.repartition("token").sortWithinPartitions("token").mapInArrow(_shared_only, LISTED)
    # A class stands in the lists by its representative only.
    ids = signed.where("doc_id is not null and n_shingles > 0").join(classes.select(*key, "rep"), key).select("doc_id", "rep").distinct()
    several = ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    same = ids.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = same.join(several.select(F.col("doc_id").alias("a")), "a", "left_semi").unionAll(several.select("a", "b"))
    lists = lists.join(ids, "doc_id").select("token", F.col("rep").alias("doc_id"), "size", "room", "keys").distinct()
    lists = stored(lists, "lists")
    # Share of a document's lists that hold others, too.
    central = lists.groupBy("doc_id").agg((F.count("*") / F.max("keys")).alias("central"))
    held = _open_lists(lists.drop("keys").join(central, "doc_id").withColumn("component", F.col("doc_id")))
    discard(lists)

    # Rounds of leaders: each document of a long list against a few of them, among documents of about its size.
    links, number, gained = stored(same, "same"), 0, 0
    while not held.where(F.col("pairs") > MANY).isEmpty():
        fresh = checked(docs, _with_leaders(held, number), classes, n)
        merged, new = stored(links.unionAll(fresh).distinct(), "links"), fresh.count()
        before, links = held, merged
        held, number, gained = _open_lists(_with_components(held, components(links))), number + 1, gained + new
        discard(before, fresh)
        if new * GAIN <= gained:
            break

    # Last round: all pairs of different components that can be linked.
    links = stored(checked(docs, _between(held), classes, n).unionAll(links), "links")
    discard(held)
    found = components(links)

    reps = classes.join(found, classes["rep"] == found["node"], "left")
    reps = reps.select(*key, F.coalesce("component", "rep").alias("component"))
    out = signed.join(reps, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with its smallest id; of rows that share that id, one.

    Rows without an id and texts without words are all kept.
    """
    linked = link_documents(docs, n).where("n_shingles > 0 and doc_id is not null")
    dropped = linked.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = linked.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    out = docs.join(dropped, "doc_id", "left_anti")
    once = out.join(repeated.select("doc_id"), "doc_id", "left_semi")
    once = once.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).dropDuplicates(["doc_id"])
    blank = ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rest = out.join(repeated.select("doc_id", F.lit(True).alias("_again")), "doc_id", "left")
    rest = rest.where(F.col("_again").isNull() | blank).drop("_again")
    return rest.unionByName(once)
