"""Exact distinct counts over cubes and rolling months, running totals over many tasks, and history from snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.operators.enrich import lookup_join
from stratiform.operators.gold import money
from stratiform.session import checkpointed


def _numbered_agents(cells: DataFrame) -> DataFrame:
    """``agent, number``: agents of one first cell have neighbouring numbers, so bitmaps of a cell are few and full.

    Numbers are dense within a task's range, which is all that bitmaps ask for; they are fixed by the checkpoint.
    """
    agents = cells.where("agent IS NOT NULL").groupBy("agent").agg(F.min("cell").alias("home"))
    ordered = agents.repartitionByRange("home", "agent").sortWithinPartitions("home", "agent")
    return checkpointed(ordered.select("agent", F.monotonically_increasing_id().alias("number")))


def cube_agents(df: DataFrame, dims: Sequence[str], agent: str, amounts: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct agents and totals of every combination of ``dims``, from the finest cells to the whole table.

    ``dims``, ``niveau`` (the bits of the dimensions that are summed over, the first one highest, which tells a null
    value from a total), ``nb_lignes``, ``nb_agents`` and ``total_<amount>``. Rows without an agent count as rows only; an
    empty table gives an empty cube.

    Detail rows are shuffled once, folded to one row a cell and agent. Agents then get numbers, and what goes up the levels
    are bitmaps of 32,768 agents each: levels merge them, where a distinct count would repeat every detail row for
    every level. A large cell is as many bitmaps as its agents need, merged in as many tasks.
    """
    dims = list(dims)
    names = [f"d{i}" for i in range(len(dims))]
    keys = [F.col(f"`{name}`").alias(short) for name, short in zip(dims, names)]
    sums = [f"t{i}" for i in range(len(amounts))]
    rows = df.select(*keys, F.col(f"`{agent}`").alias("agent"), *[money(F.col(f"`{a}`")).alias(t) for a, t in zip(amounts, sums)])
    folded = rows.groupBy(*names, "agent").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in sums])
    cells = checkpointed(folded.select(F.struct(*names).alias("cell"), "agent", "n", *sums))
    placed = cells.join(_numbered_agents(cells), "agent", "left")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    added = [F.sum(name).alias(name) for name in ("n", *sums)]
    base = placed.groupBy("cell", F.bitmap_bucket_number("number").alias("bucket")).agg(bits, *added)
    base = base.select("cell.*", "bucket", "bits", *["n", *sums])

    kept = [list(some) for size in range(len(names), -1, -1) for some in combinations(names, size)]
    level = sum((F.grouping(name).cast("long") * (1 << place) for place, name in enumerate(reversed(names))), F.lit(0).cast("long"))
    merged = base.groupingSets([[*some, "bucket"] for some in kept], *names, "bucket")
    merged = merged.agg(level.alias("niveau"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("agents"), *added)
    out = merged.groupBy(*names, "niveau").agg(F.sum("agents").alias("nb_agents"), *added)
    totals = [F.col(t).cast("double").alias(f"total_{a}") for a, t in zip(amounts, sums)]
    return out.select(*[F.col(s).alias(d) for d, s in zip(dims, names)], "niveau", F.col("n").alias("nb_lignes"), "nb_agents", *totals)


def month_number(period: Column) -> Column:
    """Months since year 0 of a ``YYYY_MM`` period; null for other text."""
    year, month = (F.substring(period, *place).try_cast("int") for place in ((1, 4), (6, 2)))
    return F.when(month.between(1, 12), year * 12 + month - 1)


def rolling_agents(df: DataFrame, dims: Sequence[str], agent: str, period: str = "periode", months: int = 12) -> DataFrame:
    """Distinct agents of each month and of the last ``months`` months, for every month from a group's first to its last.

    ``dims``, ``periode``, ``nb_agents`` and ``nb_agents_<months>``. Months without a row are reported, too. Rows without an agent
    or a valid period are left out; null dimensions are groups of their own; an empty table gives an empty one.

    A month of an agent counts until ``months`` later or until the agent's next month, whichever comes first, so that each
    agent counts once in every frame: the distinct counts become sums of changes. Rows are reduced to one a group, agent and month before
    they are shuffled; windows are over the months of one agent, and over the months of one group after all agents were added up.
    """
    dims = list(dims)
    names = [f"d{i}" for i in range(len(dims))]
    keys = [F.col(f"`{name}`").alias(short) for name, short in zip(dims, names)]
    rows = df.select(*keys, F.col(f"`{agent}`").alias("agent"), month_number(F.col(f"`{period}`")).alias("month"))
    rows = rows.where("agent IS NOT NULL AND month IS NOT NULL").distinct()
    following = F.lead("month").over(Window.partitionBy(*names, "agent").orderBy("month"))
    until = F.least(F.col("month") + months, following)  # a missing next month leaves the other
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def change(month: Column, by: Column, own: Column) -> Column:
        return F.struct(month.alias("month"), by.alias("by"), own.alias("own"))

    spans = rows.withColumn("until", until)
    steps = F.array(change(F.col("month"), one, one), change(F.col("until"), -one, none))
    steps = spans.select(*names, F.inline(steps))
    calendar = rows.groupBy(*names).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    calendar = calendar.select(*names, F.explode(F.sequence("a", "b")).alias("month"), none.alias("by"), none.alias("own"))
    each = steps.unionByName(calendar).groupBy(*names, "month").agg(F.sum("by").alias("by"), F.sum("own").alias("own"))
    group = Window.partitionBy(*names)
    last = F.max(F.when(F.col("own") > 0, F.col("month"))).over(group)
    out = each.select(*names, "month", "own", F.sum("by").over(group.orderBy("month")).alias("held"), last.alias("last"))
    named = F.format_string("%04d_%02d", F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1).alias("periode")
    return out.where("month <= last").select(
        *[F.col(s).alias(d) for d, s in zip(dims, names)], named, F.col("own").alias("nb_agents"), F.col("held").alias(f"nb_agents_{months}")
    )


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one by ``order``, nulls first; rows of one place get the same.

    The rows are sorted over many tasks; a total is the sum within its task's range, and the sums of the ranges before.
    """
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{order}`").alias("place"), F.col(f"`{value}`").alias("value"))
    ranged = checkpointed(rows.orderBy("place").withColumn("part", F.spark_partition_id()))
    ranges = ranged.groupBy("part").agg(F.sum("value").alias("held"))
    # One row for each task of the sort.
    before = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("value").over(Window.partitionBy("part").orderBy("place"))
    out = lookup_join(ranged.withColumn("within", within), ranges, "part")
    return out.select("row.*", (F.coalesce("within", F.lit(0)) + F.col("before")).alias(name))


def snapshot_history(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """When each row came and went, from full loads that follow each other.

    ``columns``, ``nb_exemplaires``, ``valable_depuis`` and ``valable_jusqu``: the row stood that many times in every load from the
    first one up to, but without, the second, which is null for rows of the last load. A row that goes and comes back has
    two entries, as has one whose number of copies changes. Loads are the distinct values of ``load`` in their order; rows without one
    are left out; nulls are equal to each other.

    Copies are counted before the shuffle, and a window holds the loads of one row, never those of a key or of a load.
    """
    names = [f"c{i}" for i in range(len(columns))]
    rows = df.select(F.col(f"`{load}`").alias("load"), *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)])
    rows = rows.where("load IS NOT NULL").groupBy("load", *names).agg(F.count(F.lit(1)).alias("copies"))
    # One row a load: windows over a calendar.
    order = Window.orderBy("load")
    loads = rows.select("load").distinct()
    loads = checkpointed(loads.select("load", F.row_number().over(order).alias("number"), F.lead("load").over(order).alias("next")))
    placed = lookup_join(rows, loads, "load", how="inner")
    state = [*names, "copies"]
    island = F.col("number") - F.row_number().over(Window.partitionBy(*state).orderBy("number"))
    spells = placed.withColumn("island", island).groupBy(*state, "island").agg(
        F.min("load").alias("valable_depuis"), F.max_by("next", "number").alias("valable_jusqu")
    )
    named = [F.col(n).alias(c) for c, n in zip(columns, names)]
    return spells.select(*named, F.col("copies").alias("nb_exemplaires"), "valable_depuis", "valable_jusqu")


def at_load(history: DataFrame, load) -> DataFrame:
    """The rows of one load, as ``snapshot_history`` recorded them, with their copies."""
    at = F.lit(load)
    held = history.where((F.col("valable_depuis") <= at) & (F.col("valable_jusqu").isNull() | (F.col("valable_jusqu") > at)))
    columns = [name for name in held.columns if name not in ("nb_exemplaires", "valable_depuis", "valable_jusqu")]
    times = F.explode(F.sequence(F.lit(1), F.col("nb_exemplaires").cast("int"))).alias("time")
    return held.select(F.struct(*[F.col(f"`{name}`") for name in columns]).alias("row"), times).select("row.*")
