"""Exact quantiles that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 5_000
SMALL_GROUP = 100_000
SLICES = 256


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    accuracy: int = SKETCH_ACCURACY,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of ``quantiles``.

    1. A sketch of bounded size gives, per group and quantile, two values that enclose it.
       Its rank error is at most ``n / accuracy``; the enclosing ranks are twice that away,
       which is wide enough for groups above ``small_group`` rows. Smaller groups take all
       their rows.
    2. Rows below the enclosed band are only counted, rows above are dropped, equal values
       are combined before the shuffle.
    3. The band is cut in slices. Their counts tell which slice, or two, hold the ranks
       looked for; only the values of those are put in order.
    """
    names = list(quantiles)
    small_group = max(small_group, 4 * accuracy)  # below this the sketch promises too little
    margin = 2.0 / accuracy
    # As one struct, null keys are equal to each other in joins, too.
    group = F.struct(*keys) if keys else F.struct(F.lit(True).alias("_all"))
    rows = df.filter(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v"))

    def edge(shift: float):
        at = [F.lit(min(1.0, max(0.0, q + shift))) for q in quantiles.values()]
        return F.percentile_approx("v", F.array(*at), accuracy)

    sketch = rows.groupBy("g").agg(F.count("v").alias("n"), edge(-margin).alias("low"), edge(margin).alias("high"))
    large = F.col("n") > small_group
    bands = F.array(
        *[
            F.struct(
                F.lit(name).alias("q"),
                F.when(large, F.col("low")[i]).alias("low"),
                F.when(large, F.col("high")[i]).alias("high"),
                ((F.col("n") - 1) * F.lit(float(q))).alias("rank"),
            )
            for i, (name, q) in enumerate(quantiles.items())
        ]
    )
    if keys:
        with_bands = rows.join(sketch.select("g", bands.alias("bands")), "g")
    else:
        with_bands = rows.withColumn("bands", sketch.select(bands).scalar())

    v, low, high = F.col("v"), F.col("b.low"), F.col("b.high")
    below = v < low
    slice_of = F.when(below, -1).otherwise(F.coalesce(F.width_bucket(v, low, high, F.lit(SLICES)), F.lit(0)))
    reached = F.filter("bands", lambda b: b["high"].isNull() | (F.col("v") <= b["high"]))
    place = ["g", "q", "rank"]
    counted = (
        with_bands.select("g", "v", F.explode(reached).alias("b"))
        .select("g", "b.q", "b.rank", slice_of.alias("slice"), F.when(below, None).otherwise(v).alias("v"))
        .groupBy(*place, "slice", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    first, last = F.floor("rank"), F.ceil("rank")
    upto = F.sum("n").over(Window.partitionBy(*place).orderBy("slice"))  # few slices per group
    slices = (
        counted.groupBy(*place, "slice")
        .agg(F.sum("c").alias("n"))
        .withColumn("before", upto - F.col("n"))
        .filter((F.col("before") + F.col("n") > first) & (F.col("before") <= last))
        .select("g", "q", "slice", "before")
    )
    in_slice = Window.partitionBy(*place, "slice").orderBy("v")
    found = (
        counted.join(slices, ["g", "q", "slice"])
        .withColumn("upto", F.col("before") + F.sum("c").over(in_slice))
        .groupBy(*place)
        .agg(
            F.min(F.when(F.col("upto") > first, F.col("v"))).alias("a"),
            F.min(F.when(F.col("upto") > last, F.col("v"))).alias("b"),
        )
    )
    at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - first)
    wide = found.groupBy("g").agg(*[F.max(F.when(F.col("q") == name, at)).alias(name) for name in names])
    return wide.select(*[F.col("g")[key].alias(key) for key in keys], *names)
