"""Reports over a header relation: one row per (period or file, column name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.session import checkpointed


def schema_drift(headers: DataFrame, period: str = "periode", column: str = "colonne") -> DataFrame:
    """Columns that appeared or disappeared between each two consecutive periods.

    Each header row is sent to the change before it and the change after it, so one
    aggregation finds the rows seen on one side only.
    """
    # Headers are few once distinct; stored, they are not derived again for the neighbours.
    pairs = checkpointed(headers.select(F.col(period).alias("p"), F.col(column).alias("colonne")).distinct())
    order = Window.orderBy("p")  # one row per period
    periods = pairs.select("p").distinct().select(
        "p", F.lag("p").over(order).alias("previous"), F.lead("p").over(order).alias("next")
    )
    sides = F.array(
        F.struct(F.col("previous").alias("p_avant"), F.col("p").alias("p_apres"), F.lit(1).alias("after")),
        F.struct(F.col("p").alias("p_avant"), F.col("next").alias("p_apres"), F.lit(0).alias("after")),
    )
    return (
        pairs.join(periods, "p")
        .select("colonne", F.explode(sides).alias("s"))
        .select("s.*", "colonne")
        .filter(F.col("p_avant").isNotNull() & F.col("p_apres").isNotNull())
        .groupBy("p_avant", "p_apres", "colonne")
        .agg(F.min("after").alias("first"), F.max("after").alias("last"))
        .filter(F.col("first") == F.col("last"))
        .select(
            "p_avant",
            "p_apres",
            F.when(F.col("last") == 1, "APPARUE").otherwise("DISPARUE").alias("type"),
            "colonne",
        )
    )


def distinct_columns(headers: DataFrame, column: str = "colonne") -> DataFrame:
    return headers.select(column).distinct()


def numeric_code_columns(headers: DataFrame, column: str = "colonne", whole: bool = True) -> DataFrame:
    """Distinct columns named by digits only (``whole``) or starting with digits."""
    pattern = "^[0-9]+$" if whole else "^[0-9]+"
    return distinct_columns(headers, column).filter(F.col(column).rlike(pattern))


def columns_per_period(headers: DataFrame, period: str = "periode", column: str = "colonne") -> DataFrame:
    return headers.groupBy(period).agg(F.count_distinct(column).alias("nb_colonnes"))


def column_count_stats(headers: DataFrame, period: str = "periode", column: str = "colonne") -> DataFrame:
    """Smallest, largest and mean number of columns over the periods."""
    return columns_per_period(headers, period, column).agg(
        F.min("nb_colonnes").alias("min_colonnes"),
        F.max("nb_colonnes").alias("max_colonnes"),
        F.round(F.avg("nb_colonnes"), 1).alias("moy_colonnes"),
    )


def columns_per_sheet(headers: DataFrame, period: str = "periode", sheet: str = "sheet_no") -> DataFrame:
    """Columns of the first and second sheet of each period's file."""

    def of(number: int):
        return F.count_if(F.col(sheet) == number).alias(f"nb_cols_f{number}")

    return headers.groupBy(period).agg(of(1), of(2))
