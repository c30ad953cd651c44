"""Silver filters, deduplication and retention counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions.casts import percent


def keep_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def keep_positive(df: DataFrame, amount: str) -> DataFrame:
    return df.filter(F.col(amount) > 0)


def keep_categories(df: DataFrame, column: str, categories: Iterable[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(categories)))


def drop_null_rows(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how=how, subset=subset)


def empty_columns(df: DataFrame) -> DataFrame:
    """Columns without any value: ``drop_null_rows`` over them would empty the table."""
    counted = df.agg(*[F.count(F.col(f"`{name}`")).alias(name) for name in df.columns])
    return counted.unpivot([], counted.columns, "colonne", "nb_non_null").filter("nb_non_null = 0").select("colonne")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each distinct row, nulls equal to each other.

    Rows are dealt by all their columns before any is dropped. Of mostly distinct rows a reading task would otherwise hold
    its whole share, widened by the joins before, in a hash table that spares the shuffle next to nothing.
    """
    return df.repartition(*(F.col(f"`{name}`") for name in df.columns)).dropDuplicates()


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row of each key under an explicit order.

    The rank filter lets Spark keep one candidate per key inside every map task, so a key
    that holds a large part of all rows is reduced before the shuffle.
    """
    ranked = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def retention(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows before and after a filter and the share kept, in one scan."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.agg(
        F.count(F.lit(1)).alias("avant"),
        F.count_if(condition).alias("apres"),
    ).withColumn("pct_conserve", percent(F.col("apres"), F.col("avant"), 1))


def sql_over(sql: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text over DataFrames; each is written ``{name}`` in the text."""
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(sql, **frames)
