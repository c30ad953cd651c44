"""Catalog listings as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from stratiform.operators.gold import layer_counts


def databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES")


def tables(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN `{database}`").filter("NOT isTemporary").select("namespace", "tableName")


def inventory(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """``(table, nb_lignes, nb_colonnes)`` of every table of the databases given."""
    found = {
        f"{name}.{row.tableName}": spark.table(f"`{name}`.`{row.tableName}`")
        for name in names
        for row in tables(spark, name).collect()
    }
    return layer_counts(found)
