"""Header operators: one projection each, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions.names import STANDARD_COLUMNS, clean_names, dedupe_names, map_names
from stratiform.functions.text import file_name, file_stem, metadata_path


def normalize_headers(df: DataFrame, style: str = "ascii", start: int = 1) -> DataFrame:
    """Clean and unique names; ``style`` is ``ascii``, ``prefix_strip`` or ``light``."""
    return df.toDF(*clean_names(df.columns, style, start))


def dedupe_headers(df: DataFrame, start: int = 1, pattern: str = "{}_{}") -> DataFrame:
    return df.toDF(*dedupe_names(df.columns, start, pattern))


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the listed columns; absent sources are ignored."""
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def map_columns(
    df: DataFrame, mapping: Mapping[str, list[str]] = STANDARD_COLUMNS
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Standard names, and the ``(source, standard)`` correspondence that was applied."""
    pairs = map_names(df.columns, dict(mapping))
    return df.toDF(*[standard for _, standard in pairs]), pairs


def correspondence_report(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "nom_source string, nom_standard string")


def suffix_columns(df: DataFrame, suffix: str, keep: Iterable[str] = ()) -> DataFrame:
    keep = set(keep)
    return df.toDF(*[name if name in keep else name + suffix for name in df.columns])


def add_provenance(
    df: DataFrame,
    path: str = "_metadata.file_path",
    period: str = "PERIODE",
    source: str = "FICHIER_SOURCE",
    ingested_on: str | None = None,
) -> DataFrame:
    """Period (file stem) and source file name of each row; optionally the ingestion date."""
    origin = metadata_path(path) if path.startswith("_metadata") else F.col(path)
    added = df.select("*", file_stem(origin).alias(period), file_name(origin).alias(source))
    if ingested_on is not None:
        added = added.withColumn("DATE_INGESTION", F.lit(ingested_on).cast("date"))
    return added


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name over all columns seen; a column a frame lacks is null there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)
