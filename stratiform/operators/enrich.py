"""Dictionary enrichment and left joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.functions.casts import percent
from stratiform.functions.text import normalize_label
from stratiform.operators.cleaning import first_per_key
from stratiform.operators.headers import union_all
from stratiform.session import checkpointed

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def _row_bytes() -> Column:
    """Size of a row as text, which is what a dictionary row mostly is."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")


def lookup_join(
    big: DataFrame, small: DataFrame, on, how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Broadcast ``small`` only when its rows and bytes prove it small; else a shuffled join."""
    size = small.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), _row_bytes()).first()
    if size["rows"] <= max_rows and size["bytes"] <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def load_dictionary(
    table: DataFrame, label_candidates: Sequence[str], code: str | None = None, row_order: str = "row_no"
) -> DataFrame:
    """``(libelle_norm, code)``: first row per normalised label, in the order of the sheet.

    The label column is the first candidate present; the code is the first column unless named.
    """
    label = next((name for name in label_candidates if name in table.columns), None)
    if label is None:
        raise ValueError(f"none of the label columns {list(label_candidates)} is present")
    code = code or table.columns[0]
    keyed = table.select(
        normalize_label(F.col(f"`{label}`")).alias("libelle_norm"),
        F.col(f"`{code}`").alias("code"),
        F.col(row_order).alias("_row"),
    ).filter(F.col("libelle_norm").isNotNull())
    return first_per_key(keyed, ["libelle_norm"], ["_row", "code"]).drop("_row")


@dataclass(frozen=True)
class CodeLookup:
    """Adds ``code_column`` by matching ``source_column`` against a dictionary."""

    code_column: str
    source_column: str
    dictionary: DataFrame


def _load_all(lookups: Sequence[CodeLookup], max_rows: int) -> tuple[DataFrame | None, set[str]]:
    """All dictionaries as one stored table, and the names of those small enough to broadcast."""
    if not lookups:
        return None, set()
    parts = [
        lookup.dictionary.select(
            F.lit(lookup.code_column).alias("_dict"), "libelle_norm", F.col("code").cast("string").alias("code")
        )
        for lookup in lookups
    ]
    stored = checkpointed(union_all(parts))
    sizes = stored.groupBy("_dict").agg(F.count(F.lit(1)).alias("rows"), _row_bytes())
    small = sizes.filter((F.col("rows") <= max_rows) & (F.col("bytes") <= BROADCAST_BYTES))
    return stored, {row["_dict"] for row in small.collect()}  # one row per dictionary


def enrich_codes(df: DataFrame, lookups: Sequence[CodeLookup], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One left join per dictionary on the normalised label.

    Each source column is normalised once. A column already named like a code column
    (ignoring case) is kept under ``<name>_src``; an absent source gives null codes.
    """
    added = {lookup.code_column.lower() for lookup in lookups}
    out = df.withColumnsRenamed({name: f"{name}_src" for name in df.columns if name.lower() in added})
    sources = {lookup.source_column for lookup in lookups if lookup.source_column in out.columns}
    out = out.withColumns({f"_key_{s}": normalize_label(F.col(f"`{s}`")) for s in sorted(sources)})
    stored, small = _load_all([lookup for lookup in lookups if lookup.source_column in sources], max_rows)
    for lookup in lookups:
        name, key = lookup.code_column, f"_key_{lookup.source_column}"
        if lookup.source_column not in sources:
            out = out.withColumn(name, F.lit(None).cast("string"))
            continue
        codes = stored.filter(F.col("_dict") == name).select(F.col("libelle_norm").alias(key), F.col("code").alias(name))
        out = out.join(F.broadcast(codes) if name in small else codes, key, "left")
    return out.drop(*[f"_key_{s}" for s in sources])


def match_rates(df: DataFrame, code_columns: Sequence[str], digits: int = 1) -> DataFrame:
    """``(code, nb_total, nb_trouves, taux)`` of every enrichment, in one scan."""
    total = F.col("`*`")
    counted = df.agg(
        F.count(F.lit(1)).alias("*"), *[F.count(F.col(f"`{c}`")).alias(c) for c in code_columns]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("code"), F.col(f"`{c}`").alias("nb_trouves")) for c in code_columns]
    )
    return counted.select(total.alias("nb_total"), F.inline(rows)).select(
        "code", "nb_total", "nb_trouves", percent(F.col("nb_trouves"), F.col("nb_total"), digits).alias("taux")
    )


def join_reference(df: DataFrame, reference: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join on common columns; Spark chooses the strategy from the sizes."""
    return df.join(reference, on, "left")


def join_sheets(
    first: DataFrame, second: DataFrame, file: str, left_key: Column, right_key: Column, suffix: str = "_F2"
) -> DataFrame:
    """Left join of the two sheets of each file; columns of the second sheet get a suffix.

    The file is part of the join key, so rows of different files never meet, and one key
    value that is common to many files does not become one hot join key.
    """
    left = first.withColumn("_key", left_key)
    right = second.withColumn("_key", right_key).select(
        F.col(file).alias("_file"),
        "_key",
        *[F.col(f"`{name}`").alias(name + suffix) for name in second.columns if name != file],
    )
    matched = (left[file] == right["_file"]) & (left["_key"] == right["_key"])
    return left.join(right, matched, "left").drop(left["_key"], right["_key"], right["_file"])


def apply_value_labels(
    df: DataFrame, labels: DataFrame, columns: Sequence[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Replace codes by labels from a ``(variable, code, label)`` table; unlabelled codes stay."""
    out = df
    for name in columns:
        small = labels.filter(F.col("variable") == name).select(
            F.col("code").cast("string").alias("_code"), F.col("label").alias("_label")
        )
        keyed = out.withColumn("_code", F.col(f"`{name}`").cast("string"))
        joined = lookup_join(keyed, small, "_code", max_rows=max_rows)
        out = joined.withColumn(name, F.coalesce("_label", "_code")).drop("_label", "_code")
    return out.select(df.columns)


def default_nulls(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    return df.withColumns(
        {name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(text)) for name, text in defaults.items()}
    )
