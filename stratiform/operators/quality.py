"""Quality controls. Each family reads the table once, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.functions.casts import percent
from stratiform.functions.names import existing
from stratiform.operators.quantiles import exact_quantiles

ALERT, OK = "ALERTE", "ok"


def alert(condition: Column) -> Column:
    """``ALERTE`` when the condition holds; unknown (empty table) counts as ``ok``."""
    return F.when(condition, ALERT).otherwise(OK)


def _counts(df: DataFrame, columns: Sequence[str], by: Sequence[Column] = ()) -> DataFrame:
    """One row per column (and group): all rows, and rows with a value."""
    grouped = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nb_total"), *[F.count(F.col(f"`{c}`")).alias(f"n:{c}") for c in columns]
    )
    groups = [name for name in grouped.columns if name != "nb_total" and not name.startswith("n:")]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("colonne"), F.col(f"`n:{c}`").alias("nb_non_null"))
            for c in columns
        ]
    )
    return grouped.select(*groups, "nb_total", F.inline(rows))


def null_rate(df: DataFrame, columns: Sequence[str], threshold: float = 5.0, digits: int = 1) -> DataFrame:
    """``(colonne, pct_na, statut)``; columns the table lacks are skipped."""
    missing = F.col("nb_total") - F.col("nb_non_null")
    return (
        _counts(df, existing(columns, df.columns))
        .select("colonne", percent(missing, F.col("nb_total"), digits).alias("pct_na"))
        .withColumn("statut", alert(F.col("pct_na") > threshold))
    )


def completeness(df: DataFrame, columns: Sequence[str], threshold: float = 95.0, digits: int = 1) -> DataFrame:
    """``(colonne, pct_complet, statut)``."""
    return (
        _counts(df, existing(columns, df.columns))
        .select("colonne", percent(F.col("nb_non_null"), F.col("nb_total"), digits).alias("pct_complet"))
        .withColumn("statut", alert(F.col("pct_complet") < threshold))
    )


def null_rate_by_year(df: DataFrame, columns: Sequence[str], period: str = "periode", digits: int = 1) -> DataFrame:
    """``(annee, n, colonne, pct_na)`` for each year of a ``YYYY_MM`` period."""
    missing = F.col("nb_total") - F.col("nb_non_null")
    return _counts(df, existing(columns, df.columns), [F.substring(period, 1, 4).alias("annee")]).select(
        "annee",
        F.col("nb_total").alias("n"),
        "colonne",
        percent(missing, F.col("nb_total"), digits).alias("pct_na"),
    )


def suspect_columns(
    df: DataFrame, columns: Sequence[str], period: str = "periode", high: float = 95.0, low: float = 5.0
) -> DataFrame:
    """Columns nearly empty in one year and nearly full in another."""
    return (
        null_rate_by_year(df, columns, period)
        .groupBy("colonne")
        .agg(F.min("pct_na").alias("min_pct_na"), F.max("pct_na").alias("max_pct_na"))
        .filter((F.col("max_pct_na") > high) & (F.col("min_pct_na") < low))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str], required: Sequence[str] = (), count: str = "n") -> DataFrame:
    """Key combinations that occur more than once; rows lacking a ``required`` key are ignored."""
    rows = df.dropna(subset=list(required)) if required else df
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)


def duplicate_keys_top(df: DataFrame, keys: Sequence[str], k: int = 100) -> DataFrame:
    """The ``k`` most repeated combinations, null keys included; ties go by key order."""
    keys = existing(keys, df.columns)
    return duplicate_keys(df, keys, count="nb").orderBy(F.desc("nb"), *keys).limit(k)


def numeric_profile(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000, digits: int = 2) -> DataFrame:
    """Non-null count, min, max, mean, sketched median and negatives of each column, in one scan."""
    columns = existing(columns, df.columns)
    measures = {
        "nb_non_null": F.count,
        "min": lambda c: F.round(F.min(c).cast("double"), digits),
        "max": lambda c: F.round(F.max(c).cast("double"), digits),
        "moyenne": lambda c: F.round(F.avg(c), digits),
        "mediane": lambda c: F.round(F.percentile_approx(c, 0.5, accuracy).cast("double"), digits),
        "nb_negatifs": lambda c: F.count_if(c < 0),
    }
    wide = df.agg(
        *[make(F.col(f"`{c}`")).alias(f"{name}:{c}") for c in columns for name, make in measures.items()]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("colonne"), *[F.col(f"`{name}:{c}`").alias(name) for name in measures])
            for c in columns
        ]
    )
    return wide.select(F.inline(rows)).withColumn("statut", alert(F.col("nb_negatifs") > 0))


def net_above_gross(df: DataFrame, net: str = "montant_net", gross: str = "montant_brut") -> DataFrame:
    """Rows whose net amount exceeds the gross one, and their share of all rows."""
    return df.agg(
        F.count_if(F.col(net) > F.col(gross)).alias("nb"), F.count(F.lit(1)).alias("_all")
    ).select("nb", percent(F.col("nb"), F.col("_all"), 2).alias("pct"))


def distribution(df: DataFrame, category: str, digits: int = 1) -> DataFrame:
    """Rows and share of all rows for each value of a category."""
    counted = df.groupBy(category).agg(F.count(F.lit(1)).alias("nb"))
    everything = counted.agg(F.sum("nb")).scalar()  # of the counted groups: no second scan
    return counted.withColumn("pct", percent(F.col("nb"), everything, digits))


def outliers(df: DataFrame, column: str, keys: Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """Quartiles, fences ``reach`` interquartile ranges away, and values beyond them."""
    keys = list(keys)
    quartiles = exact_quantiles(df, keys, column, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    fences = quartiles.withColumns(
        {"borne_basse": F.col("q1") - reach * spread, "borne_haute": F.col("q3") + reach * spread}
    )
    values = df.select(*keys, F.col(column).alias("_v"))
    if keys:
        named = fences.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = values[keys[0]].eqNullSafe(named[f"_{keys[0]}"])
        for key in keys[1:]:
            same = same & values[key].eqNullSafe(named[f"_{key}"])
        fenced = values.join(named, same)
    else:
        fence = fences.select(F.struct("*").alias("f")).scalar()
        fenced = values.withColumn("_f", fence).select("_v", "_f.*")
    bounds = ["q1", "q3", "borne_basse", "borne_haute"]
    return fenced.groupBy(*keys, *bounds).agg(
        F.count_if(F.col("_v") < F.col("borne_basse")).alias("nb_bas"),
        F.count_if(F.col("_v") > F.col("borne_haute")).alias("nb_haut"),
    )


def table_profile(df: DataFrame) -> DataFrame:
    """``(colonne, type, nb_lignes, nb_non_null)`` of every column, in one scan."""
    types = F.create_map(*[F.lit(part) for name, kind in df.dtypes for part in (name, kind)])
    return _counts(df, df.columns).select(
        "colonne", types[F.col("colonne")].alias("type"), F.col("nb_total").alias("nb_lignes"), "nb_non_null"
    )
