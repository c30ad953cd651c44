"""Gold aggregates. Nothing is sorted here: order is a matter of presentation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions.casts import period_parts
from stratiform.operators.enrich import default_nulls
from stratiform.operators.headers import union_all
from stratiform.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class GoldSpec:
    """A Gold product: target table, how to build it from Silver, and its export file."""

    table: str
    build: Callable[[DataFrame], DataFrame]
    csv: str | None = None


def money(column: Column | str) -> Column:
    """Amounts to four decimals: their sum is exact, so it does not depend on the order of the rows."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(22,4)")


def total(column: str) -> Column:
    return F.sum(money(column)).cast("double")


def mean(column: str) -> Column:
    return F.try_divide(total(column), F.count(column).cast("double"))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def headcount(df: DataFrame, dims: Sequence[str], distinct: Mapping[str, str] | None = None) -> DataFrame:
    """Rows per group, and distinct values of the columns in ``distinct`` (output -> column)."""
    return df.groupBy(*[F.col(f"`{d}`") for d in dims]).agg(
        F.count(F.lit(1)).alias("nb_employes"),
        *[F.count_distinct(F.col(f"`{column}`")).alias(name) for name, column in (distinct or {}).items()],
    )


def category_totals(df: DataFrame, category: str, amount: str) -> DataFrame:
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("nb_lignes"),
        F.round(total(amount), 0).alias("total_valeur"),
        F.round(mean(amount), 2).alias("valeur_moyenne"),
    )


def aggregate(df: DataFrame, dims: Sequence[str], amount: str, accuracy: int = 10_000) -> DataFrame:
    """Count, total, mean and sketched median of one amount over any dimensions."""
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("nb"),
        total(amount).alias("total"),
        mean(amount).alias("moyenne"),
        F.percentile_approx(amount, 0.5, accuracy).alias("mediane"),
    )


def aggregate_exact_median(df: DataFrame, dims: Sequence[str], amount: str) -> DataFrame:
    """As ``aggregate`` with the interpolated median of all rows of each group."""
    counted = df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("nb"), total(amount).alias("total"), mean(amount).alias("moyenne")
    )
    medians = exact_quantiles(df, dims, amount, {"mediane": 0.5})
    joined = counted.join(medians, same_keys(counted, medians, dims), "left")
    return joined.select(*[counted[c] for c in counted.columns], "mediane")


PAYROLL_DEFAULTS = {"code_organisme": "NON_CODE", "organisme": "NON_IDENTIFIE"}
PAYROLL_KEYS = ["periode", "code_organisme", "organisme", "situation_normalisee"]


def payroll_mass(silver: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Rows, distinct agents, gross and net totals, means and medians.

    Agents are folded first, with the additive measures, so that the second step counts
    them exactly. The medians are sketched in an aggregation of their own: in the same one,
    Spark would keep a sketch per agent and group. Year and month follow from the period,
    so they are not part of the grouping key.
    """
    paid = default_nulls(silver.dropna(subset=["montant_brut", "montant_net"]), PAYROLL_DEFAULTS)
    per_agent = paid.groupBy(*PAYROLL_KEYS, "matricule").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(money("montant_brut")).alias("brut"),
        F.sum(money("montant_net")).alias("net"),
    )
    brut, net, rows = (F.sum(c).cast("double") for c in ("brut", "net", "n"))
    sums = per_agent.groupBy(*PAYROLL_KEYS).agg(
        F.sum("n").alias("nb_lignes"),
        F.count("matricule").alias("nb_agents_uniques"),
        F.round(brut, 0).alias("masse_brute"),
        F.round(net, 0).alias("masse_nette"),
        F.round(brut / rows, 0).alias("salaire_brut_moyen"),
        F.round(net / rows, 0).alias("salaire_net_moyen"),
    )
    medians = paid.groupBy(*PAYROLL_KEYS).agg(
        F.round(F.percentile_approx("montant_brut", 0.5, accuracy), 0).alias("salaire_brut_mediane"),
        F.round(F.percentile_approx("montant_net", 0.5, accuracy), 0).alias("salaire_net_mediane"),
    )
    joined = sums.join(medians, same_keys(sums, medians, PAYROLL_KEYS)).select(
        *[sums[name] for name in sums.columns], "salaire_brut_mediane", "salaire_net_mediane"
    )
    return period_parts(joined)


def headcount_by_sex(silver: DataFrame) -> DataFrame:
    keys = ["periode", "situation_normalisee", "code_organisme"]
    counted = default_nulls(silver, {"code_organisme": "NON_CODE"}).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nb_lignes"),
        F.count_distinct("matricule").alias("nb_agents_uniques"),
        F.count_if(F.col("sexe") == "1").alias("nb_hommes"),
        F.count_if(F.col("sexe") == "2").alias("nb_femmes"),
    )
    return period_parts(counted)


def filtered_totals(df: DataFrame, condition: Column | str, group: str, amount: str) -> DataFrame:
    """Exploration query: count, mean and total of the rows that satisfy a condition."""
    return df.filter(condition).groupBy(group).agg(
        F.count(F.lit(1)).alias("nb_lignes"), mean(amount).alias("moyenne"), total(amount).alias("total")
    )


def yearly_means(df: DataFrame, dims: Sequence[str], amount: str) -> DataFrame:
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("nb"), total(amount).alias("total"), F.round(mean(amount), 2).alias("moyenne")
    )


def monthly_evolution(df: DataFrame, amount: str, period: str = "periode") -> DataFrame:
    """Total per period, change from the period before, and relative change in percent."""
    monthly = df.groupBy(period).agg(F.sum(money(amount)).alias("t"))
    before = F.lag("t").over(Window.orderBy(period))  # one row per period
    change = F.col("t") - before
    return monthly.select(
        period,
        F.col("t").cast("double").alias("total"),
        change.cast("double").alias("variation"),
        F.round(F.try_divide(F.lit(100.0) * change.cast("double"), before.cast("double")), 2).alias("variation_pct"),
    )


def panel_summary(df: DataFrame, entity: str = "matricule", period: str = "periode") -> DataFrame:
    """First and last period, distinct periods and entities, in one pass.

    Every row gives its period and its entity as two short rows, which a hash table folds to one a value before they are
    shuffled. Text minima beside distinct counts would have Spark sort three copies of all rows in the reading tasks.
    """
    no_period, no_entity = (F.lit(None).cast(df.schema[name].dataType) for name in (period, entity))
    parts = F.array(
        F.struct(F.lit(True).alias("is_period"), F.col(period).alias("period"), no_entity.alias("entity")),
        F.struct(F.lit(False).alias("is_period"), no_period.alias("period"), F.col(entity).alias("entity")),
    )
    values = df.select(F.inline(parts)).distinct()
    return values.agg(
        F.min("period").alias("premiere"),
        F.max("period").alias("derniere"),
        F.count("period").alias("nb_periodes"),
        F.count("entity").alias("agents_uniques"),
    )


def layer_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, nb_lignes, nb_colonnes)`` of each product."""
    return union_all(
        df.agg(F.count(F.lit(1)).alias("nb_lignes")).select(
            F.lit(name).alias("table"), "nb_lignes", F.lit(len(df.columns)).cast("long").alias("nb_colonnes")
        )
        for name, df in layers.items()
    )
