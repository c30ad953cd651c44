"""Gold tables and exploration aggregates over the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import gold
from stratiform.plans.fixtures import SILVER_SQL, panel, silver_panel, table, with_panel
from stratiform.plans.registry import query


def _total(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


def _mean(column: str) -> str:
    return f"{_total(column)} / count({column})"


@query(
    "gold_payroll_mass",
    with_panel(
        f"""
SELECT periode, substr(periode, 1, 4) AS annee, substr(periode, 6, 2) AS mois,
       coalesce(CAST(code_organisme AS VARCHAR), 'NON_CODE') AS code_organisme,
       coalesce(organisme, 'NON_IDENTIFIE') AS organisme, situation_normalisee,
       count(*) AS nb_lignes, count(DISTINCT matricule) AS nb_agents_uniques,
       round({_total("montant_brut")}, 0) AS masse_brute, round({_total("montant_net")}, 0) AS masse_nette,
       round({_mean("montant_brut")}, 0) AS salaire_brut_moyen, round({_mean("montant_net")}, 0) AS salaire_net_moyen,
       round(quantile_disc(montant_brut, 0.5), 0) AS salaire_brut_mediane,
       round(quantile_disc(montant_net, 0.5), 0) AS salaire_net_mediane
FROM panel WHERE montant_brut IS NOT NULL AND montant_net IS NOT NULL
GROUP BY ALL""",
        SILVER_SQL,
    ),
)
def gold_payroll_mass(spark, folder):
    return gold.payroll_mass(silver_panel(spark, folder))


@query(
    "gold_headcount",
    with_panel(
        """
SELECT periode, substr(periode, 1, 4) AS annee, substr(periode, 6, 2) AS mois, situation_normalisee,
       coalesce(CAST(code_organisme AS VARCHAR), 'NON_CODE') AS code_organisme,
       count(*) AS nb_lignes, count(DISTINCT matricule) AS nb_agents_uniques,
       count(*) FILTER (sexe = '1') AS nb_hommes, count(*) FILTER (sexe = '2') AS nb_femmes
FROM panel GROUP BY ALL""",
        SILVER_SQL,
    ),
)
def gold_headcount(spark, folder):
    return gold.headcount_by_sex(silver_panel(spark, folder))


@query(
    "gold_by_organisation",
    with_panel(
        "SELECT organisme, count(*) AS nb_employes, count(DISTINCT emploi) AS nb_emplois_distincts, "
        "count(DISTINCT grade) AS nb_grades_distincts FROM panel GROUP BY organisme"
    ),
)
def gold_by_organisation(spark, folder):
    distinct = {"nb_emplois_distincts": "emploi", "nb_grades_distincts": "grade"}
    return gold.headcount(panel(spark, folder), ["organisme"], distinct)


@query(
    "gold_by_grade",
    with_panel(
        "SELECT grade, count(*) AS nb_employes, count(DISTINCT organisme) AS nb_organismes FROM panel GROUP BY grade"
    ),
)
def gold_by_grade(spark, folder):
    return gold.headcount(panel(spark, folder), ["grade"], {"nb_organismes": "organisme"})


@query(
    "gold_by_service",
    with_panel(
        "SELECT service, organisme, count(*) AS nb_employes, count(DISTINCT emploi) AS nb_emplois "
        "FROM panel GROUP BY service, organisme"
    ),
)
def gold_by_service(spark, folder):
    return gold.headcount(panel(spark, folder), ["service", "organisme"], {"nb_emplois": "emploi"})


@query(
    "gold_by_step",
    with_panel(
        'SELECT emploi || \'/\' || sexe AS "CLASSE/ECHELON", grade, count(*) AS nb_employes FROM panel GROUP BY ALL'
    ),
)
def gold_by_step(spark, folder):
    rows = panel(spark, folder).select(F.concat_ws("/", "emploi", "sexe").alias("CLASSE/ECHELON"), "grade")
    return gold.headcount(rows, ["CLASSE/ECHELON", "grade"])


@query(
    "gold_category_totals",
    with_panel(
        f"SELECT service, count(*) AS nb_lignes, round({_total('montant_net')}, 0) AS total_valeur, "
        f"round({_mean('montant_net')}, 2) AS valeur_moyenne FROM panel GROUP BY service"
    ),
)
def gold_category_totals(spark, folder):
    return gold.category_totals(panel(spark, folder), "service", "montant_net")


@query(
    "gold_generic",
    with_panel(
        f"SELECT periode, service, count(*) AS nb, {_total('montant_brut')} AS total, "
        f"{_mean('montant_brut')} AS moyenne, quantile_disc(montant_brut, 0.5) AS mediane "
        "FROM panel GROUP BY periode, service"
    ),
)
def gold_generic(spark, folder):
    return gold.aggregate(panel(spark, folder), ["periode", "service"], "montant_brut")


@query(
    "gold_exact_median",
    with_panel(
        f"SELECT sexe, situation, count(*) AS nb, {_total('montant_brut')} AS total, "
        f"{_mean('montant_brut')} AS moyenne, round(quantile_cont(montant_brut, 0.5), 4) AS mediane "
        "FROM panel GROUP BY sexe, situation"
    ),
)
def gold_exact_median(spark, folder):
    rows = gold.aggregate_exact_median(panel(spark, folder), ["sexe", "situation"], "montant_brut")
    return rows.withColumn("mediane", F.round("mediane", 4))


@query(
    "gold_year_region",
    f"""
SELECT CAST(year(o_orderdate) AS BIGINT) AS annee, r_name AS region, count(*) AS nb,
       {_total("o_totalprice")} AS total, round({_mean("o_totalprice")}, 2) AS moyenne
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def gold_year_region(spark, folder):
    orders, customer, nation, region = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    rows = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.year("o_orderdate").cast("bigint").alias("annee"), F.col("r_name").alias("region"), "o_totalprice")
    )
    return gold.yearly_means(rows, ["annee", "region"], "o_totalprice")


@query(
    "gold_monthly_evolution",
    with_panel(
        """, monthly AS (
  SELECT periode, sum(CAST(montant_net AS DECIMAL(18,2))) AS t FROM panel GROUP BY periode
), pairs AS (SELECT periode, t, lag(t) OVER (ORDER BY periode) AS before FROM monthly)
SELECT periode, CAST(t AS DOUBLE) AS total, CAST(t - before AS DOUBLE) AS variation,
       round(100.0::DOUBLE * CAST(t - before AS DOUBLE) / CAST(before AS DOUBLE), 2) AS variation_pct FROM pairs"""
    ),
)
def gold_monthly_evolution(spark, folder):
    return gold.monthly_evolution(panel(spark, folder), "montant_net")


@query(
    "explore_group",
    with_panel(
        f"SELECT organisme, count(*) AS nb_lignes, {_mean('montant_net')} AS moyenne, "
        f"{_total('montant_net')} AS total FROM panel WHERE periode >= '1998_01' AND sexe = '2' GROUP BY organisme"
    ),
)
def explore_group(spark, folder):
    condition = "periode >= '1998_01' AND sexe = '2'"
    return gold.filtered_totals(panel(spark, folder), condition, "organisme", "montant_net")


@query(
    "panel_summary",
    with_panel(
        "SELECT min(periode) AS premiere, max(periode) AS derniere, count(DISTINCT periode) AS nb_periodes, "
        "count(DISTINCT matricule) AS agents_uniques FROM panel"
    ),
)
def panel_summary(spark, folder):
    return gold.panel_summary(panel(spark, folder))


@query(
    "layer_counts",
    with_panel(
        """
SELECT 'bronze' AS "table", count(*) AS nb_lignes, CAST(11 AS BIGINT) AS nb_colonnes FROM panel
UNION ALL SELECT 'silver', count(*), 12 FROM panel WHERE situation IN (' En  activité ', 'Demi-solde')
UNION ALL SELECT 'gold', count(DISTINCT service), 4 FROM panel"""
    ),
)
def layer_counts(spark, folder):
    rows = panel(spark, folder)
    return gold.layer_counts(
        {
            "bronze": rows,
            "silver": silver_panel(spark, folder),
            "gold": gold.category_totals(rows, "service", "montant_net"),
        }
    )
