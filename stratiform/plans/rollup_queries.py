"""Cubes, rolling months, history from loads and the payroll controls, over the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators.headers import union_all
from stratiform.operators.rollup import cube_agents, rolling_agents, running_total, snapshot_history
from stratiform.plans import jobs
from stratiform.plans.fixtures import SILVER_SQL, panel, silver_panel, table, with_panel
from stratiform.plans.registry import query


@query(
    "gold_cube",
    with_panel(
        """
SELECT periode, organisme, situation, GROUPING(periode, organisme, situation) AS niveau, count(*) AS nb_lignes,
       count(DISTINCT matricule) AS nb_agents, CAST(sum(CAST(montant_net AS DECIMAL(18,2))) AS DOUBLE) AS total_montant_net
FROM panel GROUP BY CUBE (periode, organisme, situation)"""
    ),
)
def gold_cube(spark, folder):
    """Rows, agents and net pay of every period, organisation and situation, and of all their totals."""
    return cube_agents(panel(spark, folder), ["periode", "organisme", "situation"], "matricule", ["montant_net"])


@query(
    "rolling_agents",
    with_panel(
        """, present AS (SELECT DISTINCT organisme, emploi, matricule,
    CAST(substr(periode, 1, 4) AS INTEGER) * 12 + CAST(substr(periode, 6, 2) AS INTEGER) - 1 AS mois FROM panel),
bounds AS (SELECT organisme, emploi, min(mois) AS a, max(mois) AS b FROM present GROUP BY ALL),
calendar AS (SELECT organisme, emploi, unnest(range(a, b + 1)) AS mois FROM bounds)
SELECT c.organisme, c.emploi, printf('%04d_%02d', c.mois // 12, c.mois % 12 + 1) AS periode,
       count(DISTINCT CASE WHEN p.mois = c.mois THEN matricule END) AS nb_agents, count(DISTINCT matricule) AS nb_agents_12
FROM calendar c LEFT JOIN present p ON c.organisme IS NOT DISTINCT FROM p.organisme AND c.emploi IS NOT DISTINCT FROM p.emploi
  AND p.mois BETWEEN c.mois - 11 AND c.mois
GROUP BY c.organisme, c.emploi, c.mois"""
    ),
)
def agents_of_twelve_months(spark, folder):
    """Agents of a month and of the twelve up to it, per organisation and job, months without pay included."""
    return rolling_agents(panel(spark, folder), ["organisme", "emploi"], "matricule")


@query(
    "snapshot_history",
    with_panel(
        """, rows_ AS (SELECT substr(periode, 1, 4) AS annee, matricule, situation, organisme, count(*) AS n FROM panel GROUP BY ALL),
loads AS (SELECT annee, row_number() OVER (ORDER BY annee) AS k FROM (SELECT DISTINCT annee FROM rows_)),
placed AS (SELECT r.*, k, k - row_number() OVER (PARTITION BY matricule, situation, organisme, n ORDER BY k) AS island
  FROM rows_ r JOIN loads USING (annee)),
spells AS (SELECT matricule, situation, organisme, n AS nb_exemplaires, min(annee) AS valable_depuis, max(k) AS k
  FROM placed GROUP BY matricule, situation, organisme, n, island)
SELECT matricule, situation, organisme, nb_exemplaires, valable_depuis, l.annee AS valable_jusqu
FROM spells s LEFT JOIN loads l ON l.k = s.k + 1"""
    ),
)
def history_of_loads(spark, folder):
    """When each agent's situation came and went, from the loads of each year."""
    rows = panel(spark, folder).withColumn("annee", F.substring("periode", 1, 4))
    return snapshot_history(rows, "annee", ["matricule", "situation", "organisme"])


@query(
    "running_totals",
    """
SELECT o_orderdate AS jour, count(*) AS nb, CAST(sum(count(*)) OVER (ORDER BY o_orderdate) AS BIGINT) AS cumul
FROM orders GROUP BY o_orderdate""",
)
def orders_up_to_each_day(spark, folder):
    """Orders of each day and of all days up to it."""
    days = table(spark, folder, "orders").groupBy(F.col("o_orderdate").alias("jour")).agg(F.count("*").alias("nb"))
    return running_total(days, "jour", "nb", "cumul")


_WATCHED = ("organisme", "montant_brut")


@query(
    "validate_payroll",
    with_panel(
        """, n AS (SELECT count(*) AS n, count(organisme) AS organisme, count(matricule) AS matricule FROM panel)
SELECT 'completude_colonnes_cles' AS rapport, 'matricule' AS cle, round(100.0::DOUBLE * matricule / n, 1) AS valeur FROM n
UNION ALL SELECT 'completude_colonnes_cles', 'organisme', round(100.0::DOUBLE * organisme / n, 1) FROM n
UNION ALL SELECT 'doublons_matricule_periode', matricule || ' ' || periode, CAST(count(*) AS DOUBLE) FROM panel
  GROUP BY matricule, periode HAVING count(*) > 1
UNION ALL SELECT 'coherence_montants', NULL, round(100.0::DOUBLE * count(*) FILTER (montant_net > montant_brut) / count(*), 2) FROM panel
UNION ALL SELECT 'distribution', situation_normalisee, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM panel), 1)
  FROM panel GROUP BY situation_normalisee
UNION ALL SELECT 'resume', min(periode) || ' ' || max(periode), CAST(count(DISTINCT matricule) AS DOUBLE) FROM panel""",
        SILVER_SQL,
    ),
)
def validate_payroll(spark, folder):
    """The payroll controls, one line each; no watched column is suspect here, so that report is empty."""
    reports = jobs.validate_payroll(silver_panel(spark, folder), ["matricule", "organisme"], _WATCHED)
    line = {
        "completude_colonnes_cles": (F.col("colonne"), F.col("pct_complet")),
        "na_par_annee_colonnes_surveillees": (F.col("colonne"), F.col("pct_na")),
        "doublons_matricule_periode": (F.concat_ws(" ", "matricule", "periode"), F.col("n")),
        "coherence_montants": (F.lit(None).cast("string"), F.col("pct")),
        "distribution": (F.col("situation_normalisee"), F.col("pct")),
        "resume": (F.concat_ws(" ", "premiere", "derniere"), F.col("agents_uniques")),
    }
    return union_all(
        [
            report.select(F.lit(name).alias("rapport"), line[name][0].alias("cle"), line[name][1].cast("double").alias("valeur"))
            for name, report in reports.items()
        ]
    )
