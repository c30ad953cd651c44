"""Quality controls and exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import explore, quality
from stratiform.operators.cleaning import retention
from stratiform.plans.fixtures import panel, silver_panel, table, with_panel
from stratiform.plans.registry import query

KEY_COLUMNS = ["matricule", "organisme", "code_organisme", "montant_brut", "montant_net", "absente"]
PRESENT = KEY_COLUMNS[:-1]


def _per_column(select: str, columns=PRESENT, tail: str = "") -> str:
    return " UNION ALL ".join(select.format(c=c) + " FROM panel" + tail for c in columns)


@query(
    "quality_null_rate",
    with_panel(
        ", r AS ("
        + _per_column("SELECT '{c}' AS colonne, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 1) AS pct_na")
        + ") SELECT colonne, pct_na, CASE WHEN pct_na > 5 THEN 'ALERTE' ELSE 'ok' END AS statut FROM r"
    ),
)
def quality_null_rate(spark, folder):
    return quality.null_rate(panel(spark, folder), KEY_COLUMNS)


@query(
    "quality_completeness",
    with_panel(
        ", r AS ("
        + _per_column("SELECT '{c}' AS colonne, round(100.0::DOUBLE * count({c}) / count(*), 1) AS pct_complet")
        + ") SELECT colonne, pct_complet, CASE WHEN pct_complet < 95 THEN 'ALERTE' ELSE 'ok' END AS statut FROM r"
    ),
)
def quality_completeness(spark, folder):
    return quality.completeness(panel(spark, folder), KEY_COLUMNS)


_BY_YEAR = _per_column(
    "SELECT substr(periode, 1, 4) AS annee, count(*) AS n, '{c}' AS colonne, "
    "round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 1) AS pct_na",
    tail=" GROUP BY substr(periode, 1, 4)",
)


@query("quality_null_by_year", with_panel(_BY_YEAR))
def quality_null_by_year(spark, folder):
    return quality.null_rate_by_year(panel(spark, folder), KEY_COLUMNS)


def _uneven(rows):
    """Service is recorded from 1997 on, the employer until 1999: both vary by year."""
    return rows.withColumns(
        {
            "service": F.when(F.col("periode") >= "1997_01", F.col("service")),
            "emploi": F.when(F.col("periode") < "2000_01", F.col("emploi")),
        }
    )


@query(
    "quality_suspect_columns",
    with_panel(
        """, uneven AS (
  SELECT substr(periode, 1, 4) AS annee, matricule, montant_brut,
         CASE WHEN periode >= '1997_01' THEN service END AS service,
         CASE WHEN periode < '2000_01' THEN emploi END AS emploi FROM panel
), rates AS ("""
        + " UNION ALL ".join(
            f"SELECT '{c}' AS colonne, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 1) AS pct "
            "FROM uneven GROUP BY annee"
            for c in ("matricule", "montant_brut", "service", "emploi")
        )
        + """) SELECT colonne, min(pct) AS min_pct_na, max(pct) AS max_pct_na FROM rates
GROUP BY colonne HAVING max(pct) > 95 AND min(pct) < 5"""
    ),
)
def quality_suspect_columns(spark, folder):
    columns = ["matricule", "montant_brut", "service", "emploi"]
    return quality.suspect_columns(_uneven(panel(spark, folder)), columns)


@query(
    "quality_duplicates",
    with_panel(
        "SELECT matricule, periode, count(*) AS n FROM panel WHERE matricule IS NOT NULL "
        "GROUP BY matricule, periode HAVING count(*) > 1"
    ),
)
def quality_duplicates(spark, folder):
    return quality.duplicate_keys(panel(spark, folder), ["matricule", "periode"], ["matricule"])


@query(
    "duplicate_keys_top",
    with_panel(
        "SELECT organisme, periode, count(*) AS nb FROM panel GROUP BY organisme, periode HAVING count(*) > 1 "
        "ORDER BY nb DESC, organisme NULLS FIRST, periode LIMIT 100"
    ),
)
def duplicate_keys_top(spark, folder):
    return quality.duplicate_keys_top(panel(spark, folder), ["organisme", "periode"])


@query(
    "quality_numeric_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS colonne, count({c}) AS nb_non_null, CAST(round(min({c}), 2) AS DOUBLE) AS min, "
        f"CAST(round(max({c}), 2) AS DOUBLE) AS max, round(avg({c}), 2) AS moyenne, "
        f"CAST(round(quantile_disc({c}, 0.5), 2) AS DOUBLE) AS mediane, count(*) FILTER ({c} < 0) AS nb_negatifs, "
        f"CASE WHEN count(*) FILTER ({c} < 0) > 0 THEN 'ALERTE' ELSE 'ok' END AS statut FROM customer"
        for c in ("c_acctbal", "c_nationkey")
    ),
)
def quality_numeric_stats(spark, folder):
    return quality.numeric_profile(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"])


@query(
    "quality_net_gt_gross",
    with_panel(
        "SELECT count(*) FILTER (montant_net > montant_brut) AS nb, "
        "round(100.0::DOUBLE * count(*) FILTER (montant_net > montant_brut) / count(*), 2) AS pct FROM panel"
    ),
)
def quality_net_gt_gross(spark, folder):
    return quality.net_above_gross(panel(spark, folder))


@query(
    "quality_distribution",
    with_panel(
        "SELECT situation, count(*) AS nb, "
        "round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM panel), 1) AS pct FROM panel GROUP BY situation"
    ),
)
def quality_distribution(spark, folder):
    return quality.distribution(panel(spark, folder), "situation")


@query(
    "quality_outliers",
    with_panel(
        """, q AS (
  SELECT quantile_cont(montant_net, 0.25) AS q1, quantile_cont(montant_net, 0.75) AS q3 FROM panel
), f AS (SELECT q1, q3, q1 - 0.05 * (q3 - q1) AS borne_basse, q3 + 0.05 * (q3 - q1) AS borne_haute FROM q)
SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(borne_basse, 4) AS borne_basse,
       round(borne_haute, 4) AS borne_haute, count(*) FILTER (montant_net < borne_basse) AS nb_bas,
       count(*) FILTER (montant_net > borne_haute) AS nb_haut
FROM panel, f GROUP BY q1, q3, borne_basse, borne_haute"""
    ),
)
def quality_outliers(spark, folder):
    # The amounts are spread evenly, so close fences are needed to catch any.
    found = quality.outliers(panel(spark, folder), "montant_net", reach=0.05)
    bounds = ["q1", "q3", "borne_basse", "borne_haute"]
    return found.withColumns({c: F.round(c, 4) for c in bounds})


@query(
    "filter_sql_retention",
    with_panel(
        "SELECT count(*) AS avant, count(*) FILTER (sexe = '2' AND montant_brut > 20000) AS apres, "
        "round(100.0::DOUBLE * count(*) FILTER (sexe = '2' AND montant_brut > 20000) / count(*), 1) "
        "AS pct_conserve FROM panel"
    ),
)
def filter_sql_retention(spark, folder):
    return retention(panel(spark, folder), "sexe = '2' AND montant_brut > 20000")


@query(
    "table_profile",
    with_panel(
        " UNION ALL ".join(
            f"SELECT '{name}' AS colonne, '{kind}' AS type, count(*) AS nb_lignes, count({name}) AS nb_non_null "
            "FROM panel"
            for name, kind in {
                "matricule": "string",
                "periode": "string",
                "sexe": "string",
                "situation": "string",
                "organisme": "string",
                "code_organisme": "int",
                "emploi": "string",
                "grade": "string",
                "service": "string",
                "montant_brut": "double",
                "montant_net": "double",
            }.items()
        )
    ),
)
def table_profile(spark, folder):
    return quality.table_profile(panel(spark, folder))


@query(
    "explore_summarize",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS sd, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM part"
        for c in ("p_size", "p_retailprice")
    ),
)
def explore_summarize(spark, folder):
    return explore.summarize(table(spark, folder, "part"), ["p_size", "p_retailprice"])


@query(
    "explore_tabulate",
    """
WITH f AS (SELECT event_type, count(*) AS freq FROM events GROUP BY event_type),
     t AS (SELECT count(*) AS n FROM events)
SELECT event_type, freq, round(100.0::DOUBLE * freq / n, 2) AS pct,
       round(100.0::DOUBLE * CAST(sum(freq) OVER (ORDER BY event_type) AS BIGINT) / n, 2) AS cum_pct FROM f, t""",
)
def explore_tabulate(spark, folder):
    return explore.tabulate(table(spark, folder, "events"), "event_type")


@query(
    "explore_histogram",
    """
SELECT CAST(CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 23
            ELSE 1 + floor((c_acctbal + 1000) / 500) END AS BIGINT) AS bin, count(*) AS freq
FROM customer GROUP BY 1""",
)
def explore_histogram(spark, folder):
    return explore.histogram(table(spark, folder, "customer"), "c_acctbal", -1000, 10000, 22)


@query(
    "explore_regress",
    """
SELECT CAST(regr_count(p_retailprice, p_size) AS BIGINT) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope,
       round(regr_intercept(p_retailprice, p_size), 6) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2
FROM part""",
)
def explore_regress(spark, folder):
    return explore.regress(table(spark, folder, "part"), "p_retailprice", "p_size")


# An iterative fit has no SQL form.
@query("explore_logit")
def explore_logit(spark, folder):
    rows = silver_panel(spark, folder).select(
        (F.col("montant_net") > F.col("montant_brut")).cast("int").alias("net_superieur"),
        (F.col("sexe") == "2").cast("int").alias("femme"),
        (F.col("montant_brut") / 10_000).alias("brut_10k"),
    )
    return explore.logit(rows, "net_superieur", ["femme", "brut_10k"])


@query("explore_regress_many")
def explore_regress_many(spark, folder):
    rows = silver_panel(spark, folder).select(
        "montant_net", "montant_brut", (F.col("sexe") == "2").cast("int").alias("femme")
    )
    return explore.regress_many(rows, "montant_net", ["montant_brut", "femme"])
