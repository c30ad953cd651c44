"""Dictionary enrichment, sheet joins and header reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import drift, enrich
from stratiform.operators.headers import union_all
from stratiform.plans.fixtures import panel, period_of, table, with_panel
from stratiform.plans.registry import query


def _dictionary(rows, code: str, label: str):
    """Two copies of every label, spelled differently; the first copy holds the valid code."""
    accented = F.translate(F.lower(label), "aeio", "àéîô")
    copies = F.array(
        F.struct(F.col(code).alias("code"), F.concat(F.lit("("), accented, F.lit(").")).alias("libelle"), F.lit(1).alias("row_no")),
        F.struct(F.lit("doublon").alias("code"), F.concat(F.lit("  "), label, F.lit(" -")).alias("libelle"), F.lit(2).alias("row_no")),
    )
    return enrich.load_dictionary(rows.select(F.inline(copies)), ["LIBELLÉ", "libelle"])


def _lookups(spark, folder):
    nation, part, customer = (table(spark, folder, name) for name in ("nation", "part", "customer"))
    organisations = nation.filter("n_nationkey % 5 != 4").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label")
    )
    jobs = part.select(F.concat(F.lit("E-"), "p_brand").alias("code"), F.col("p_brand").alias("label"))
    grades = part.select(F.concat(F.lit("G-"), "p_type").alias("code"), F.col("p_type").alias("label"))
    services = customer.select(F.substring("c_mktsegment", 1, 3).alias("code"), F.col("c_mktsegment").alias("label"))
    grades = grades.filter("label != 'PROMO'")
    tables = {
        ("CODE_ORGANISME", "organisme"): organisations,
        ("CODE_EMPLOI", "emploi"): jobs.distinct(),
        ("CODE_GRADE", "grade"): grades.distinct(),
        ("CODE_SERVICE", "service"): services.distinct(),
        ("CODE_FONCTION", "fonction"): grades.distinct(),
    }
    return [
        enrich.CodeLookup(code, source, _dictionary(rows, "code", "label"))
        for (code, source), rows in tables.items()
    ]


def _enriched(spark, folder):
    return enrich.enrich_codes(panel(spark, folder), _lookups(spark, folder))


_ENRICHED_SQL = """, enriched AS (
  SELECT matricule, periode, montant_net, panel.code_organisme AS code_organisme_src,
         CASE WHEN n_nationkey % 5 != 4 THEN CAST(n_nationkey AS VARCHAR) END AS "CODE_ORGANISME",
         'E-' || emploi AS "CODE_EMPLOI", CASE WHEN grade != 'PROMO' THEN 'G-' || grade END AS "CODE_GRADE",
         substr(service, 1, 3) AS "CODE_SERVICE", CAST(NULL AS VARCHAR) AS "CODE_FONCTION"
  FROM panel LEFT JOIN nation ON organisme = n_name)
"""
_CODES = ["CODE_ORGANISME", "CODE_EMPLOI", "CODE_GRADE", "CODE_SERVICE", "CODE_FONCTION"]


@query("enrich_codes", with_panel(_ENRICHED_SQL + "SELECT * FROM enriched"))
def enrich_codes(spark, folder):
    return _enriched(spark, folder).select("matricule", "periode", "montant_net", "code_organisme_src", *_CODES)


@query(
    "match_rates",
    with_panel(
        _ENRICHED_SQL
        + " UNION ALL ".join(
            f"SELECT '{c}' AS code, count(*) AS nb_total, count(\"{c}\") AS nb_trouves, "
            f'round(100.0::DOUBLE * count("{c}") / count(*), 1) AS taux FROM enriched'
            for c in _CODES
        )
    ),
)
def match_rates(spark, folder):
    return enrich.match_rates(_enriched(spark, folder), _CODES)


@query("dictionary_dedupe", "SELECT upper(p_name) AS libelle_norm, min(p_partkey) AS code FROM part GROUP BY 1")
def dictionary_dedupe(spark, folder):
    spelled = F.when(F.col("p_partkey") % 3 == 0, F.translate("p_name", "aeiu", "âéîü")).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit(" ("), F.replace("p_name", F.lit(" "), F.lit(" - ")), F.lit(")"))
    )
    sheet = table(spark, folder, "part").select(
        "p_partkey", F.coalesce(spelled, "p_name").alias("LIBELLE_EMPLOI"), F.col("p_partkey").alias("row_no")
    )
    return enrich.load_dictionary(sheet, ["LIBELLÉ_EMPLOI", "LIBELLE_EMPLOI"])


@query(
    "join_reference",
    "SELECT o_custkey AS id_commun, o_orderkey, o_totalprice, c_name AS nom FROM orders "
    "LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0",
)
def join_reference(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("id_commun"), "o_orderkey", "o_totalprice")
    reference = table(spark, folder, "customer").filter("c_acctbal > 0")
    return enrich.join_reference(
        orders, reference.select(F.col("c_custkey").alias("id_commun"), F.col("c_name").alias("nom")), "id_commun"
    )


@query(
    "join_sheets",
    """
WITH f2 AS (SELECT l_orderkey, round(sum(CAST(CASE WHEN l_linenumber = 1 THEN l_extendedprice END AS DECIMAL(18,2))), 2) AS a,
       round(sum(CAST(CASE WHEN l_linenumber = 2 THEN l_extendedprice END AS DECIMAL(18,2))), 2) AS b
  FROM lineitem GROUP BY l_orderkey)
SELECT strftime(o_orderdate, '%Y_%m') AS periode, CAST(o_orderkey AS VARCHAR) AS matricule, o_totalprice AS montant,
       CAST(o_orderkey AS VARCHAR) || '||' || CAST(o_custkey AS VARCHAR) AS "cle_F2",
       CAST(a AS DOUBLE) AS "101_F2", CAST(b AS DOUBLE) AS "102_F2"
FROM (SELECT orders.*, l_orderkey, a, b FROM orders JOIN f2 ON o_orderkey = l_orderkey)
UNION ALL
SELECT strftime(o_orderdate, '%Y_%m'), CAST(o_orderkey AS VARCHAR), o_totalprice, NULL, NULL, NULL
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def join_sheets(spark, folder):
    period = period_of("o_orderdate").alias("periode")
    key = F.concat_ws("||", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    orders = table(spark, folder, "orders")
    agents = orders.select(
        period, F.col("o_orderkey").cast("string").alias("matricule"), "o_custkey", F.col("o_totalprice").alias("montant")
    )

    def code(line: int, name: str):
        amount = F.when(F.col("l_linenumber") == line, F.col("l_extendedprice")).cast("decimal(18,2)")
        return F.sum(amount).cast("double").alias(name)

    codes = (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(period, key.alias("cle"))
        .agg(code(1, "101"), code(2, "102"))
    )
    left_key = F.concat_ws("||", "matricule", F.col("o_custkey").cast("string"))
    return enrich.join_sheets(agents, codes, "periode", left_key, F.col("cle")).drop("o_custkey")


@query(
    "apply_value_labels",
    "SELECT c_custkey, c_name, CASE WHEN n_nationkey % 4 != 3 THEN n_name ELSE CAST(c_nationkey AS VARCHAR) END "
    "AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def apply_value_labels(spark, folder):
    labels = (
        table(spark, folder, "nation")
        .filter("n_nationkey % 4 != 3")
        .select(F.lit("c_nationkey").alias("variable"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    return enrich.apply_value_labels(customers, labels, ["c_nationkey"])


def _headers(spark, folder):
    """Columns each period would have if every pay element in use were one: text and number codes."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    period = period_of("o_orderdate").alias("periode")
    names = F.array(F.concat_ws("_", "p_brand", "p_type"), (F.col("p_partkey") % 400).cast("string"))
    return lines.select(period, F.explode(names).alias("colonne"))


_HEADERS_SQL = """
WITH lines AS (
  SELECT strftime(o_orderdate, '%Y_%m') AS periode, p_brand || '_' || p_type AS a,
         CAST(p_partkey % 400 AS VARCHAR) AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), headers AS (SELECT DISTINCT periode, a AS colonne FROM lines UNION SELECT DISTINCT periode, b FROM lines)
"""


@query(
    "schema_drift",
    _HEADERS_SQL
    + """, periods AS (
  SELECT periode, lead(periode) OVER (ORDER BY periode) AS suivante FROM (SELECT DISTINCT periode FROM headers)
)
SELECT h.periode AS p_avant, suivante AS p_apres, 'DISPARUE' AS type, colonne
FROM headers h JOIN periods p ON h.periode = p.periode
WHERE suivante IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM headers x WHERE x.periode = suivante AND x.colonne = h.colonne)
UNION ALL
SELECT p.periode, suivante, 'APPARUE', colonne FROM headers h JOIN periods p ON h.periode = p.suivante
WHERE NOT EXISTS (SELECT 1 FROM headers x WHERE x.periode = p.periode AND x.colonne = h.colonne)""",
)
def schema_drift(spark, folder):
    return drift.schema_drift(_headers(spark, folder))


@query("distinct_columns", _HEADERS_SQL + "SELECT DISTINCT colonne FROM headers")
def distinct_columns(spark, folder):
    return drift.distinct_columns(_headers(spark, folder))


@query(
    "numeric_code_columns",
    _HEADERS_SQL + "SELECT DISTINCT colonne FROM headers WHERE regexp_full_match(colonne, '[0-9]+')",
)
def numeric_code_columns(spark, folder):
    return drift.numeric_code_columns(_headers(spark, folder))


@query(
    "column_count_stats",
    _HEADERS_SQL
    + """, n AS (SELECT periode, count(*) AS nb FROM headers GROUP BY periode)
SELECT min(nb) AS min_colonnes, max(nb) AS max_colonnes, round(avg(nb), 1) AS moy_colonnes FROM n""",
)
def column_count_stats(spark, folder):
    return drift.column_count_stats(_headers(spark, folder))


@query(
    "columns_per_period",
    _HEADERS_SQL + "SELECT periode, count(*) AS nb_colonnes FROM headers GROUP BY periode",
)
def columns_per_period(spark, folder):
    return drift.columns_per_period(_headers(spark, folder))


@query(
    "union_by_name",
    """
SELECT CAST(year(o_orderdate) AS INTEGER) AS annee, o_orderkey, o_totalprice,
       CASE WHEN year(o_orderdate) > 1997 THEN o_orderpriority END AS priorite,
       CASE WHEN year(o_orderdate) <= 1997 THEN o_orderstatus END AS statut FROM orders""",
)
def union_by_name(spark, folder):
    orders = table(spark, folder, "orders").withColumn("annee", F.year("o_orderdate"))
    old = orders.filter("annee <= 1997").select("annee", "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("statut"))
    new = orders.filter("annee > 1997").select(
        F.col("o_orderpriority").alias("priorite"), "o_totalprice", "o_orderkey", "annee"
    )
    return union_all([old, new])
