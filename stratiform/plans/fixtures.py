"""Relations that the registered queries derive from the given tables, with their SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions.text import FOLD_FROM, FOLD_TO, normalize_category


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def period_of(date: str):
    return F.concat(F.year(date).cast("string"), F.lit("_"), F.lpad(F.month(date).cast("string"), 2, "0"))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Pay lines of one agent (customer) in one period (order month), raw situation labels."""
    tables = {name: table(spark, folder, name) for name in ("lineitem", "orders", "customer", "nation", "part")}
    # What depends on the order alone is worked out, and its customer found, before the lines
    # multiply it: the lines are then shuffled for two joins only.
    situation = (
        F.when(F.col("o_orderstatus") == "F", " En  activité ")
        .when(F.col("o_orderstatus") == "O", "Demi-solde")
        .otherwise("Détachement")
    )
    agents = tables["customer"].join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    orders = (
        tables["orders"]
        .select("o_orderkey", "o_custkey", period_of("o_orderdate").alias("periode"), situation.alias("situation"))
        .join(agents, F.col("o_custkey") == F.col("c_custkey"))
    )
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount, tax = (F.col(c).cast("decimal(5,2)") for c in ("l_discount", "l_tax"))
    net = F.round(price * (1 - discount) * (1 + tax), 2).cast("double")
    return (
        tables["lineitem"]
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(tables["part"], F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("c_custkey").cast("string").alias("matricule"),
            "periode",
            F.when(F.col("c_custkey") % 2 == 0, "1").otherwise("2").alias("sexe"),
            "situation",
            F.when(F.col("n_nationkey") % 11 != 10, F.col("n_name")).alias("organisme"),
            F.when(F.col("n_nationkey") % 7 != 6, F.col("n_nationkey")).alias("code_organisme"),
            F.col("p_brand").alias("emploi"),
            F.col("p_type").alias("grade"),
            F.col("c_mktsegment").alias("service"),
            F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("montant_brut"),
            net.alias("montant_net"),
        )
    )


KEPT_SITUATIONS = ["en_activite", "regul_indemnites", "demi_solde"]


def silver_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Panel with its normalised situation, limited to the paid situations."""
    rows = panel(spark, folder).withColumn("situation_normalisee", normalize_category(F.col("situation")))
    return rows.filter(F.col("situation_normalisee").isin(KEPT_SITUATIONS))


def bronze_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Panel as raw text: decimal comma for even agents, blank text where a value is missing."""
    rows = panel(spark, folder)
    even = F.col("matricule").cast("bigint") % 2 == 0

    def amount(name: str):
        text = F.col(name).cast("decimal(18,2)").cast("string")
        return F.coalesce(F.when(even, F.replace(text, F.lit("."), F.lit(","))).otherwise(text), F.lit("  "))

    as_text = {"montant_brut": amount("montant_brut"), "montant_net": amount("montant_net")}
    return rows.select(
        *[as_text.get(c, F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in rows.columns]
    )


PANEL_SQL = """
SELECT CAST(c.c_custkey AS VARCHAR) AS matricule,
       CAST(year(o.o_orderdate) AS VARCHAR) || '_' || lpad(CAST(month(o.o_orderdate) AS VARCHAR), 2, '0') AS periode,
       CASE WHEN c.c_custkey % 2 = 0 THEN '1' ELSE '2' END AS sexe,
       CASE o.o_orderstatus WHEN 'F' THEN ' En  activité ' WHEN 'O' THEN 'Demi-solde' ELSE 'Détachement' END AS situation,
       CASE WHEN n.n_nationkey % 11 = 10 THEN NULL ELSE n.n_name END AS organisme,
       CASE WHEN n.n_nationkey % 7 = 6 THEN NULL ELSE n.n_nationkey END AS code_organisme,
       p.p_brand AS emploi, p.p_type AS grade, c.c_mktsegment AS service,
       CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_extendedprice END AS montant_brut,
       CAST(round(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(5,2)))
                  * (1 + CAST(l.l_tax AS DECIMAL(5,2))), 2) AS DOUBLE) AS montant_net
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

SILVER_SQL = f"""
SELECT * FROM (
  SELECT panel.*, CASE situation WHEN ' En  activité ' THEN 'en_activite'
                                 WHEN 'Demi-solde' THEN 'demi_solde' ELSE 'autre' END AS situation_normalisee
  FROM ({PANEL_SQL}) AS panel
) WHERE situation_normalisee IN ('en_activite', 'regul_indemnites', 'demi_solde')
"""


def _amount_sql(name: str) -> str:
    text = f"CAST(CAST({name} AS DECIMAL(18,2)) AS VARCHAR)"
    return (
        f"coalesce(CASE WHEN CAST(matricule AS BIGINT) % 2 = 0 THEN replace({text}, '.', ',') "
        f"ELSE {text} END, '  ') AS {name}"
    )


BRONZE_SQL = f"""
SELECT matricule, periode, sexe, situation,
       coalesce(organisme, '') AS organisme, coalesce(CAST(code_organisme AS VARCHAR), '') AS code_organisme,
       emploi, grade, service, {_amount_sql("montant_brut")}, {_amount_sql("montant_net")}
FROM ({PANEL_SQL})
"""


def with_panel(sql: str, panel: str = PANEL_SQL) -> str:
    return f"WITH panel AS ({panel}) {sql}"


def label_sql(text: str) -> str:
    """The label rule of ``normalize_label`` in SQL."""
    spelled = text
    for letter, ascii_letters in {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae", "ß": "SS"}.items():
        spelled = f"replace({spelled}, '{letter}', '{ascii_letters}')"
    folded = f"upper(translate({spelled}, '{FOLD_FROM}', '{FOLD_TO}'))"
    squeezed = f"regexp_replace({folded}, '[-.''’‘,;:/()\\[\\]\\s\\x{{00A0}}\\x{{202F}}]+', ' ', 'g')"
    return f"nullif(trim({squeezed}), '')"
