"""Values valid at a moment, overlapping intervals and spells, over orders and the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators.temporal import career_spells, join_asof, join_intervals
from stratiform.plans.fixtures import PANEL_SQL, panel, table
from stratiform.plans.registry import query


@query(
    "join_asof_codes",
    """
WITH codes AS (SELECT o_custkey % 50 AS organisme, o_orderdate AS valable_depuis, max(o_orderkey) AS code
  FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT o.o_orderkey, c.valable_depuis, c.code
FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_custkey % 11 <> 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE o_custkey % 60 END END AS organisme
  FROM orders) o ASOF LEFT JOIN codes c ON o.organisme = c.organisme AND o.o_orderdate >= c.valable_depuis""",
)
def join_asof_codes(spark, folder):
    """The code of the organisation that holds at each order's date; one organisation has a third of all orders."""
    orders = table(spark, folder, "orders")
    codes = orders.where("o_orderkey % 3 = 0").groupBy(
        (F.col("o_custkey") % 50).alias("organisme"), F.col("o_orderdate").alias("valable_depuis")
    ).agg(F.max("o_orderkey").alias("code"))
    organisme = F.when(F.col("o_custkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_custkey") % 60)
    rows = orders.select("o_orderkey", "o_orderdate", F.when(F.col("o_custkey") % 11 != 0, organisme).alias("organisme"))
    out = join_asof(rows, codes, ["organisme"], "o_orderdate", "valable_depuis")
    return out.select("o_orderkey", "valable_depuis", "code")


@query(
    "join_intervals",
    """
WITH spells AS (SELECT o_orderkey, o_custkey % 40 AS organisme, epoch(o_orderdate) / 86400 AS debut,
    epoch(o_orderdate) / 86400 + o_orderkey % 45 AS fin FROM orders),
ranges AS (SELECT l_orderkey, l_linenumber, l_suppkey % 40 AS organisme, epoch(l_shipdate) / 86400 AS debut,
    epoch(l_shipdate) / 86400 + CASE WHEN l_partkey % 50 = 0 THEN 400 ELSE l_partkey % 9 END AS fin
  FROM lineitem WHERE l_linenumber = 1)
SELECT a.o_orderkey, count(*) AS nb_plages, CAST(sum(b.l_orderkey) AS BIGINT) AS somme, max(b.fin) AS derniere_fin
FROM spells a JOIN ranges b ON a.organisme = b.organisme AND a.debut <= b.fin AND b.debut <= a.fin GROUP BY a.o_orderkey""",
)
def overlapping_intervals(spark, folder):
    """Spells against validity ranges of a few days to more than a year, per organisation."""
    days = lambda c: F.unix_seconds(c.cast("timestamp")).cast("double") / 86400
    start = days(F.col("o_orderdate"))
    spells = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 40).alias("organisme"), start.alias("debut"), (start + F.col("o_orderkey") % 45).alias("fin")
    )
    start = days(F.col("l_shipdate"))
    length = F.when(F.col("l_partkey") % 50 == 0, F.lit(400)).otherwise(F.col("l_partkey") % 9)
    ranges = table(spark, folder, "lineitem").where("l_linenumber = 1").select(
        "l_orderkey", (F.col("l_suppkey") % 40).alias("organisme"), start.alias("debut"), (start + length).alias("fin")
    )
    found = join_intervals(
        spells, ranges, ["organisme"], ("debut", "fin"), ("debut", "fin"), width=8.0, by=["o_orderkey"], total="l_orderkey"
    )
    return found.select("o_orderkey", F.col("nombre").alias("nb_plages"), "somme", F.col("fin").alias("derniere_fin"))


@query(
    "career_spells",
    f"""
WITH panel AS ({PANEL_SQL}),
months AS (SELECT periode, row_number() OVER (ORDER BY periode) AS number FROM (SELECT DISTINCT periode FROM panel)),
rows_ AS (SELECT DISTINCT matricule, situation, periode FROM panel),
marked AS (SELECT r.*, m.number - row_number() OVER (PARTITION BY matricule, situation ORDER BY m.number) AS island
  FROM rows_ r JOIN months m USING (periode))
SELECT matricule, situation, min(periode) AS debut, max(periode) AS fin, count(*) AS nb_periodes
FROM marked GROUP BY matricule, situation, island""",
)
def spells_of_careers(spark, folder):
    """Consecutive months of one situation."""
    return career_spells(panel(spark, folder), "matricule", "periode", "situation")
