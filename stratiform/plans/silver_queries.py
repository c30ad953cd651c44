"""Bronze -> Silver: casts, filters, deduplication, label and category rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.functions import casts, text
from stratiform.operators import cleaning, headers
from stratiform.plans.fixtures import (
    BRONZE_SQL,
    KEPT_SITUATIONS,
    bronze_panel,
    label_sql,
    panel,
    period_of,
    silver_panel,
    table,
    with_panel,
)
from stratiform.plans.registry import query

_AMOUNTS = ["montant_brut", "montant_net"]
_CASE_SITUATION = (
    "CASE situation WHEN ' En  activité ' THEN 'en_activite' WHEN 'Demi-solde' THEN 'demi_solde' ELSE 'autre' END"
)


@query(
    "cast_double",
    with_panel(
        "SELECT matricule, periode, TRY_CAST(montant_brut AS DOUBLE) AS montant_brut, "
        "TRY_CAST(montant_net AS DOUBLE) AS montant_net FROM panel",
        BRONZE_SQL,
    ),
)
def cast_double(spark, folder):
    rows = bronze_panel(spark, folder).select("matricule", "periode", *_AMOUNTS)
    return casts.cast_columns(rows, doubles=[*_AMOUNTS, "absente"])


@query(
    "cast_int",
    with_panel(
        "SELECT matricule, periode, TRY_CAST(sexe AS INTEGER) AS sexe, "
        "TRY_CAST(code_organisme AS INTEGER) AS code_organisme FROM panel",
        BRONZE_SQL,
    ),
)
def cast_int(spark, folder):
    rows = bronze_panel(spark, folder).select("matricule", "periode", "sexe", "code_organisme")
    return casts.cast_columns(rows, ints=["sexe", "code_organisme"])


@query(
    "cast_date",
    """
SELECT o_orderkey, CAST(try_strptime(CAST(year(o_orderdate) AS VARCHAR) || '_' ||
       lpad(CAST(day(o_orderdate) % 15 AS VARCHAR), 2, '0'), '%Y_%m') AS DATE) AS periode FROM orders""",
)
def cast_date(spark, folder):
    month = F.lpad((F.dayofmonth("o_orderdate") % 15).cast("string"), 2, "0")
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.concat_ws("_", F.year("o_orderdate").cast("string"), month).alias("periode")
    )
    return casts.cast_columns(rows, dates={"periode": "yyyy_MM"})


@query(
    "parse_fr_decimal",
    with_panel(
        "SELECT matricule, periode, TRY_CAST(replace(montant_brut, ',', '.') AS DOUBLE) AS montant_brut, "
        "TRY_CAST(replace(montant_net, ',', '.') AS DOUBLE) AS montant_net FROM panel",
        BRONZE_SQL,
    ),
)
def parse_fr_decimal(spark, folder):
    rows = bronze_panel(spark, folder).select("matricule", "periode", *_AMOUNTS)
    return casts.cast_columns(rows, doubles=_AMOUNTS, decimal_comma=True)


@query(
    "cast_failures",
    with_panel(
        " UNION ALL ".join(
            f"SELECT '{c}' AS colonne, count({c}) AS nb_non_null, "
            f"count(*) FILTER ({c} IS NOT NULL AND TRY_CAST({c} AS {kind}) IS NULL) AS nb_echecs FROM panel"
            for c, kind in {"montant_brut": "DOUBLE", "montant_net": "DOUBLE", "code_organisme": "INTEGER"}.items()
        ),
        BRONZE_SQL,
    ),
)
def cast_failures(spark, folder):
    return casts.cast_failures(bronze_panel(spark, folder), doubles=_AMOUNTS, ints=["code_organisme"])


@query(
    "blank_to_null",
    with_panel(
        "SELECT matricule, periode, nullif(trim(montant_brut), '') AS montant_brut, "
        "nullif(trim(organisme), '') AS organisme, nullif(trim(code_organisme), '') AS code_organisme FROM panel",
        BRONZE_SQL,
    ),
)
def blank_to_null(spark, folder):
    blank = ["montant_brut", "organisme", "code_organisme"]
    rows = bronze_panel(spark, folder).select("matricule", "periode", *blank)
    return rows.withColumns({c: text.blank_to_null(F.col(c)) for c in blank})


@query("clip_negative", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS solde FROM customer")
def clip_negative(spark, folder):
    solde = casts.clip_negative(F.col("c_acctbal")).alias("solde")
    return table(spark, folder, "customer").select("c_custkey", solde)


@query(
    "recode_values",
    with_panel(
        "SELECT matricule, periode, sexe, CASE sexe WHEN '1' THEN 0 WHEN '2' THEN 1 END AS femme "
        "FROM panel WHERE CAST(substr(periode, 1, 4) AS INTEGER) >= 1998"
    ),
)
def recode_values(spark, folder):
    recent = panel(spark, folder).filter(F.substring("periode", 1, 4).cast("int") >= 1998)
    return recent.select("matricule", "periode", "sexe", casts.recode(F.col("sexe"), {"1": 0, "2": 1}).alias("femme"))


@query(
    "period_parts",
    """
WITH p AS (SELECT o_orderkey, strftime(o_orderdate, '%Y_%m') AS periode FROM orders)
SELECT o_orderkey, periode, substr(periode, 1, 4) AS annee, substr(periode, 6, 2) AS mois FROM p""",
)
def period_parts(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", period_of("o_orderdate").alias("periode"))
    return casts.period_parts(rows)


@query(
    "date_parts",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS annee, "
    "CAST(month(o_orderdate) AS INTEGER) AS mois FROM orders",
)
def date_parts(spark, folder):
    return casts.date_parts(table(spark, folder, "orders"), "o_orderdate").select("o_orderkey", "annee", "mois")


@query(
    "silver_clean",
    with_panel(
        "SELECT matricule, periode, trim(upper(situation)) AS situation, montant_brut FROM panel "
        "WHERE matricule IS NOT NULL AND montant_brut > 0"
    ),
)
def silver_clean(spark, folder):
    rows = panel(spark, folder).select("matricule", "periode", "situation", "montant_brut")
    kept = cleaning.keep_positive(cleaning.keep_present(rows, "matricule"), "montant_brut")
    return kept.withColumn("situation", text.trim_upper(F.col("situation")))


_SILVER_SQL = """
SELECT TRIM(UPPER(matricule)) AS matricule, TRY_CAST(montant_brut AS DOUBLE) AS montant_brut,
       TRY_CAST(montant_net AS DOUBLE) AS montant_net, TRIM(UPPER(emploi)) AS emploi, periode,
       TRY_CAST(substr(periode, 1, 4) AS INTEGER) AS annee
FROM {panel}
WHERE matricule IS NOT NULL AND TRY_CAST(montant_brut AS DOUBLE) > 0
"""


@query("silver_sql", with_panel(_SILVER_SQL.format(panel="panel"), BRONZE_SQL))
def silver_sql(spark, folder):
    return cleaning.sql_over(_SILVER_SQL, panel=bronze_panel(spark, folder))


@query(
    "silver_dropna",
    with_panel(
        "SELECT * FROM panel WHERE organisme IS NOT NULL AND code_organisme IS NOT NULL AND montant_brut IS NOT NULL"
    ),
)
def silver_dropna(spark, folder):
    return cleaning.drop_null_rows(panel(spark, folder))


_EXTRACT = "matricule, periode, sexe, situation, organisme, emploi, grade, service"


@query("silver_dedupe_all", with_panel(f"SELECT DISTINCT {_EXTRACT} FROM panel"))
def silver_dedupe_all(spark, folder):
    return cleaning.drop_duplicate_rows(panel(spark, folder).select(*_EXTRACT.split(", ")))


@query(
    "silver_dedupe_key",
    with_panel(
        """
SELECT matricule, periode, organisme, emploi, grade, situation, montant_brut, montant_net FROM (
  SELECT *, row_number() OVER (PARTITION BY matricule, periode
    ORDER BY montant_net DESC, emploi, grade, situation, montant_brut NULLS FIRST) AS r FROM panel) WHERE r = 1"""
    ),
)
def silver_dedupe_key(spark, folder):
    columns = ["matricule", "periode", "organisme", "emploi", "grade", "situation", "montant_brut", "montant_net"]
    order = [F.desc("montant_net"), "emploi", "grade", "situation", "montant_brut"]
    return cleaning.first_per_key(panel(spark, folder).select(*columns), ["matricule", "periode"], order)


@query(
    "normalize_category",
    with_panel(
        f"SELECT matricule, periode, situation AS situation_brute, {_CASE_SITUATION} AS situation_normalisee FROM panel"
    ),
)
def normalize_category(spark, folder):
    return panel(spark, folder).select(
        "matricule",
        "periode",
        F.col("situation").alias("situation_brute"),
        text.normalize_category(F.col("situation")).alias("situation_normalisee"),
    )


@query(
    "filter_situations",
    with_panel(
        f"SELECT matricule, periode, {_CASE_SITUATION} AS situation_normalisee, montant_net FROM panel "
        "WHERE situation IN (' En  activité ', 'Demi-solde')"
    ),
)
def filter_situations(spark, folder):
    rows = silver_panel(spark, folder)
    kept = cleaning.keep_categories(rows, "situation_normalisee", KEPT_SITUATIONS)
    return kept.select("matricule", "periode", "situation_normalisee", "montant_net")


@query("normalize_label", f"SELECT doc_id, {label_sql('text')} AS libelle_norm FROM documents")
def normalize_label(spark, folder):
    label = text.normalize_label(F.col("text")).alias("libelle_norm")
    return table(spark, folder, "documents").select("doc_id", label)


@query(
    "to_bronze_strings",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, "
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders",
)
def to_bronze_strings(spark, folder):
    orders = table(spark, folder, "orders")
    return casts.to_strings(orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")))


def _orders_as(sql_names: list[str]) -> str:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return "SELECT " + ", ".join(f'{c} AS "{n}"' for c, n in zip(columns, sql_names)) + " FROM orders"


def _orders_headed(spark, folder, names: list[str]):
    return table(spark, folder, "orders").drop("o_orderdate").toDF(*names)


@query("normalize_headers", _orders_as(["N_COMMANDE", "CODE_CLIENT", "STATUT_CMD", "MONTANT_TTC", "colonne_vide"]))
def normalize_headers(spark, folder):
    raw = ["N° Commande", " Code-Client ", "Statut/Cmd.", "Montant (TTC)", "§"]
    return headers.normalize_headers(_orders_headed(spark, folder, raw))


@query(
    "normalize_headers_prefixed",
    _orders_as(["OEUVRE_CLE", "CODE_CLIENT", "STATUT", "MONTANT_TTC", "PRIORITE_COMMANDE"]),
)
def normalize_headers_prefixed(spark, folder):
    raw = ["FEUILLE1.Œuvre clé", "F2.code client", "Statut", "montant-ttc (€)", "Priorité/Commande"]
    return headers.normalize_headers(_orders_headed(spark, folder, raw), "prefix_strip")


@query("light_rename", _orders_as(["Order_Key", "cust_key", "Status", "Total_Price", "Priority"]))
def light_rename(spark, folder):
    raw = ["Order Key", " cust.key ", "Status", "Total Price", "Priority"]
    return headers.normalize_headers(_orders_headed(spark, folder, raw), "light")


@query("dedupe_headers", _orders_as(["MONTANT", "MONTANT_2", "MONTANT_1", "CODE", "MONTANT_3"]))
def dedupe_headers(spark, folder):
    raw = ["Montant", "MONTANT", "Montant 1", "Code", "montant"]
    return headers.normalize_headers(_orders_headed(spark, folder, raw))


@query("rename_map", _orders_as(["commande", "client", "o_orderstatus", "montant", "o_orderpriority"]))
def rename_map(spark, folder):
    mapping = {"o_orderkey": "commande", "o_custkey": "client", "o_totalprice": "montant", "absente": "vide"}
    return headers.rename_map(table(spark, folder, "orders").drop("o_orderdate"), mapping)


@query(
    "map_columns",
    with_panel(
        "SELECT matricule, periode, sexe, situation, organisme, code_organisme, emploi, grade, "
        "service AS statut_fonctionnaire, montant_brut, montant_net AS montant_brut_dup2 FROM panel"
    ),
)
def map_columns(spark, folder):
    raw = ["Matricule", "PERIODE", "Sexe", "Situation administrative", "Ministère", "Code Organisme", "Corps"]
    raw += ["Classe/Échelon", "Grade", "Salaire Brut", "Rémunération brute"]
    mapped, _ = headers.map_columns(panel(spark, folder).toDF(*raw))
    return mapped
