"""Sources and sinks: every query writes files derived from a given table and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratiform.functions.text import file_stem
from stratiform.operators import drift
from stratiform.operators.enrich import apply_value_labels
from stratiform.plans.fixtures import table
from stratiform.plans.registry import query
from stratiform.plans.staging import ORDERS_PER_FILE, staged_stata, staged_workbooks
from stratiform.session import new_folder
from stratiform.sinks.files import write_csv, write_parquet
from stratiform.sinks.tables import append_table, ensure_database, overwrite_table
from stratiform.sources import catalog, cells, files, mixed, stata, workbook
from stratiform.streaming.incremental import ingest_new_files

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _orders(spark, folder):
    return table(spark, folder, "orders").select(*_ORDERS.split(", "))


def _priced(spark, folder):
    """Orders whose price is text with two decimals, as a CSV cell would hold it."""
    return _orders(spark, folder).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


def _dated(spark, folder):
    return table(spark, folder, "orders").select(*_ORDERS.split(", "), F.year("o_orderdate").alias("annee"))


@query("scan_parquet", f"SELECT {_ORDERS}, o_orderdate FROM orders")
def scan_parquet(spark, folder):
    return files.read_parquet(spark, f"{folder}/orders.parquet")


@query(
    "scan_partitioned",
    f"SELECT {_ORDERS}, CAST(year(o_orderdate) AS INTEGER) AS annee FROM orders WHERE year(o_orderdate) IN (1996, 1999)",
)
def scan_partitioned(spark, folder):
    path = new_folder(spark, "partitioned")
    write_parquet(_dated(spark, folder), path, ["annee"])
    return files.read_parquet(spark, path).filter(F.col("annee").isin(1996, 1999))


@query(
    "scan_csv_strings",
    "SELECT CAST(o_orderkey AS VARCHAR) AS \"CLE\", CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS \"MONTANT\", "
    "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS \"PRIORITE\", "
    "CASE WHEN o_orderkey % 2 = 1 THEN 'É;' || o_orderstatus END AS \"ETAT\" FROM orders",
)
def scan_csv_strings(spark, folder):
    path = new_folder(spark, "csv")
    rows = _priced(spark, folder)
    even, odd = rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 = 1")
    key, amount = F.col("o_orderkey").alias("Clé"), F.col("o_totalprice").alias("Montant")
    write_csv(even.select(key, amount, F.col("o_orderpriority").alias("Priorité")), f"{path}/a", encoding="ISO-8859-1")
    state = F.concat(F.lit("É;"), "o_orderstatus").alias("État")
    write_csv(odd.select(key, state, amount), f"{path}/b", encoding="ISO-8859-1")
    return files.read_csv_strings(spark, path, ";", "ISO-8859-1", style="ascii")


@query(
    "scan_csv_inferred",
    "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, "
    "o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def scan_csv_inferred(spark, folder):
    path = new_folder(spark, "csv")
    write_csv(_priced(spark, folder), path, sep="\t", bom=True)
    return files.read_csv_inferred(spark, path, sep="\t")


@query(
    "file_listing",
    "SELECT DISTINCT 'annee=' || CAST(year(o_orderdate) AS VARCHAR) AS dossier, 'parquet' AS extension, "
    "true AS non_vide FROM orders",
)
def file_listing(spark, folder):
    path = new_folder(spark, "listing")
    write_parquet(_dated(spark, folder), path, ["annee"])
    listed = files.list_files(spark, path, ["parquet"])
    year = F.regexp_extract("path", "/(annee=[0-9]+)/", 1)
    return listed.groupBy(year.alias("dossier"), "extension").agg((F.min("taille") > 0).alias("non_vide"))


@query(
    "file_inventory",
    """
SELECT CASE WHEN year(o_orderdate) <= 1997 THEN 'avant' ELSE 'apres' END AS dossier,
       CASE WHEN year(o_orderdate) <= 1997 THEN 'o_orderkey|o_totalprice' ELSE 'o_orderkey|o_totalprice|o_orderpriority' END
       AS colonnes,
       CAST(CASE WHEN year(o_orderdate) <= 1997 THEN 2 ELSE 3 END AS BIGINT) AS nb_colonnes, count(*) AS nb_lignes
FROM orders GROUP BY ALL""",
)
def file_inventory(spark, folder):
    path = new_folder(spark, "inventory")
    rows = _dated(spark, folder)
    write_csv(rows.filter("annee <= 1997").select("o_orderkey", "o_totalprice"), f"{path}/avant", sep=",")
    write_parquet(rows.filter("annee > 1997").select("o_orderkey", "o_totalprice", "o_orderpriority"), f"{path}/apres")
    found = files.file_inventory(spark, path)
    parent = F.element_at(F.split("cle", "/"), -2).alias("dossier")
    return found.groupBy(parent, "colonnes", "nb_colonnes").agg(F.sum("nb_lignes").alias("nb_lignes"))


@query(
    "ingest_mixed_formats",
    "SELECT CAST(o_orderkey AS VARCHAR) AS \"CLE_COMMANDE\", "
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS \"MONTANT\", "
    "CASE WHEN year(o_orderdate) > 1997 THEN o_orderstatus END AS \"STATUT\", "
    "CASE WHEN year(o_orderdate) <= 1997 THEN 'csv' ELSE 'parquet' END AS format FROM orders",
)
def ingest_mixed_formats(spark, folder):
    path = new_folder(spark, "mixed")
    rows = table(spark, folder, "orders").withColumn("annee", F.year("o_orderdate"))
    key = F.col("o_orderkey").alias("Clé commande")
    amount = F.col("o_totalprice").cast("decimal(18,2)").alias("Montant")
    write_csv(rows.filter("annee <= 1997").select(key, amount), f"{path}/anciens", sep=",")
    write_parquet(rows.filter("annee > 1997").select(amount, key, F.col("o_orderstatus").alias("Statut")), f"{path}/recents")
    bronze = mixed.read_mixed(spark, path)
    return bronze.select(
        "CLE_COMMANDE", "MONTANT", "STATUT", F.regexp_extract("FICHIER_SOURCE", "([a-z]+)$", 1).alias("format")
    )


@query(
    "add_provenance",
    "SELECT o_orderkey, 'orders' AS \"PERIODE\", 'orders.parquet' AS \"FICHIER_SOURCE\", "
    "DATE '2024-01-31' AS \"DATE_INGESTION\" FROM orders",
)
def add_provenance(spark, folder):
    from stratiform.operators.headers import add_provenance as with_provenance

    rows = with_provenance(table(spark, folder, "orders"), ingested_on="2024-01-31")
    return rows.select("o_orderkey", "PERIODE", "FICHIER_SOURCE", "DATE_INGESTION")


_LOT = f"CAST(o_orderkey // {ORDERS_PER_FILE} AS BIGINT)"
_LOT_NAME = f"'lot_' || lpad(CAST({_LOT} AS VARCHAR), 9, '0')"


@query(
    "ingest_workbooks",
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS "MATRICULE", CAST(o_custkey AS VARCHAR) AS "N_CLIENT",
       o_orderstatus AS "SITUATION", o_totalprice AS "MONTANT_BRUT",
       CASE WHEN {_LOT} % 2 = 1 THEN o_orderpriority END AS "PRIORITE",
       {_LOT_NAME} AS "PERIODE", {_LOT_NAME} || '.xlsx' AS "FICHIER_SOURCE" FROM orders""",
)
def ingest_workbooks(spark, folder):
    rows = workbook.workbook_table(staged_workbooks(spark, folder))
    # The text of a number differs between engines, its value does not.
    return rows.withColumn("MONTANT_BRUT", F.col("MONTANT_BRUT").cast("double"))


@query(
    "ingest_workbook_pairs",
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS "MATRICULE", o_totalprice AS "MONTANT_BRUT",
       CAST(o_custkey AS VARCHAR) AS "101_F2", o_totalprice AS "102_F2", {_LOT_NAME} AS "PERIODE" FROM orders""",
)
def ingest_workbook_pairs(spark, folder):
    rows = workbook.two_sheet_table(staged_workbooks(spark, folder))
    amounts = {name: F.col(f"`{name}`").cast("double") for name in ("MONTANT_BRUT", "102_F2")}
    return rows.withColumns(amounts).select("MATRICULE", "MONTANT_BRUT", "101_F2", "102_F2", "PERIODE")


@query(
    "ingest_workbook_sheet",
    'SELECT CAST(o_orderkey AS VARCHAR) AS cle, CAST(o_custkey AS VARCHAR) AS "101", o_totalprice AS "102" FROM orders',
)
def ingest_workbook_sheet(spark, folder):
    rows = workbook.sheet_range(staged_workbooks(spark, folder), "Codes", first_row=2)
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("cle"), "101", F.col("102").cast("double").alias("102"))


@query(
    "detect_header_row",
    f"""
SELECT {_LOT_NAME} AS fichier, 'Agents' AS sheet, CAST(1 + {_LOT} % 3 AS BIGINT) AS header_row FROM orders GROUP BY ALL
UNION ALL SELECT {_LOT_NAME}, 'Codes', 2 FROM orders GROUP BY ALL""",
)
def detect_header_row(spark, folder):
    found = workbook.detect_header_rows(staged_workbooks(spark, folder))
    return found.select(file_stem(F.col("path")).alias("fichier"), "sheet", "header_row")


@query(
    "columns_per_sheet",
    f"""
SELECT {_LOT_NAME} AS periode, CAST(4 + {_LOT} % 2 AS BIGINT) AS nb_cols_f1, CAST(3 AS BIGINT) AS nb_cols_f2
FROM orders GROUP BY ALL""",
)
def columns_per_sheet(spark, folder):
    return drift.columns_per_sheet(workbook.workbook_headers(staged_workbooks(spark, folder)))


@query(
    "ingest_error_report",
    f"""
SELECT {_LOT_NAME} AS fichier, CASE WHEN {_LOT} % 3 = 1 THEN 0 ELSE 2 * count(*) END AS nb_lignes,
       {_LOT} % 3 = 1 AS en_erreur FROM orders GROUP BY {_LOT}""",
)
def ingest_error_report(spark, folder):
    staged = staged_workbooks(spark, folder)
    number = F.regexp_extract("path", "lot_([0-9]+)", 1).cast("bigint")
    cut = F.substring("content", F.lit(1), F.floor(F.length("content") / 2).cast("int"))
    damaged = staged.withColumn("content", F.when(number % 3 == 1, cut).otherwise(F.col("content")))
    rows = workbook.workbook_rows(damaged)
    data = F.get("cells", F.lit(0)).rlike("^[0-9]+$")
    return rows.groupBy(file_stem(F.col("path")).alias("fichier")).agg(
        F.count_if(data).alias("nb_lignes"), F.bool_or(F.col("error").isNotNull()).alias("en_erreur")
    )


@query(
    "ingest_stata",
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS "MATRICULE",
       CASE o_orderstatus WHEN 'F' THEN 'Fermé' WHEN 'O' THEN 'Ouvert' ELSE 'Partiel' END AS "STATUT",
       o_totalprice AS "MONTANT", {_LOT_NAME} || '.dta' AS "FICHIER_SOURCE" FROM orders""",
)
def ingest_stata(spark, folder):
    staged = staged_stata(spark, folder)
    rows = stata.stata_table(staged)
    labels = stata.value_labels(staged).select(F.upper("variable").alias("variable"), "code", "label").distinct()
    labelled = apply_value_labels(rows, labels, ["STATUT"])
    amount = F.col("MONTANT").cast("double").alias("MONTANT")
    return labelled.select("MATRICULE", "STATUT", amount, "FICHIER_SOURCE")


@query(
    "catalog_inventory",
    'SELECT \'clients\' AS "table", count(*) AS nb_lignes, CAST(5 AS BIGINT) AS nb_colonnes FROM customer '
    "UNION ALL SELECT 'commandes', count(*), 5 FROM orders",
)
def catalog_inventory(spark, folder):
    database = f"inventaire_{uuid.uuid4().hex[:12]}"
    ensure_database(spark, database)
    tables = {"clients": table(spark, folder, "customer"), "commandes": _orders(spark, folder)}
    for name, rows in tables.items():
        overwrite_table(rows, f"{database}.{name}", new_folder(spark, name))
    found = catalog.inventory(spark, [database])
    return found.withColumn("table", F.element_at(F.split("table", "[.]"), -1))


def _table_name() -> str:
    return f"sortie_{uuid.uuid4().hex[:12]}"


@query("sink_overwrite_roundtrip", f"SELECT {_ORDERS} FROM orders")
def sink_overwrite_roundtrip(spark, folder):
    name, path = _table_name(), new_folder(spark, "table")
    rows = _orders(spark, folder)
    overwrite_table(rows.filter("o_orderkey % 2 = 0"), name, path)
    return overwrite_table(rows, name, path)


@query(
    "sink_append_roundtrip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders",
)
def sink_append_roundtrip(spark, folder):
    name, path = _table_name(), new_folder(spark, "table")
    rows = _orders(spark, folder)
    overwrite_table(rows.filter("o_orderkey % 2 = 0"), name, path)
    return append_table(rows.filter("o_orderkey % 2 = 1").drop("o_orderpriority"), name)


@query("sink_parquet_roundtrip", f"SELECT {_ORDERS} FROM orders")
def sink_parquet_roundtrip(spark, folder):
    path = new_folder(spark, "parquet")
    write_parquet(_orders(spark, folder), path)
    return files.read_parquet(spark, path)


@query(
    "sink_csv_roundtrip",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, "
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, o_orderpriority FROM orders",
)
def sink_csv_roundtrip(spark, folder):
    path = new_folder(spark, "csv")
    write_csv(_priced(spark, folder), path, bom=True)
    return files.read_csv_strings(spark, path, ";")


@query(
    "ingest_incremental",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) "
    "AS o_totalprice, o_orderstatus FROM orders",
)
def ingest_incremental(spark, folder):
    path = new_folder(spark, "incremental")
    rows = table(spark, folder, "orders").withColumn("annee", F.year("o_orderdate")).select(
        "annee", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderstatus"
    )
    schema = rows.drop("annee").schema
    for name, condition in (("anciens", "annee <= 1997"), ("recents", "annee > 1997")):
        write_parquet(rows.filter(condition).drop("annee"), f"{path}/source/{name}")
        bronze = ingest_new_files(
            spark, f"{path}/source", f"{path}/bronze", f"{path}/state", schema, files_per_batch=4
        )
    return bronze.drop("PERIODE", "FICHIER_SOURCE")
