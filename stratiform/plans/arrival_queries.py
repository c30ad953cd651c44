"""Files that differ from each other, all at once and as they arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.plans.file_queries import _LOT, _LOT_NAME
from stratiform.plans.fixtures import table
from stratiform.plans.registry import query
from stratiform.plans.staging import put_files, staged_csv, staged_workbooks
from stratiform.session import new_folder
from stratiform.sinks.files import write_parquet
from stratiform.sources import files, mixed, workbook
from stratiform.streaming.incremental import csv_reader, ingest_drifting, parquet_reader, workbook_reader

_CSV_SQL = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS "CLE", o_orderstatus AS "SITUATION",
       CASE WHEN {_LOT} % 3 = 0 THEN o_orderpriority || chr(10) || '"' || o_orderstatus || '"' END AS "PRIORITE",
       {_LOT_NAME} || '.csv' AS "FICHIER_SOURCE" FROM orders"""
_CSV_COLUMNS = ("CLE", "SITUATION", "PRIORITE", "FICHIER_SOURCE")


def _number():
    return F.regexp_extract("path", "lot_([0-9]+)", 1).cast("bigint")


@query("scan_csv_uneven", _CSV_SQL)
def scan_csv_uneven(spark, folder):
    """Line breaks in quotes, a first line of empty cells, header cells of 200,000 signs."""
    path = new_folder(spark, "csv")
    put_files(staged_csv(spark, folder), path)
    return files.read_csv_strings(spark, path, ";", "ISO-8859-1", "ascii", provenance=True).select(*_CSV_COLUMNS)


@query(
    "inventory_csv_uneven",
    f"""
SELECT {_LOT_NAME} || '.csv' AS fichier, count(*) AS nb_lignes,
       CAST(CASE WHEN {_LOT} % 3 = 1 THEN 2 ELSE 3 END AS BIGINT) AS nb_colonnes FROM orders GROUP BY {_LOT}""",
)
def inventory_csv_uneven(spark, folder):
    path = new_folder(spark, "csv")
    put_files(staged_csv(spark, folder), path)
    return files.file_inventory(spark, path, ";", "ISO-8859-1").select("fichier", "nb_lignes", "nb_colonnes")


@query(
    "ingest_workbook_keys",
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS "MATRICULE", CASE WHEN {_LOT} % 3 = 2 THEN o_orderkey || '||x' END AS "CLE_UNIQUE",
       CAST(o_custkey AS VARCHAR) AS "101_F2", o_totalprice AS "102_F2", {_LOT_NAME} AS "PERIODE" FROM orders""",
)
def ingest_workbook_keys(spark, folder):
    """Sheets joined by ``CLE_UNIQUE`` in some files and by ``MATRICULE`` in others."""
    rows = workbook.two_sheet_table(staged_workbooks(spark, folder, own_keys=True))
    return rows.withColumn("102_F2", F.col("`102_F2`").cast("double")).select("MATRICULE", "CLE_UNIQUE", "101_F2", "102_F2", "PERIODE")


@query(
    "ingest_parquet_layouts",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS "CLE_COMMANDE", CASE WHEN year(o_orderdate) % 3 = 0 THEN CAST(o_custkey AS VARCHAR)
       WHEN year(o_orderdate) % 3 = 1 THEN 'c' || o_custkey END AS "CLIENT",
       o_orderstatus AS "STATUT" FROM orders""",
)
def ingest_parquet_layouts(spark, folder):
    """A column that is a number here, text there and absent elsewhere, under names that differ before cleaning."""
    path = new_folder(spark, "layouts")
    rows = table(spark, folder, "orders").withColumn("annee", F.year("o_orderdate"))
    key, customer, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    text = F.concat(F.lit("c"), customer.cast("string"))
    for rest, columns in (
        (0, [key.alias("Clé commande"), customer.alias("client"), status.alias("Statut")]),
        (1, [text.alias("CLIENT"), status.alias("statut"), key.cast("decimal(18,0)").alias("clé.commande")]),
        (2, [key.cast("int").alias("CLE_COMMANDE"), status.alias("STATUT")]),
    ):
        write_parquet(rows.where(F.col("annee") % 3 == rest).select(*columns), f"{path}/{rest}")
    return mixed.read_mixed(spark, path).select("CLE_COMMANDE", "CLIENT", "STATUT")


def _arrivals(spark, staged, label, read, glob):
    """The staged files in three arrivals, each taken in by a run of its own, and a last run that finds nothing new."""
    path = new_folder(spark, label)
    for rest in (0, 1, 2, None):
        if rest is not None:
            put_files(staged.where(_number() % 3 == rest), f"{path}/source")
        rows, errors = ingest_drifting(
            spark, f"{path}/source", f"{path}/bronze", f"{path}/erreurs", f"{path}/state", read, glob, files_per_batch=200
        )
    return rows, errors


@query(
    "ingest_incremental_workbooks",
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS "MATRICULE", CASE WHEN {_LOT} % 3 = 2 THEN o_orderkey || '||x' END AS "CLE_UNIQUE",
       CASE WHEN {_LOT} % 2 = 1 THEN o_orderpriority END AS "PRIORITE", CAST(o_custkey AS VARCHAR) AS "101_F2",
       {_LOT_NAME} AS "PERIODE", {_LOT_NAME} || '.xlsx' AS "FICHIER_SOURCE" FROM orders WHERE {_LOT} % 7 <> 5""",
)
def ingest_incremental_workbooks(spark, folder):
    """Two-sheet workbooks whose columns and keys change between arrivals; every seventh file is damaged."""
    staged = staged_workbooks(spark, folder, own_keys=True)
    cut = F.substring("content", F.lit(1), F.floor(F.length("content") / 2).cast("int"))
    staged = staged.withColumn("content", F.when(_number() % 7 == 5, cut).otherwise(F.col("content")))
    rows, _ = _arrivals(spark, staged, "arrivals", workbook_reader(pairs=True), "*.xlsx")
    return rows.select("MATRICULE", "CLE_UNIQUE", "PRIORITE", "101_F2", "PERIODE", "FICHIER_SOURCE")


@query(
    "ingest_incremental_errors",
    f"SELECT {_LOT_NAME} || '.xlsx' AS fichier, CAST(1 AS BIGINT) AS nb_erreurs FROM orders WHERE {_LOT} % 7 = 5 GROUP BY {_LOT}",
)
def ingest_incremental_errors(spark, folder):
    """The files that such a run could not take in."""
    staged = staged_workbooks(spark, folder)
    cut = F.substring("content", F.lit(1), F.floor(F.length("content") / 2).cast("int"))
    staged = staged.withColumn("content", F.when(_number() % 7 == 5, cut).otherwise(F.col("content")))
    _, errors = _arrivals(spark, staged, "arrivals", workbook_reader(), "*.xlsx")
    return errors.groupBy("fichier").agg(F.count("*").alias("nb_erreurs"))


@query("ingest_incremental_csv", _CSV_SQL)
def ingest_incremental_csv(spark, folder):
    """CSV files with other columns at each arrival."""
    rows, _ = _arrivals(spark, staged_csv(spark, folder), "arrivals", csv_reader(";", "ISO-8859-1"), "*.csv")
    return rows.select(*_CSV_COLUMNS)


@query(
    "ingest_incremental_parquet",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS "CLE", CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'c' || o_custkey END AS "CLIENT",
       CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS "STATUT" FROM orders""",
)
def ingest_incremental_parquet(spark, folder):
    """Parquet files whose types change between arrivals."""
    path, rows = new_folder(spark, "arrivals"), table(spark, folder, "orders")
    text = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("Client")
    even = rows.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("clé"), F.col("o_custkey").alias("client"))
    odd = rows.where("o_orderkey % 2 = 1").select(text, F.col("o_orderstatus").alias("statut"), F.col("o_orderkey").cast("string").alias("Clé"))
    for name, part in (("a", even), ("b", odd)):
        write_parquet(part, f"{path}/source/{name}")
        bronze, _ = ingest_drifting(
            spark, f"{path}/source", f"{path}/bronze", f"{path}/erreurs", f"{path}/state", parquet_reader(), "*.parquet", files_per_batch=200
        )
    return bronze.select("CLE", "CLIENT", "STATUT")
