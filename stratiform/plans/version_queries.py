"""Versioned datasets: orders committed in three steps, with given commit times."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from stratiform.operators.quality import null_rate
from stratiform.operators.versions import VersionedDataset
from stratiform.plans.fixtures import table
from stratiform.plans.registry import query
from stratiform.session import new_folder


def _at(month: int) -> datetime:
    return datetime(2024, month, 1, tzinfo=timezone.utc)


def _rows(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("annee")
    )


_ROWS = "SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS annee FROM orders"


def _committed(spark, folder, commits: int = 3) -> VersionedDataset:
    """Version 1 up to 1996, version 2 up to 1998, version 3 complete."""
    dataset = VersionedDataset(spark, new_folder(spark, "versions"))
    rows = _rows(spark, folder)
    for number, condition in enumerate(["annee <= 1996", "annee IN (1997, 1998)", "annee >= 1999"][:commits], 1):
        dataset.commit(rows.filter(condition), at=_at(number))
    return dataset


@query("version_commit", _ROWS)
def version_commit(spark, folder):
    return _committed(spark, folder).read()


@query("version_as_of", _ROWS + " WHERE year(o_orderdate) <= 1998")
def version_as_of(spark, folder):
    return _committed(spark, folder).as_of_version(2)


@query("version_as_of_timestamp", _ROWS + " WHERE year(o_orderdate) <= 1998")
def version_as_of_timestamp(spark, folder):
    return _committed(spark, folder).as_of_timestamp(datetime(2024, 2, 15, tzinfo=timezone.utc))


@query(
    "version_history",
    """
SELECT CAST(v AS BIGINT) AS version, CAST(CASE WHEN v > 1 THEN v - 1 END AS BIGINT) AS parent, 'main' AS branch,
       strftime(make_date(2024, CAST(v AS INTEGER), 1), '%Y-%m-%d') AS jour, 'append' AS operation,
       (SELECT count(*) FROM orders WHERE year(o_orderdate) <= CASE v WHEN 1 THEN 1996 WHEN 2 THEN 1998 ELSE 9999 END)
       AS n_rows
FROM range(1, 4) AS t(v)""",
)
def version_history(spark, folder):
    log = _committed(spark, folder).history()
    return log.withColumn("jour", F.date_format("committed_at", "yyyy-MM-dd")).drop("committed_at")


@query("version_rollback", _ROWS + " WHERE year(o_orderdate) <= 1996")
def version_rollback(spark, folder):
    dataset = _committed(spark, folder)
    dataset.rollback(1, at=_at(4))
    return dataset.read()


@query(
    "version_diff",
    """
WITH r AS (SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS annee FROM orders),
     changed AS (SELECT * FROM r WHERE annee <= 1998 AND o_orderstatus = 'P')
SELECT o_orderkey, o_totalprice, o_orderstatus, annee, 'SUPPRIME' AS changement, CAST(1 AS BIGINT) AS nb FROM changed
UNION ALL SELECT o_orderkey, o_totalprice, 'F', annee, 'AJOUTE', 1 FROM changed
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, annee, 'AJOUTE', 1 FROM r WHERE annee > 1998""",
)
def version_diff(spark, folder):
    dataset = _committed(spark, folder, commits=2)
    closed = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).when(F.col("annee") > 1998, "P").otherwise("F")
    dataset.commit(_rows(spark, folder).withColumn("o_orderstatus", closed), "overwrite", at=_at(3))
    return dataset.diff(2, 3)


@query(
    "schema_evolution",
    """
SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS annee,
       CASE WHEN year(o_orderdate) >= 1999 THEN o_orderpriority END AS priorite FROM orders""",
)
def schema_evolution(spark, folder):
    dataset = _committed(spark, folder, commits=2)
    wider = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("annee"),
        F.col("o_orderpriority").alias("priorite"),
    )
    dataset.commit(wider.filter("annee >= 1999"), at=_at(3))
    return dataset.read()


@query(
    "version_retention",
    "SELECT CAST(v AS BIGINT) AS version, (SELECT count(*) FROM orders WHERE year(o_orderdate) <= "
    "CASE v WHEN 2 THEN 1998 ELSE 9999 END) AS n_rows FROM range(2, 4) AS t(v)",
)
def version_retention(spark, folder):
    return _committed(spark, folder).retained(_at(2)).select("version", "n_rows")


@query("branch_publish", _ROWS + " WHERE year(o_orderdate) <= 1998 AND o_orderstatus != 'P'")
def branch_publish(spark, folder):
    """The clean branch is published; the one with missing amounts is refused."""
    dataset = _committed(spark, folder, commits=2)

    def complete(rows):
        return null_rate(rows, ["o_orderkey", "o_totalprice"])

    rows = dataset.read().filter("o_orderstatus != 'P'")
    dataset.create_branch("propre", at=_at(3))
    dataset.commit(rows, "overwrite", "propre", at=_at(4))
    dataset.publish("propre", [complete], at=_at(5))
    dataset.create_branch("douteuse", at=_at(6))
    holes = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    dataset.commit(rows.withColumn("o_totalprice", holes), "overwrite", "douteuse", at=_at(7))
    dataset.publish("douteuse", [complete], at=_at(8))
    return dataset.read()
