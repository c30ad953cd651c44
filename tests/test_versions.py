from datetime import datetime, timezone
from pathlib import Path

import pytest

from stratiform.operators.quality import null_rate
from stratiform.operators.versions import VersionedDataset
from tests.conftest import rows_of


def at(day):
    return datetime(2024, 1, day, tzinfo=timezone.utc)


@pytest.fixture
def dataset(spark, tmp_path):
    data = VersionedDataset(spark, str(tmp_path / "data"))
    data.commit(spark.sql("SELECT 1 AS id, 'a' AS nom"), at=at(1))
    data.commit(spark.sql("SELECT 2 AS id, 'b' AS nom"), at=at(5))
    return data


def test_time_travel(spark, dataset):
    assert rows_of(dataset.read()) == [(1, "a"), (2, "b")]
    assert rows_of(dataset.as_of_version(1)) == [(1, "a")]
    assert rows_of(dataset.as_of_timestamp(at(4))) == [(1, "a")]
    assert rows_of(dataset.as_of_timestamp(at(5))) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        dataset.as_of_timestamp(datetime(2023, 1, 1, tzinfo=timezone.utc))
    dataset.commit(spark.sql("SELECT 9 AS id"), "overwrite", at=at(6))
    assert rows_of(dataset.read()) == [(9,)]
    dataset.rollback(2, at=at(7))
    assert rows_of(dataset.read()) == [(1, "a"), (2, "b")]
    history = [tuple(r) for r in dataset.history().orderBy("version").select("version", "parent", "operation", "n_rows").collect()]
    assert history == [(1, None, "append", 1), (2, 1, "append", 2), (3, 2, "overwrite", 1), (4, 3, "rollback", 2)]


def test_reading_a_version_touches_only_its_parts(dataset):
    files = dataset.as_of_version(1).inputFiles()
    assert files and all("_version=1/" in name for name in files)


def test_columns_may_be_added_but_not_changed(spark, dataset):
    dataset.commit(spark.sql("SELECT 3 AS id, 2.5D AS montant"), at=at(6))
    assert rows_of(dataset.read()) == [(1, "a", None), (2, "b", None), (3, None, 2.5)]
    assert dataset.as_of_version(2).columns == ["id", "nom"]
    with pytest.raises(ValueError):
        dataset.commit(spark.sql("SELECT 'x' AS id"))


def test_diff_counts_copies(spark, dataset):
    dataset.commit(spark.sql("SELECT 2 AS id, 'b' AS nom"), at=at(6))
    assert rows_of(dataset.diff(1, 3)) == [(2, "b", "AJOUTE", 2)]
    assert rows_of(dataset.diff(3, 2)) == [(2, "b", "SUPPRIME", 1)]
    assert dataset.diff(2, 2).count() == 0


def test_publish_only_after_the_audit(spark, dataset):
    def complete(rows):
        return null_rate(rows, ["nom"])

    dataset.create_branch("essai", at=at(6))
    dataset.commit(spark.sql("SELECT 3 AS id, CAST(NULL AS STRING) AS nom"), "append", "essai", at=at(7))
    done, report = dataset.publish("essai", [complete], at=at(8))
    assert not done and report.count() == 1
    assert dataset.read().count() == 2 and dataset.read("essai").count() == 3
    dataset.commit(spark.sql("SELECT 3 AS id, 'c' AS nom"), "overwrite", "essai", at=at(9))
    done, _ = dataset.publish("essai", [complete], at=at(10))
    assert done and rows_of(dataset.read()) == [(3, "c")]
    assert set(dataset.branches()) == {"main"}
    with pytest.raises(ValueError):
        dataset.read("essai")


def test_merge_refuses_a_moved_target(spark, dataset):
    dataset.create_branch("essai", at=at(6))
    dataset.commit(spark.sql("SELECT 3 AS id, 'c' AS nom"), branch="essai", at=at(7))
    dataset.commit(spark.sql("SELECT 4 AS id, 'd' AS nom"), at=at(8))
    with pytest.raises(ValueError):
        dataset.merge("essai")


def test_a_taken_version_number_fails(spark, dataset):
    first = dataset.commits()[-1]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        dataset._append(first)


def test_a_commit_that_failed_half_way_is_no_hindrance(spark, dataset):
    lost = spark.sql("SELECT 77 AS id, 'z' AS nom")
    lost.write.parquet(dataset._part(3))  # the part without its entry
    Path(dataset.path, "log", f"{3:012d}", "_temporary", "0").mkdir(parents=True)  # the entry, never finished
    assert rows_of(dataset.read()) == [(1, "a"), (2, "b")]
    assert dataset.commit(spark.sql("SELECT 3 AS id, 'c' AS nom"), at=at(6)).version == 3
    assert dataset.commit(spark.sql("SELECT 4 AS id, 'd' AS nom"), at=at(7)).version == 4
    assert rows_of(dataset.read()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert rows_of(dataset.as_of_version(3)) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows_of(dataset.diff(2, 3)) == [(3, "c", "AJOUTE", 1)]
    assert [r.version for r in dataset.history().orderBy("version").collect()] == [1, 2, 3, 4]


def test_retention_keeps_heads(dataset):
    assert [r.version for r in dataset.retained(at(3)).collect()] == [2]
    assert [r.version for r in dataset.retained(at(30)).collect()] == [2]
