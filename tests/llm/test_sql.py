"""Registered queries with SQL against DuckDB on the same tables, and the pipeline's stages by their rules."""

import os
from pathlib import Path

import pytest

from stratiform.llm.queries import registry

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    answer = connection.execute(registry.SQL[name])
    columns = [c[0] for c in answer.description]
    frame = registry.QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(frame.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=key) == sorted(answer.fetchall(), key=key)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    from stratiform.session import new_folder

    for _, stage in corpus_pipeline.STAGES[:-1]:
        folder = new_folder(spark, "test")
        stage(spark, docs, FOLDER).write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left and left <= ids
        ids = left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count() and last.where("not lossless").count() == 0
