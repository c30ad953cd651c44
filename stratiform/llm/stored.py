"""Sessions for Python tasks over texts, and intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratiform.session import new_folder, ship_package

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch where the session leaves Spark's default: whole texts are long, and a task holds a batch.
BATCH_ROWS, SPARK_ROWS = "1000", "10000"


def prepare(spark: SparkSession) -> None:
    """Readies a session for operators that run Python tasks over whole texts."""
    ship_package(spark)
    if spark.conf.get(ROWS, SPARK_ROWS) == SPARK_ROWS:
        spark.conf.set(ROWS, BATCH_ROWS)


#: Parquet rows that a task gathers before it writes them, in bytes, for tables that carry whole texts.
ROW_GROUP = 32 << 20


def write_texts(df: DataFrame, folder: str) -> None:
    """Writes a table of whole texts; a task holds a smaller row group of them than Spark's default of 128 MB."""
    df.write.option("parquet.block.size", ROW_GROUP).parquet(folder)


def stored(df: DataFrame, label: str, texts: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    The result outlives its executors, and the shuffle files of the steps that made it go as soon as it is written.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        write_texts(df, folder) if texts else df.write.parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.parquet(folder)
    out.stored_in = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that ``stored`` returned and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_in)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
