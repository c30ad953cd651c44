"""Bronze ingestion of the files that arrived since the last run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.functions.casts import to_strings
from stratiform.functions.text import file_extension, file_name, file_stem, metadata_path
from stratiform.session import checkpointed
from stratiform.sources.cells import error_report, table_of
from stratiform.sources.files import file_errors, probe_files, read_csv_strings, read_parquet_strings
from stratiform.sources.workbook import decoded, two_sheets_of

FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: Folder of a batch; a cleaned column name never ends in two underscores.
BATCH = "lot__"

#: From the new files of a batch (``path, length, content``) to their rows as text and ``(path, error)`` of the others.
Reader = Callable[[DataFrame], tuple[DataFrame | None, DataFrame]]


def ingest_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    state: str,
    schema: T.StructType,
    file_format: str = "parquet",
    files_per_batch: int = 1_000,
    **options: str,
) -> DataFrame:
    """Append the unseen files below ``source`` to the text table at ``target``.

    ``state`` remembers the files already taken. The file sink commits whole batches, so a
    batch that is run again after a failure leaves no duplicate rows. All files have one schema: a CSV file with another
    header stops the run; ``ingest_drifting`` takes files that differ.
    """
    if file_format == "csv":
        # A file whose header differs from the schema stops the run instead of shifting its values.
        options = {"enforceSchema": "false"} | options
    stream = (
        spark.readStream.format(file_format)
        .schema(schema)
        .options(**options)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .load(source)
    )
    path = metadata_path()
    named = stream.select("*", file_stem(path).alias("PERIODE"), file_name(path).alias("FICHIER_SOURCE"))
    run = (
        to_strings(named)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(to_strings(named).schema).parquet(target)


def workbook_reader(style: str = "prefix_strip", token: str | None = "matricule", pairs: bool = False) -> Reader:
    """Workbooks whose headers are found file by file, each decoded once; ``pairs`` joins the second sheet's codes."""

    def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = decoded(files, None if pairs else 1)
        table = two_sheets_of(rows, style, token, few=True) if pairs else table_of(rows, rows, 1, style, token, few=True)
        return table, error_report(rows)

    return read


def _path_reader(read_paths: Callable[[SparkSession, list[str], DataFrame], DataFrame], sep: str, encoding: str) -> Reader:
    """A reader by path, so that contents are only read by Spark's own readers; headers are probed once and stored."""

    def read(files: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        paths = [row.path for row in files.select("path").collect()]  # the files of a batch
        listed = files.where("length > 0").select("path", file_extension(F.col("path")).alias("extension"))
        probed = checkpointed(probe_files(listed.where(F.col("extension").isin("parquet", "csv")), sep, encoding))
        errors = file_errors(files.sparkSession, paths, sep, encoding, probed)
        try:
            return read_paths(files.sparkSession, paths, probed), errors
        except FileNotFoundError:  # every file is in the errors
            return None, errors

    return read


def csv_reader(sep: str = ",", encoding: str = "utf-8", style: str = "ascii") -> Reader:
    """CSV files whose columns differ from file to file."""

    def read_paths(spark: SparkSession, paths: list[str], probed: DataFrame) -> DataFrame:
        return read_csv_strings(spark, paths, sep, encoding, style, provenance=True, probed=probed)

    return _path_reader(read_paths, sep, encoding)


def parquet_reader(style: str = "ascii") -> Reader:
    """Parquet files whose columns and types differ from file to file."""
    return _path_reader(lambda spark, paths, probed: read_parquet_strings(spark, paths, style, probed=probed), ",", "utf-8")


def _of_cluster(problem: Exception) -> bool:
    """Whether a failure says nothing about the file that was being read."""
    return any(sign in str(problem) for sign in ("ExecutorLostFailure", "FetchFailed", "OutOfMemoryError"))


def _apart(files: DataFrame, read: Reader) -> tuple[DataFrame | None, DataFrame]:
    """The files of a batch read one by one, so that one which fails while its data are read spoils no other."""
    sound, failed = [], []
    for path in [row.path for row in files.select("path").collect()]:  # the files of a batch
        try:
            table, _ = read(files.where(F.col("path") == path))
            if table is not None:
                table.write.format("noop").mode("overwrite").save()
            sound.append(path)
        except Exception as problem:
            if _of_cluster(problem):
                raise
            failed.append((path, f"{type(problem).__name__}: {str(problem)[:2_000]}"))
    table, errors = read(files.where(F.col("path").isin(sound))) if sound else (None, None)
    failed = files.sparkSession.createDataFrame(failed, "path string, error string")
    return table, failed if errors is None else errors.unionAll(failed)


@contextmanager
def _listing_by_cores(spark: SparkSession) -> Iterator[None]:
    """Files of a batch are listed by as many tasks as there are cores, not by one task a file."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(spark.sparkContext.defaultParallelism, 1))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _spelled_as(table: DataFrame, target: str) -> DataFrame:
    """Columns as the target spells them already, where only case differs."""
    if all(name == name.upper() for name in table.columns):
        return table
    known = {name.casefold(): name for name in read_batches(table.sparkSession, target, []).columns}
    return table.withColumnsRenamed({name: known[name.casefold()] for name in table.columns if name.casefold() in known})


def read_batches(spark: SparkSession, target: str, columns: list[str]) -> DataFrame:
    """All batches below ``target`` with the columns of all; an empty table of ``columns`` before the first one."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(target).drop(BATCH)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([T.StructField(name, T.StringType()) for name in columns]))


def ingest_drifting(
    spark: SparkSession,
    source: str,
    target: str,
    errors: str,
    state: str,
    read: Reader,
    glob: str = "*.{xlsx,xls}",
    files_per_batch: int = 12,
) -> tuple[DataFrame, DataFrame]:
    """Add the unseen files below ``source`` to the text table at ``target``; the table, and ``(path, error)`` of bad files.

    Columns may differ from file to file: names are resolved per file, and the table has every column seen so far, null
    where a file lacks it. A file that can't be read becomes a row of the table at ``errors``, and the run goes on. ``state``
    remembers the files taken, by path. A batch is written under its number: run again after a failure, it
    replaces what it left, so nothing is added twice. No new file changes nothing.
    """

    def write(table: DataFrame | None, bad: DataFrame, number: int) -> None:
        bad = bad.withColumn("fichier", file_name(F.col("path")))
        bad.write.mode("overwrite").parquet(f"{errors}/{BATCH}={number}")
        if table is not None:
            _spelled_as(table, target).write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")

    def take(batch: DataFrame, number: int) -> None:
        files = batch.select("path", "length", "content")
        try:
            write(*read(files), number)
        except Exception as problem:
            if _of_cluster(problem):
                raise
            write(*_apart(files, read), number)

    stream = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", str(files_per_batch))
        .load(source)
    )
    with _listing_by_cores(spark):
        run = stream.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    return read_batches(spark, target, ["PERIODE", "FICHIER_SOURCE"]), read_batches(spark, errors, ["path", "error", "fichier"])
