"""One Bronze table out of files of several formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratiform.operators.headers import union_all
from stratiform.session import checkpointed
from stratiform.sources.cells import decode_files, error_report, table_of
from stratiform.sources.files import file_errors, list_files, read_binary, read_csv_strings, read_parquet_strings
from stratiform.sources.stata import decode_stata
from stratiform.sources.workbook import decoded

SUPPORTED = ("csv", "parquet", "xlsx", "xls", "dta")


def read_mixed_reported(
    spark: SparkSession,
    path: str,
    style: str = "ascii",
    sep: str = ",",
    encoding: str = "utf-8",
    token: str | None = None,
    strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Every supported file below a path as text columns with provenance, and ``(path, error)`` of those left out.

    Columns are united by name. Workbook headers are on row 1 unless ``token`` says how to find them. ``strict``
    refuses a folder that holds a file of another format.
    """
    seen = {row.extension for row in list_files(spark, path).select("extension").distinct().collect()}
    unknown = sorted(seen - set(SUPPORTED) - {"", "crc"})
    if strict and unknown:
        raise ValueError(f"unsupported formats: {unknown}")
    tables, errors = [], []
    if seen & {"csv", "parquet"}:
        errors.append(file_errors(spark, path, sep, encoding))
    readers = {
        "csv": lambda: read_csv_strings(spark, path, sep, encoding, style, provenance=True),
        "parquet": lambda: read_parquet_strings(spark, path, style, sep, encoding),
    }
    for name in ("csv", "parquet"):
        if name in seen:
            try:
                tables.append(readers[name]())
            except FileNotFoundError:  # every file of the format is in the errors
                continue
    cell_rows = []
    if seen & {"xlsx", "xls"}:
        cell_rows.append(decoded(read_binary(spark, path, "*.{xlsx,xls}"), 1))
    if "dta" in seen:
        cell_rows.append(checkpointed(decode_files(read_binary(spark, path, "*.dta"), decode_stata)))
    for number, rows in enumerate(cell_rows):
        sheet_token = token if number == 0 and seen & {"xlsx", "xls"} else None
        tables.append(table_of(rows, rows, 1, style, sheet_token))
        errors.append(error_report(rows))
    if not tables:
        raise FileNotFoundError(f"no readable file below {path}")
    return union_all(tables), union_all(errors)


def read_mixed(spark: SparkSession, path: str, style: str = "ascii", *args, **options) -> DataFrame:
    """The table of ``read_mixed_reported``."""
    return read_mixed_reported(spark, path, style, *args, **options)[0]
