"""Stata files (.dta), decoded in executors with their value labels."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from stratiform.sources.cells import decode_files, table_of
from stratiform.sources.files import read_binary

CHUNK_ROWS = 50_000


def _as_text(value) -> str | None:
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value) if value != "" else None


def decode_stata(content: bytes, max_rows: int | None = None) -> Iterator[tuple]:
    """Row 1 holds the variable names, the data follow: the layout of a sheet."""
    with pd.read_stata(io.BytesIO(content), chunksize=CHUNK_ROWS, convert_categoricals=False) as reader:
        row_no = 1
        for chunk in reader:
            if row_no == 1:
                yield "data", 1, 1, list(chunk.columns)
            if max_rows is not None:
                chunk = chunk.head(max_rows)
            for values in chunk.itertuples(index=False, name=None):
                row_no += 1
                yield "data", 1, row_no, [_as_text(value) for value in values]
            if max_rows is not None:
                return


def decode_labels(content: bytes) -> Iterator[tuple]:
    """``(variable, code, label)`` and the variable labels, as cell rows."""
    with pd.read_stata(io.BytesIO(content), iterator=True, convert_categoricals=False) as reader:
        sets, described = reader.value_labels(), reader.variable_labels()
        # Label sets are named after their variable unless the file says otherwise.
        names = dict(zip(described, getattr(reader, "_lbllist", described)))
    for row_no, (variable, label) in enumerate(described.items(), 1):
        yield "variables", 1, row_no, [variable, label]
        for code, text in sets.get(names.get(variable, variable), {}).items():
            yield "values", 2, row_no, [variable, str(code), text]


def stata_table(files: DataFrame, style: str = "ascii", **options) -> DataFrame:
    rows = decode_files(files, decode_stata)
    preview = decode_files(files, lambda content: decode_stata(content, max_rows=0))
    return table_of(rows, preview, 1, style, token=None, **options)


def value_labels(files: DataFrame) -> DataFrame:
    """``(path, variable, code, label)`` for ``apply_value_labels``."""
    rows = decode_files(files, decode_labels).filter("sheet = 'values'")
    return rows.selectExpr("path", "cells[0] AS variable", "cells[1] AS code", "cells[2] AS label")


def variable_labels(files: DataFrame) -> DataFrame:
    rows = decode_files(files, decode_labels).filter("sheet = 'variables'")
    return rows.selectExpr("path", "cells[0] AS variable", "cells[1] AS label")


def read_stata_files(spark: SparkSession, path: str, **options) -> DataFrame:
    return stata_table(read_binary(spark, path, "*.dta"), **options)
