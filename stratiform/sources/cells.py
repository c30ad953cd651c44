"""From decoded cell rows ``(path, sheet, sheet_no, row_no, cells, error)`` to named columns.

Workbook and Stata decoders both produce this relation; one file is decoded by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.functions.names import clean_names
from stratiform.operators.enrich import lookup_join
from stratiform.operators.headers import add_provenance
from stratiform.session import checkpointed, ship_package

CELL_ROWS = "path string, sheet string, sheet_no int, row_no bigint, cells array<string>, error string"
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("sheet", pa.string()),
        ("sheet_no", pa.int32()),
        ("row_no", pa.int64()),
        ("cells", pa.list_(pa.string())),
        ("error", pa.string()),
    ]
)
BATCH_ROWS = 4_096

Row = tuple[str, int, int, list]


def _batch(path: str, rows: list[Row]) -> pa.RecordBatch:
    sheet, sheet_no, row_no, cells = zip(*rows)
    columns = [[path] * len(rows), sheet, sheet_no, row_no, cells, [None] * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def decode_files(files: DataFrame, decode: Callable[[bytes], Iterable[Row]]) -> DataFrame:
    """Run a decoder over ``(path, content)``. A file that fails gives one row with its error.

    Rows leave the task only when their whole file is decoded: a bad file adds none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                done, rows = [], []
                try:
                    for row in decode(content.as_py()):
                        rows.append(row)
                        if len(rows) == BATCH_ROWS:
                            done.append(_batch(path, rows))
                            rows = []
                    if rows:
                        done.append(_batch(path, rows))
                except Exception as problem:  # reported by error_report
                    failed = [[path], [None], [None], [None], [None], [f"{type(problem).__name__}: {problem}"]]
                    done = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(failed, _ARROW)], schema=_ARROW)]
                yield from done

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, CELL_ROWS)


def error_report(rows: DataFrame) -> DataFrame:
    """``(path, error)`` of the files that could not be decoded and, of a preview, of each sheet without a header."""
    blank = F.concat(F.lit("no header: sheet "), F.col("sheet"), F.lit(" has no filled row"))
    error = F.coalesce("error", F.when(F.col("row_no").isNull(), blank))
    return rows.select("path", error.alias("error")).filter(F.col("error").isNotNull())


def header_rows(preview: DataFrame, token: str | None = "matricule", depth: int = 20) -> DataFrame:
    """``(path, sheet, sheet_no, header_row)``: first row of the top ``depth`` with the token.

    Without a hit the header is the first row with a cell from row 1 on, or from row 2 on the second sheet, at any depth;
    a sheet with rows above that only takes its first one.
    """
    top = preview.filter(F.col("error").isNull())
    default = F.when(F.col("sheet_no") == 2, 2).otherwise(1).cast("long") if token else F.lit(1).cast("long")
    hit = F.exists("cells", lambda c: F.lower(c).contains(token)) & (F.col("row_no") <= depth) if token else F.lit(False)
    filled = F.exists("cells", lambda c: c.isNotNull())
    first = lambda rule: F.min(F.when(rule, F.col("row_no")))
    chosen = F.coalesce(first(hit), first(filled & (F.col("row_no") >= default)), first(filled))
    return top.groupBy("path", "sheet", "sheet_no").agg(chosen.alias("header_row")).where("header_row is not null")


def _join_headers(rows: DataFrame, headers: DataFrame, on, few: bool) -> DataFrame:
    """Inner join with one row per sheet; ``few`` sheets, as those of a bounded batch, are broadcast without counting them."""
    return rows.join(F.broadcast(headers), on) if few else lookup_join(rows, headers, on, "inner")


def named_headers(
    preview: DataFrame, style: str, token: str | None, depth: int = 20, start: int = 1, few: bool = False
) -> DataFrame:
    """``(path, sheet_no, header_row, raw, names)``: one row per sheet, names clean and unique."""

    @F.pandas_udf("array<string>")
    def names(cells: pd.Series) -> pd.Series:  # one value per sheet: its header
        return cells.map(lambda c: clean_names(list(c), style, start))

    found = header_rows(preview, token, depth).drop("sheet")
    cells = preview.select("path", "sheet_no", F.col("row_no").alias("header_row"), F.col("cells").alias("raw"))
    return _join_headers(cells, found, ["path", "sheet_no", "header_row"], few).withColumn("names", names("raw"))


def stored_headers(
    preview: DataFrame,
    style: str,
    token: str | None,
    start: int = 1,
    key: Column | None = None,
    drop_key: Column | bool = False,
    few: bool = False,
) -> DataFrame:
    """``named_headers`` with the place (from 1) of each sheet's ``key`` column, stored; ``drop_key`` takes its name away."""
    headers = named_headers(preview, style, token, start=start, few=few)
    at = (key if key is not None else F.lit(None)).cast("int")
    headers = headers.withColumn("key", F.when(at > 0, at))
    if drop_key is not False:
        gone = lambda i: F.lit(drop_key) & (i + 1).eqNullSafe(F.col("key"))
        headers = headers.withColumn("names", F.transform("names", lambda n, i: F.when(gone(i), F.lit(None)).otherwise(n)))
    return checkpointed(headers)


def all_names(headers: DataFrame) -> dict[int, list[str]]:
    """Distinct names over all files by sheet, in order of first appearance; of spellings that differ by case the first one."""
    seen = headers.select("sheet_no", "path", F.posexplode("names").alias("pos", "name")).where("name IS NOT NULL")
    first = seen.groupBy("sheet_no", F.lower("name").alias("folded")).agg(F.min(F.struct("path", "pos", "name")).alias("at"))
    names: dict[int, list[str]] = {}
    for row in sorted(first.collect(), key=lambda row: row.at):
        names.setdefault(row.sheet_no, []).append(row.at.name)
    return names


def table_of(
    rows: DataFrame,
    preview: DataFrame,
    sheet_no: int = 1,
    style: str = "prefix_strip",
    token: str | None = "matricule",
    start: int = 1,
    provenance: bool = True,
    key: Column | None = None,
    drop_key: bool = False,
    few: bool = False,
) -> DataFrame:
    """One text column per header name over all files; a file without the column gives null.

    ``preview`` holds the first rows of each sheet, down to a filled one, or all rows. Its headers, one row per sheet, are
    stored. The place of each column is worked out once per sheet, so a data row only picks its cells. ``key``, over
    ``raw`` and ``names`` of a sheet's header, gives the place (from 1) of a column whose cells become ``_cle``;
    ``drop_key`` leaves that column out of the others, file by file. ``few``: the files are those of a bounded batch.
    """
    headers = stored_headers(preview.filter(F.col("sheet_no") == sheet_no), style, token, start, key, drop_key, few)
    return sheet_table(rows, headers, all_names(headers).get(sheet_no, []), sheet_no, provenance, key is not None, few)


def sheet_table(
    rows: DataFrame,
    headers: DataFrame,
    names: list[str],
    sheet_no: int,
    provenance: bool = True,
    keyed: bool = False,
    few: bool = False,
) -> DataFrame:
    """The table of one sheet, whose columns are ``names``, by the stored headers of that sheet or of several."""
    wanted = F.array(*[F.lit(name.lower()) for name in names]).cast("array<string>")
    folded = F.transform("names", lambda n: F.lower(n))
    places = headers.filter(F.col("sheet_no") == sheet_no).withColumn("names", folded).select(
        "path",
        "header_row",
        (F.col("key") - 1).alias("key"),
        F.transform(wanted, lambda n: F.array_position("names", n).cast("int") - 1).alias("places"),
    )
    data = rows.filter((F.col("sheet_no") == sheet_no) & F.col("error").isNull())
    picked = (
        _join_headers(data, places, "path", few)
        .filter(F.col("row_no") > F.col("header_row"))
        .filter(F.exists("cells", lambda c: c.isNotNull()))
        .select(
            "path",
            F.get("cells", F.col("key")).alias("_cle"),
            F.transform("places", lambda i: F.get(F.col("cells"), i)).alias("v"),
        )
    )
    extra = ["_cle"] if keyed else []
    table = picked.select("path", *extra, *[F.col("v")[i].alias(name) for i, name in enumerate(names)])
    return add_provenance(table, "path").drop("path") if provenance else table.drop("path")
