"""Spreadsheet workbooks (.xlsx), decoded in executors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions.text import file_name, file_stem
from stratiform.operators.enrich import join_sheets
from stratiform.session import checkpointed
from stratiform.sources.cells import (
    all_names,
    decode_files,
    header_rows,
    named_headers,
    sheet_table,
    stored_headers,
    table_of,
)
from stratiform.sources.files import read_binary

PREVIEW_ROWS = 20
LEGACY_MARK = bytes.fromhex("d0cf11e0a1b11ae1")  # fixed value: first bytes of an .xls file


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _children(element, name: str) -> list:
    return [child for child in element if _tag(child) == name]


def _text(element) -> str:
    """Plain or rich text, without phonetic hints."""
    if len(element) == 1 and _tag(element[0]) == "t":
        return element[0].text or ""
    runs = [element, *_children(element, "r")]
    return "".join(t.text or "" for run in runs for t in _children(run, "t"))


def _finished(node, wanted: Callable[[str], bool], closed: bool) -> Iterator:
    """The wanted elements below a node that are read to their end; whatever is read to its end leaves the tree."""
    children = list(node)
    done = len(children) if closed else max(len(children) - 1, 0)
    for number, child in enumerate(children):
        if not wanted(child.tag):
            yield from _finished(child, wanted, number < done)
        elif number < done:
            yield child
    del node[:done]


def _elements(stream, wanted: Callable[[str], bool]) -> Iterator:
    """The elements whose tags are wanted, as they are read. The tree is looked at piece by piece, not at every element's end."""
    builder = ElementTree.TreeBuilder()
    top, problem = builder.start("document", {}), None
    parser = ElementTree.XMLParser(target=builder)
    while problem is None and (piece := stream.read(1 << 14)):
        try:
            parser.feed(piece)
        except ElementTree.ParseError as error:  # what stands before the error is read
            problem = error
            builder.start("error", {})
        yield from _finished(top, wanted, False)
    if problem is not None:
        raise problem
    parser.close()
    yield from _finished(top, wanted, True)


def _shared_strings(book: zipfile.ZipFile) -> Callable[[int], str]:
    """Shared strings by number, parsed no further than asked for: a preview needs few."""

    def parse() -> Iterator[str]:
        with book.open("xl/sharedStrings.xml") as stream:
            for element in _elements(stream, lambda tag: tag.rpartition("}")[2] == "si"):
                yield _text(element)

    source, known = parse(), []

    def lookup(number: int) -> str:
        while len(known) <= number:
            known.append(next(source))
        return known[number]

    return lookup


def _sheet_files(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(sheet name, file in the archive)`` in workbook order."""
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {link.get("Id"): link.get("Target") for link in links}
    found = []
    for element in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _tag(element) == "sheet":
            link = next(value for key, value in element.attrib.items() if key.endswith("}id"))
            name = target[link]
            found.append((element.get("name"), name.lstrip("/") if name.startswith("/") else f"xl/{name}"))
    return found


@lru_cache(maxsize=20_000)
def _column(letters: str) -> int:
    """0-based column of the letters of a cell reference, such as ``AB``."""
    number = 0
    for letter in letters:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cell(element, shared: Callable[[int], str]) -> str | None:
    kind = element.get("t")
    value = None
    for child in element:
        if child.tag.endswith("}v"):
            value = child.text
        elif child.tag.endswith("}is"):
            return _text(child)
    if kind == "s" and value is not None:
        return shared(int(value))
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return None if kind == "e" else value


def _sheet_rows(stream, shared: Callable[[int], str]) -> Iterator[tuple[int, list]]:
    last = 0
    for element in _elements(stream, lambda tag: tag.endswith("}row")):
        last = int(element.get("r", last + 1))
        cells: list[str | None] = []
        for cell in element:
            reference = cell.get("r")
            if reference:
                gap = _column(reference.rstrip("0123456789")) - len(cells)
                if gap:
                    cells.extend([None] * gap)
            cells.append(_cell(cell, shared) or None)
        yield last, cells


def _first_rows(rows: Iterator[tuple[int, list]], max_rows: int, start: int) -> Iterator[tuple[int | None, list]]:
    """Rows up to ``max_rows``, and the first filled one from ``start`` on at any depth; a row without number if none is filled."""
    filled = header = False
    for row_no, cells in rows:
        if row_no > max_rows and header:
            return
        has = any(cell is not None for cell in cells)
        filled, header = filled or has, header or (has and row_no >= start)
        if row_no <= max_rows or (has and row_no >= start):
            yield row_no, cells
    if not filled:
        yield None, []


def _or_blank(rows: Iterator[tuple[int, list]]) -> Iterator[tuple[int | None, list]]:
    """All rows, and a row without number if none is filled."""
    filled = False
    for row_no, cells in rows:
        filled = filled or any(cell is not None for cell in cells)
        yield row_no, cells
    if not filled:
        yield None, []


def _legacy_sheets(content: bytes, sheet: str | int | None) -> Iterator[tuple]:
    """The older binary format (.xls); pandas reads it where the optional ``xlrd`` is installed."""
    import pandas as pd

    sheets = pd.read_excel(io.BytesIO(content), sheet_name=None, header=None, dtype=str, engine="xlrd")
    for number, (name, frame) in enumerate(sheets.items(), 1):
        if sheet is None or sheet in (name, number):
            rows = enumerate(frame.itertuples(index=False, name=None), 1)
            yield name, number, ((i, [v if isinstance(v, str) and v else None for v in values]) for i, values in rows)


def _sheets(content: bytes, sheet: str | int | None) -> Iterator[tuple]:
    """``(sheet, sheet_no, rows)``; the rows of a sheet are read before the next sheet is asked for."""
    if content.startswith(LEGACY_MARK):
        yield from _legacy_sheets(content, sheet)
        return
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_strings(book)
        for number, (name, member) in enumerate(_sheet_files(book), 1):
            if sheet is None or sheet in (name, number):
                with book.open(member) as stream:
                    yield name, number, _sheet_rows(stream, shared)


def decode_workbook(
    content: bytes,
    sheet: str | int | None = None,
    max_rows: int | None = None,
    start: int | None = None,
    blank: bool = False,
) -> Iterator[tuple]:
    """``(sheet, sheet_no, row_no, cells)`` of one sheet (name, or number from 1) or of all.

    With ``max_rows`` only the first rows, and the first filled row from ``start`` on (row 2 of a second sheet, else row 1)
    wherever it stands; a sheet without a filled row then gives a row without number, as it does with ``blank``.
    """
    for name, number, rows in _sheets(content, sheet):
        if max_rows is not None:
            rows = _first_rows(rows, max_rows, start or (2 if number == 2 else 1))
        elif blank:
            rows = _or_blank(rows)
        for row_no, cells in rows:
            yield name, number, row_no, cells


def workbook_rows(
    files: DataFrame, sheet: str | int | None = None, max_rows: int | None = None, start: int | None = None
) -> DataFrame:
    return decode_files(files, partial(decode_workbook, sheet=sheet, max_rows=max_rows, start=start))


def decoded(files: DataFrame, sheet: str | int | None = None) -> DataFrame:
    """All rows of the sheets, stored, so that headers, data and errors cost one decoding; blank sheets are marked."""
    return checkpointed(decode_files(files, partial(decode_workbook, sheet=sheet, blank=True)))


def workbook_preview(files: DataFrame, sheet: str | int | None = None) -> DataFrame:
    return workbook_rows(files, sheet, PREVIEW_ROWS)


def detect_header_rows(files: DataFrame, token: str = "matricule") -> DataFrame:
    return header_rows(workbook_preview(files), token, PREVIEW_ROWS)


def workbook_table(
    files: DataFrame, sheet_no: int = 1, style: str = "prefix_strip", token: str | None = "matricule", **options
) -> DataFrame:
    """One sheet of every workbook as text columns, headers found by ``token``."""
    rows = decoded(files, sheet_no)
    return table_of(rows, rows, sheet_no, style, token, **options)


def sheet_range(files: DataFrame, sheet: str | int, first_row: int = 1, style: str = "light") -> DataFrame:
    """A named (or numbered) sheet read from an address: the header is at ``first_row``, or the first filled row after it.

    Rows above the address are skipped before the header is taken, as with ``'Sheet'!A3``.
    """

    rows = decoded(files, sheet).withColumn("sheet_no", F.lit(1))
    rows = rows.filter(F.col("error").isNotNull() | (F.col("row_no") >= first_row))
    rows = rows.withColumn("row_no", F.col("row_no") - (first_row - 1))
    return table_of(rows, rows, 1, style, token=None)


def read_workbooks(spark: SparkSession, path: str, **options) -> DataFrame:
    return workbook_table(read_binary(spark, path, "*.{xlsx,xls}"), **options)


def workbook_headers(files: DataFrame, token: str | None = "matricule") -> DataFrame:
    """``(fichier, periode, sheet_no, position, colonne)``: the raw header of every sheet."""
    headers = named_headers(workbook_preview(files), "raw", token, PREVIEW_ROWS)
    return headers.select(
        file_name(F.col("path")).alias("fichier"),
        file_stem(F.col("path")).alias("periode"),
        "sheet_no",
        F.posexplode("raw").alias("position", "colonne"),
    ).filter(F.col("colonne").isNotNull())


_F2_KEY = "(?i)MATRICULE.*[|][|]"


def two_sheets_of(rows: DataFrame, style: str = "prefix_strip", token: str = "matricule", few: bool = False) -> DataFrame:
    """First sheet with the code columns (suffix ``_F2``) of the second, joined inside each file, from decoded rows.

    Keys are found file by file: the second sheet's is its first column whose raw name matches ``MATRICULE...||``, the
    first sheet's ``CLE_UNIQUE``, else ``MATRICULE``. A file without them keeps its agents, with null codes. The headers of
    both sheets are found together. ``few``: the files are those of a bounded batch.
    """
    own = F.coalesce(*(F.nullif(F.array_position("names", F.lit(name)), F.lit(0)) for name in ("CLE_UNIQUE", "MATRICULE")))
    theirs = F.array_position(F.transform("raw", lambda c: F.coalesce(c.rlike(_F2_KEY), F.lit(False))), F.lit(True))
    second = F.col("sheet_no") == 2
    key = F.when(second, theirs).otherwise(own)
    headers = stored_headers(rows.filter(F.col("sheet_no").isin(1, 2)), style, token, 2, key, second, few)
    names = all_names(headers)
    agents, codes = (sheet_table(rows, headers, names.get(no, []), no, keyed=True, few=few) for no in (1, 2))
    codes = codes.drop("PERIODE").where("_cle IS NOT NULL")
    codes = codes.withColumnRenamed("_cle", "_cle2")
    joined = join_sheets(agents, codes, "FICHIER_SOURCE", F.col("_cle"), F.col("_cle2"))
    return joined.drop("_cle", "_cle2_F2")


def two_sheet_table(files: DataFrame, style: str = "prefix_strip", token: str = "matricule") -> DataFrame:
    """Both sheets of every workbook as one table; see ``two_sheets_of``."""
    return two_sheets_of(decoded(files), style, token)
