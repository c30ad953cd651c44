"""Staging material for the file queries, built by Spark tasks out of the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from functools import partial
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.plans.fixtures import table
from stratiform.session import new_folder, ship_package

ORDERS_PER_FILE = 700

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _letters(column: int) -> str:
    text = ""
    while column >= 0:
        text = chr(65 + column % 26) + text
        column = column // 26 - 1
    return text


def _cell_xml(value, reference: str, strings: dict[str, int]) -> str:
    if value is None:
        return ""
    if isinstance(value, (int, float)):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    return f'<c r="{reference}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'


def workbook_bytes(sheets: Sequence[tuple[str, Sequence[Sequence]]]) -> bytes:
    """A small workbook with shared strings; None leaves a cell out."""
    strings: dict[str, int] = {}
    parts, entries, links = {}, [], []
    for number, (name, rows) in enumerate(sheets, 1):
        body = "".join(
            f'<row r="{r}">' + "".join(_cell_xml(v, f"{_letters(c)}{r}", strings) for c, v in enumerate(row)) + "</row>"
            for r, row in enumerate(rows, 1)
        )
        parts[f"xl/worksheets/sheet{number}.xml"] = f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'
        entries.append(f'<sheet name="{escape(name)}" sheetId="{number}" r:id="rId{number}"/>')
        links.append(f'<Relationship Id="rId{number}" Target="worksheets/sheet{number}.xml"/>')
    parts["xl/workbook.xml"] = (
        f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{"".join(entries)}</sheets></workbook>'
    )
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}">{"".join(links)}</Relationships>'
    texts = "".join(f'<si><t xml:space="preserve">{escape(text)}</t></si>' for text in strings)
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_MAIN}">{texts}</sst>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for member, text in parts.items():
            book.writestr(member, text)
    return out.getvalue()


def _workbook(orders: pd.DataFrame, own_keys: bool = False) -> pd.DataFrame:
    """Title rows above the header; every other file has one more column.

    With ``own_keys`` a third of the files join their sheets by a key of their own, and spell the second sheet's otherwise.
    """
    orders = orders.sort_values("o_orderkey")
    number = int(orders["lot"].iloc[0])
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"] + ["o_orderpriority"] * (number % 2)
    header = ["Matricule", "N°-Client", "Situation", "Montant brut", "Priorité"][: len(columns)]
    agents = orders[columns].astype(object).values.tolist()
    keys = [f"{order}" for order in orders["o_orderkey"]]
    codes = [[key, int(c), float(p)] for key, c, p in zip(keys, orders["o_custkey"], orders["o_totalprice"])]
    agents = [[str(row[0]), *row[1:]] for row in agents]
    key = "MATRICULE||CODE_ORGANISME"
    if own_keys and number % 3 == 2:
        header, agents = [*header, "Clé unique"], [[*row, f"{row[0]}||x"] for row in agents]
        key, codes = "matricule||code organisme", [[f"{row[0]}||x", *row[1:]] for row in codes]
    sheets = [
        ("Agents", [[f"Lot {number}"], []][: number % 3] + [header] + agents),
        ("Codes", [["Codes de paie"], [key, "101", "102"], *codes]),
    ]
    return pd.DataFrame({"path": [f"staging/lot_{number:09d}.xlsx"], "content": [workbook_bytes(sheets)]})


def _stata(orders: pd.DataFrame) -> pd.DataFrame:
    number = int(orders["lot"].iloc[0])
    data = pd.DataFrame(
        {
            "matricule": orders["o_orderkey"].astype("int32"),
            "statut": orders["o_orderstatus"].map({"F": 1, "O": 2, "P": 3}).astype("int8"),
            "montant": orders["o_totalprice"],
        }
    ).sort_values("matricule")
    out = io.BytesIO()
    labels = {"statut": {1: "Fermé", 2: "Ouvert", 3: "Partiel"}}
    data.to_stata(out, write_index=False, version=118, value_labels=labels, variable_labels={"statut": "Statut"})
    return pd.DataFrame({"path": [f"staging/lot_{number:09d}.dta"], "content": [out.getvalue()]})


def _staged(spark: SparkSession, folder: str, build, label: str) -> DataFrame:
    """Whole ``orders`` as files of a bounded number of rows, in the shape of ``binaryFile``."""
    orders = table(spark, folder, "orders").withColumn("lot", F.floor(F.col("o_orderkey") / ORDERS_PER_FILE))
    path = new_folder(spark, label)
    ship_package(spark)
    orders.drop("o_orderdate").groupBy("lot").applyInPandas(build, "path string, content binary").write.parquet(path)
    return spark.read.parquet(path)


def staged_workbooks(spark: SparkSession, folder: str, own_keys: bool = False) -> DataFrame:
    return _staged(spark, folder, partial(_workbook, own_keys=own_keys), "workbooks")


def _uneven_csv(orders: pd.DataFrame) -> pd.DataFrame:
    """Records with line breaks in quotes, a first line of empty cells, or a very long header cell, by turns."""
    import csv

    number = int(orders["lot"].iloc[0])
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    long_name = "Remarque " + "x" * 200_000
    columns = {
        0: ["Clé", "Situation", "Priorité"],
        1: ["Situation", "Clé"],
        2: ["Clé", long_name, "Situation"],
    }[number % 3]
    if number % 3 == 1:
        writer.writerow(["", ""])
    writer.writerow(columns)
    for row in orders.sort_values("o_orderkey").itertuples():
        cells = {"Clé": row.o_orderkey, "Situation": row.o_orderstatus, "Priorité": f"{row.o_orderpriority}\n\"{row.o_orderstatus}\"", long_name: "r"}
        writer.writerow([cells[c] for c in columns])
    return pd.DataFrame({"path": [f"staging/lot_{number:09d}.csv"], "content": [out.getvalue().encode("latin-1")]})


def staged_csv(spark: SparkSession, folder: str) -> DataFrame:
    return _staged(spark, folder, _uneven_csv, "csv")


def staged_stata(spark: SparkSession, folder: str) -> DataFrame:
    return _staged(spark, folder, _stata, "stata")


def put_files(staged: DataFrame, folder: str) -> None:
    """Writes each staged ``content`` as a file of its own below a folder, from the tasks that hold it."""

    def put(batches):
        from urllib.parse import quote

        from pyarrow import fs

        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                target = f"{folder}/{path.rsplit('/', 1)[-1]}"
                if "://" in target or target.startswith("file:"):
                    system, name = fs.FileSystem.from_uri(quote(target, safe=":/@"))
                else:
                    system, name = fs.LocalFileSystem(), target
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(name) as out:
                    out.write(content)
            yield files[["path"]]

    ship_package(staged.sparkSession)
    staged.mapInPandas(put, "path string").write.format("noop").mode("overwrite").save()
