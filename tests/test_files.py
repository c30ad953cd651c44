import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratiform.plans.staging import workbook_bytes
from stratiform.sinks import files as out
from stratiform.sinks import tables
from stratiform.sources import cells, files, mixed, stata, workbook
from stratiform.streaming.incremental import ingest_new_files
from tests.conftest import rows_of


def put(folder, name, content: bytes):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return path


AGENTS = [["Liste du mois"], [], ["Matricule", "Nom ", "Montant brut", "Montant brut"]]


def month(rows, codes=()):
    return workbook_bytes(
        [("Agents", AGENTS + rows), ("Codes", [["x"], ["MATRICULE||CODE_ORGANISME", "101", "Prime 2"], *codes])]
    )


def test_monthly_workbooks(spark, tmp_path):
    put(tmp_path, "2015_01.xlsx", month([["a1", "Éa & <b>", 10.5, 1], ["a2", None, 20, None]], [["a1", 7, 8]]))
    put(tmp_path, "2015_02.xlsx", workbook_bytes([("F", [["Nom", "MATRICULE", "Grade"], ["Zoé", "a1", "G"]]), ("C", [])]))
    put(tmp_path, "2015_03.xlsx", b"PK not a workbook")
    put(tmp_path, "notes.txt", b"ignored")
    found = files.read_binary(spark, str(tmp_path), "*.xlsx")
    bronze = workbook.workbook_table(found, start=2)
    assert set(bronze.dtypes) == {(c, "string") for c in bronze.columns}
    assert bronze.columns == ["MATRICULE", "NOM", "MONTANT_BRUT", "MONTANT_BRUT_2", "GRADE", "PERIODE", "FICHIER_SOURCE"]
    assert rows_of(bronze) == [
        ("a1", "Zoé", None, None, "G", "2015_02", "2015_02.xlsx"),
        ("a1", "Éa & <b>", "10.5", "1", None, "2015_01", "2015_01.xlsx"),
        ("a2", None, "20", None, None, "2015_01", "2015_01.xlsx"),
    ]
    errors = cells.error_report(workbook.workbook_rows(found)).collect()
    assert [e.path.rsplit("/", 1)[1] for e in errors] == ["2015_03.xlsx"]
    assert "BadZipFile" in errors[0].error
    headers = workbook.detect_header_rows(found)
    seen = {(r.path[-12:], r.sheet): r.header_row for r in headers.collect()}
    assert seen == {("2015_01.xlsx", "Agents"): 3, ("2015_01.xlsx", "Codes"): 2, ("2015_02.xlsx", "F"): 1}


def test_two_sheets_join_inside_their_file(spark, tmp_path):
    put(tmp_path, "2015_01.xlsx", month([["a1", "x", 1, 2], ["a2", "y", 3, 4]], [["a1", 7, 8]]))
    put(tmp_path, "2015_02.xlsx", month([["a1", "x", 5, 6]], [["a2", 9, 9]]))
    bronze = workbook.two_sheet_table(files.read_binary(spark, str(tmp_path), "*.xlsx"))
    got = bronze.select("MATRICULE", "PERIODE", "101_F2", "PRIME_2_F2")
    assert rows_of(got) == [
        ("a1", "2015_01", "7", "8"),
        ("a1", "2015_02", None, None),
        ("a2", "2015_01", None, None),
    ]


def test_cell_kinds(spark, tmp_path):
    sheet = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        '<row r="2"><c r="A2" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c r="C2" t="b"><v>1</v></c>'
        '<c r="AB2" t="str"><f>A1</f><v>calc</v></c></row>'
        '<row><c><v>3.25</v></c><c t="e"><v>#N/A</v></c><c t="s"><v>0</v></c></row></sheetData></worksheet>'
    )
    import zipfile

    buffer = io.BytesIO(workbook_bytes([("S", [["texte"]])]))
    edited = io.BytesIO()
    with zipfile.ZipFile(buffer) as old, zipfile.ZipFile(edited, "w") as new:
        for member in old.namelist():
            new.writestr(member, sheet if member.endswith("sheet1.xml") else old.read(member))
    rows = list(workbook.decode_workbook(edited.getvalue()))
    assert [(r[2], len(r[3])) for r in rows] == [(2, 28), (3, 3)]
    assert rows[0][3][0] == "inline" and rows[0][3][2] == "TRUE" and rows[0][3][27] == "calc"
    assert rows[1][3] == ["3.25", None, "texte"]
    assert list(workbook.decode_workbook(edited.getvalue(), "absent")) == []
    assert len(list(workbook.decode_workbook(edited.getvalue(), 1, max_rows=2))) == 1


def test_old_binary_workbooks_need_their_reader(spark, tmp_path):
    put(tmp_path, "vieux.xls", workbook.LEGACY_MARK + b"rest")
    rows = workbook.workbook_rows(files.read_binary(spark, str(tmp_path), "*.{xlsx,xls}"))
    assert cells.error_report(rows).count() == 1


def test_sheet_address(spark, tmp_path):
    put(tmp_path, "a.xlsx", workbook_bytes([("Un", [["z"]]), ("Deux", [["titre"], ["Col a", "Col.b"], ["1", "2"]])]))
    found = files.read_binary(spark, str(tmp_path), "*.xlsx")
    sheet = workbook.sheet_range(found, "Deux", first_row=2)
    assert sheet.columns[:2] == ["Col_a", "Col_b"]
    assert rows_of(sheet.select("Col_a", "Col_b")) == [("1", "2")]
    assert workbook.sheet_range(found, 2, first_row=1).columns[0] == "titre"


def test_large_sheet_keeps_every_row(spark, tmp_path):
    rows = [[f"m{i}", i] for i in range(3 * cells.BATCH_ROWS + 17)]
    put(tmp_path, "gros.xlsx", workbook_bytes([("S", [["Matricule", "N"], *rows])]))
    table = workbook.read_workbooks(spark, str(tmp_path))
    assert table.count() == len(rows)
    assert table.agg(F.sum(F.col("N").cast("long"))).first()[0] == sum(range(len(rows)))


@pytest.mark.parametrize("sep, encoding", [(";", "ISO-8859-1"), (",", "utf-8"), ("\t", "utf-8")])
def test_csv_files_with_other_columns(spark, tmp_path, sep, encoding):
    put(tmp_path, "2015_01.csv", sep.join(["Clé", "Nom", "Nom"]).encode(encoding) + b"\n" + f'1{sep}"é{sep}""x"""{sep}\n'.encode(encoding))
    put(tmp_path, "2015_02.csv", sep.join(["Nom", "Clé"]).encode(encoding) + b"\n" + f"b{sep}2\n".encode(encoding))
    table = files.read_csv_strings(spark, str(tmp_path), sep, encoding, style="ascii", provenance=True)
    assert rows_of(table.select("CLE", "NOM", "NOM_1", "PERIODE", "FICHIER_SOURCE")) == [
        ("1", f'é{sep}"x"', None, "2015_01", "2015_01.csv"),
        ("2", "b", None, "2015_02", "2015_02.csv"),
    ]


def test_odd_file_names_are_kept(spark, tmp_path):
    put(tmp_path, "2015 01+é%.csv", b"a\n1\n")
    table = files.read_csv_strings(spark, str(tmp_path), provenance=True)
    assert rows_of(table) == [("1", "2015 01+é%", "2015 01+é%.csv")]
    assert files.file_inventory(spark, str(tmp_path)).first().nb_lignes == 1


def test_csv_bom_and_types(spark, tmp_path):
    put(tmp_path, "a.csv", "﻿id;nom;x\n1;été;2.5\n".encode())
    assert files.read_csv_strings(spark, str(tmp_path), ";").columns == ["id", "nom", "x"]
    typed = files.read_csv_inferred(spark, str(tmp_path))
    assert typed.dtypes == [("id", "int"), ("nom", "string"), ("x", "double")]


def test_inventory_and_listing(spark, tmp_path):
    put(tmp_path, "a/x.csv", b"id,nom\n1,a\n2,b\n")
    out.write_parquet(spark.range(5).coalesce(1), str(tmp_path / "p"))
    found = files.file_inventory(spark, str(tmp_path)).drop("cle")
    got = {("csv" if r.fichier.endswith("csv") else "parquet"): r[1:] for r in found.collect()}
    assert got == {"csv": (2, 2, "id|nom"), "parquet": (5, 1, "id")}
    listed = files.list_files(spark, str(tmp_path), ["csv"]).collect()
    assert [(r.fichier, r.extension, r.taille) for r in listed] == [("x.csv", "csv", 15)]


def test_damaged_parquet_is_reported(spark, tmp_path):
    put(tmp_path, "bad.parquet", b"nothing here")
    probed = files.probe_headers(spark, str(tmp_path)).first()
    assert probed.noms is None and probed.erreur


def dta(frame, **options) -> bytes:
    buffer = io.BytesIO()
    frame.to_stata(buffer, write_index=False, version=118, **options)
    return buffer.getvalue()


def test_stata(spark, tmp_path, monkeypatch):
    frame = pd.DataFrame({"sexe": [1, 2, 1], "age": [30.0, None, 41.5], "nom": ["Zoé", "", "b"]})
    put(tmp_path, "enq.dta", dta(frame, value_labels={"sexe": {1: "Masculin", 2: "Féminin"}}, variable_labels={"sexe": "Sexe"}))
    found = files.read_binary(spark, str(tmp_path), "*.dta")
    table = stata.stata_table(found)
    assert rows_of(table.select("SEXE", "AGE", "NOM")) == [("1", "30", "Zoé"), ("1", "41.5", "b"), ("2", None, None)]
    labels = stata.value_labels(found)
    assert rows_of(labels.select("variable", "code", "label")) == [("sexe", "1", "Masculin"), ("sexe", "2", "Féminin")]
    assert ("sexe", "Sexe") in rows_of(stata.variable_labels(found).select("variable", "label"))
    from stratiform.operators.enrich import apply_value_labels

    named = apply_value_labels(table, labels.withColumn("variable", F.upper("variable")), ["SEXE"])
    assert sorted(r.SEXE for r in named.collect()) == ["Féminin", "Masculin", "Masculin"]
    monkeypatch.setattr(stata, "CHUNK_ROWS", 2)
    assert [row[2] for row in stata.decode_stata((tmp_path / "enq.dta").read_bytes())] == [1, 2, 3, 4]


def test_mixed_formats(spark, tmp_path):
    put(tmp_path, "a.csv", b"Matricule,Montant\n1,2\n")
    put(tmp_path, "b.xlsx", workbook_bytes([("S", [["Montant", "Matricule"], [5, "2"]])]))
    put(tmp_path, "c.dta", dta(pd.DataFrame({"matricule": ["3"], "Grade": ["G"]})))
    out.write_parquet(spark.sql("SELECT 4 AS matricule, 1.5D AS montant"), str(tmp_path / "d"))
    table = mixed.read_mixed(spark, str(tmp_path))
    assert rows_of(table.select("MATRICULE", "MONTANT", "GRADE")) == [
        ("1", "2", None),
        ("2", "5", None),
        ("3", None, "G"),
        ("4", "1.5", None),
    ]
    put(tmp_path, "e.pdf", b"x")
    with pytest.raises(ValueError, match="pdf"):
        mixed.read_mixed(spark, str(tmp_path))


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"'), (2, None)], "id int, nom string")
    out.write_csv(df, str(tmp_path / "bom"), bom=True, single_file=True)
    written = [p for p in (tmp_path / "bom").iterdir() if p.suffix == ".csv"]
    assert len(written) == 1 and written[0].read_bytes().startswith(b"\xef\xbb\xbfid;nom\n")
    assert rows_of(files.read_csv_strings(spark, str(tmp_path / "bom"), ";")) == [("1", 'a;"b"'), ("2", None)]
    with pytest.raises(ValueError):
        out.write_csv(df, str(tmp_path / "big"), single_file=True, max_rows=1)
    assert out.write_report(df, str(tmp_path / "report"))
    assert not out.write_report(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_partitioned_write_prunes_and_splits_hot_years(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 2015).otherwise(2000 + F.col("id") % 10).alias("annee"))
    out.write_parquet(df, str(tmp_path / "p"), ["annee"])
    pruned = files.read_parquet(spark, str(tmp_path / "p")).filter("annee = 2003")
    assert "PartitionFilters: [isnotnull(annee" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == df.filter("annee = 2003").count()


@pytest.mark.parametrize("name", ["silver.panel", "Silver.panel_x", "silver.panel-x", "autre.panel_x", "x", "silver.élèves"])
def test_table_names(name):
    if name == "silver.panel":
        assert tables.validate_table_name(name, "panel") == name
        assert tables.validate_table_name("cat.gold.panel_masse", "panel")
        with pytest.raises(ValueError):
            tables.validate_table_name("gold.solde", "panel")
    else:
        with pytest.raises(ValueError):
            tables.validate_table_name(name)


def test_append_aligns_columns(spark, tmp_path):
    tables.overwrite_table(spark.sql("SELECT 1 AS a, 'x' AS b"), "aligned", str(tmp_path / "t"))
    with pytest.raises(ValueError):
        tables.append_table(spark.sql("SELECT 2 AS a, 3 AS c"), "aligned")
    assert rows_of(tables.append_table(spark.sql("SELECT 2 AS a, 3 AS c"), "aligned", strict=False)) == [(1, "x"), (2, None)]


def test_incremental_ingestion_takes_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    rng = random.Random(1)
    schema = spark.sql("SELECT 1L AS id").schema

    def add(name, n):
        put(tmp_path, f"in/{name}.csv", b"id\n" + "".join(f"{rng.randrange(99)}\n" for _ in range(n)).encode())

    options = dict(file_format="csv", files_per_batch=1, header="true")
    add("2015_01", 3), add("2015_02", 4)
    assert ingest_new_files(spark, source, target, state, schema, **options).count() == 7
    assert ingest_new_files(spark, source, target, state, schema, **options).count() == 7
    add("2015_03", 5)
    table = ingest_new_files(spark, source, target, state, schema, **options)
    assert rows_of(table.groupBy("PERIODE").count()) == [("2015_01", 3), ("2015_02", 4), ("2015_03", 5)]
    assert dict(table.dtypes)["id"] == "string"


def test_header_falls_back_to_a_filled_row(spark):
    from stratiform.sources.cells import header_rows

    rows = [
        ("blank_first", 1, 1, [None, None]),
        ("blank_first", 1, 3, ["a", "b"]),
        ("blank_first", 1, 4, ["1", "2"]),
        ("no_first", 1, 5, ["x", None]),
        ("second", 2, 1, ["title", None]),
        ("second", 2, 2, ["code", "name"]),
        ("only_title", 2, 1, ["title", None]),
        ("token", 1, 7, ["Matricule", "n"]),
    ]
    preview = spark.createDataFrame(
        [(path, "s", sheet, row, cells, None) for path, sheet, row, cells in rows],
        "path string, sheet string, sheet_no int, row_no long, cells array<string>, error string",
    )
    found = {r["path"]: r["header_row"] for r in header_rows(preview).collect()}
    assert found == {"blank_first": 3, "no_first": 5, "second": 2, "only_title": 1, "token": 7}


def test_long_csv_header_and_surplus_cells(spark, tmp_path):
    names = [f"une_colonne_{i:040d}" for i in range(30_000)]
    put(tmp_path, "large/x.csv", (",".join(names) + "\n" + ",".join(map(str, range(30_000))) + "\n").encode())
    probed = files.probe_headers(spark, str(tmp_path / "large")).first()
    assert probed.noms == names and probed.erreur is None
    assert files.file_inventory(spark, str(tmp_path / "large")).first().nb_colonnes == 30_000
    table = files.read_csv_strings(spark, str(tmp_path / "large"))
    assert table.select(names[0], names[-1]).first() == ("0", "29999")
    put(tmp_path, "wide/a.csv", b'a,b\n1,2,3\n1\n1,2,,"x,y",z\n1,2,\n')
    put(tmp_path, "wide/b.csv", b"a,b\n1,2\n")
    found = files.surplus_cells(spark, str(tmp_path / "wide")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.lignes, r.cellules) for r in found] == [("a.csv", 2, 3)]


def test_sheets_whose_first_rows_are_blank(spark, tmp_path):
    deep = [[]] * 24 + [["Matricule", "Nom"], ["a1", "x"], ["a2", "y"]]
    put(tmp_path, "deep.xlsx", workbook_bytes([("S", deep), ("C", [["title"], *deep])]))
    put(tmp_path, "good.xlsx", workbook_bytes([("S", deep[24:]), ("C", [["t"], ["Code"], ["7"]])]))
    put(tmp_path, "blank.xlsx", workbook_bytes([("Vide", [])]))
    found = files.read_binary(spark, str(tmp_path), "*.xlsx")
    for token in ("matricule", None):
        table = workbook.workbook_table(found, token=token)
        expected = [(m, n, f) for m, n in (("a1", "x"), ("a2", "y")) for f in ("deep.xlsx", "good.xlsx")]
        assert rows_of(table.select("MATRICULE", "NOM", "FICHIER_SOURCE")) == expected
    seen = {(r.path.rsplit("/", 1)[1], r.sheet): r.header_row for r in workbook.detect_header_rows(found).collect()}
    assert seen == {("deep.xlsx", "S"): 25, ("deep.xlsx", "C"): 26, ("good.xlsx", "S"): 1, ("good.xlsx", "C"): 2}
    errors = cells.error_report(workbook.workbook_preview(found)).collect()
    assert [(e.path.rsplit("/", 1)[1], "Vide" in e.error) for e in errors] == [("blank.xlsx", True)]
    ranged = workbook.sheet_range(found.where("path LIKE '%deep%'"), "S", first_row=3)
    assert rows_of(ranged.select("Matricule", "Nom")) == [("a1", "x"), ("a2", "y")]
