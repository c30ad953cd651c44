"""Files that differ, and runs over files as they arrive."""

import pytest
from pyspark.sql import functions as F

from stratiform.plans import jobs
from stratiform.plans.staging import workbook_bytes
from stratiform.sinks import files as out
from stratiform.sources import files, mixed, workbook
from stratiform.streaming import incremental
from stratiform.streaming.incremental import csv_reader, ingest_drifting, parquet_reader, workbook_reader
from tests.conftest import rows_of
from tests.test_files import put


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    put(tmp_path, "a.csv", b'id,nom\n1,"A\nB"\n2,C\n3,"x ""y"" z"\n')
    put(tmp_path, "b.csv", b'id,nom\n4,5" tuyau\n')
    put(tmp_path, "c.csv", b'nom,id\r\n"d\r\ne",5\r\n')
    expected = [("1", "A\nB"), ("2", "C"), ("3", 'x "y" z'), ("4", '5" tuyau'), ("5", "d\r\ne")]
    got = [(i, n.replace("\r\n", "\n") if i == "5" else n) for i, n in rows_of(files.read_csv_strings(spark, str(tmp_path)).select("id", "nom"))]
    assert got == [(i, n.replace("\r\n", "\n")) for i, n in expected]
    counts = {r.fichier: r.nb_lignes for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert counts == {"a.csv": 3, "b.csv": 1, "c.csv": 1}


def test_csv_records_above_the_header(spark, tmp_path):
    put(tmp_path, "a.csv", b'\n,,\n ,,\nid,nom,x\n1,a,\nid,nom,x\n2,"b\nc",3,4\n')
    put(tmp_path, "b.csv", b"x,id,nom\n9,3,d\n")
    table = files.read_csv_strings(spark, str(tmp_path), style="ascii", provenance=True)
    assert rows_of(table.select("ID", "NOM", "X", "FICHIER_SOURCE")) == [
        ("1", "a", None, "a.csv"),
        ("2", "b\nc", "3", "a.csv"),
        ("3", "d", "9", "b.csv"),
        ("id", "nom", "x", "a.csv"),
    ]
    assert [(r.lignes, r.cellules) for r in files.surplus_cells(spark, str(tmp_path)).collect()] == [(1, 1)]
    assert {r.fichier: r.nb_lignes for r in files.file_inventory(spark, str(tmp_path)).collect()} == {"a.csv": 3, "b.csv": 1}


def test_csv_errors_are_listed_and_long_headers_read(spark, tmp_path):
    name = "n" * 200_000
    put(tmp_path, "a.csv", f"id,{name}\n1,2\n".encode())
    put(tmp_path, "vide.csv", b"\n,,\n \n")
    table = files.read_csv_strings(spark, str(tmp_path))
    assert rows_of(table.select("id", name)) == [("1", "2")]
    errors = files.file_errors(spark, str(tmp_path)).collect()
    assert [e.path.rsplit("/", 1)[1] for e in errors] == ["vide.csv"]


def test_parquet_files_of_other_types(spark, tmp_path):
    out.write_parquet(spark.sql("SELECT 1 AS id, 2.5D AS x"), str(tmp_path / "a"))
    out.write_parquet(spark.sql("SELECT 'z' AS x, 2L AS `Id`, null AS rien").withColumn("rien", F.col("rien").cast("int")), str(tmp_path / "b"))
    put(tmp_path, "mauvais.parquet", b"nothing")
    table, errors = mixed.read_mixed_reported(spark, str(tmp_path))
    assert rows_of(table.select("ID", "X", "RIEN")) == [("1", "2.5", None), ("2", "z", None)]
    assert [e.path.rsplit("/", 1)[1] for e in errors.collect()] == ["mauvais.parquet"]
    saved = jobs.bronze_files(spark, str(tmp_path), "bronze.essai_types", errors="bronze.essai_erreurs")
    assert saved.count() == 2 and spark.table("bronze.essai_erreurs").count() == 1


def book(agents, codes):
    return workbook_bytes([("Agents", agents), ("Codes", [["titre"], *codes])])


def test_sheet_keys_are_found_file_by_file(spark, tmp_path):
    put(tmp_path, "2015_01.xlsx", book([["Matricule", "Nom"], ["a1", "x"], ["a2", "y"]], [["MATRICULE||CODE", "101", "Prime"], ["a1", 7, 1]]))
    put(tmp_path, "2015_02.xlsx", book([["Matricule", "Clé unique"], ["a1", "a1||9"]], [["PRIME", "matricule||code"], [2, "a1||9"]]))
    put(tmp_path, "2015_03.xlsx", book([["Matricule"], ["a1"]], [["autre", "101"], ["a1", 3]]))
    put(tmp_path, "2015_04.xlsx", book([["Nom", "Service"], ["z", "Matricule"]], [["MATRICULE||CODE", "101"], ["z", 3]]))
    rows = workbook.two_sheet_table(files.read_binary(spark, str(tmp_path), "*.xlsx"))
    assert len({name.lower() for name in rows.columns}) == len(rows.columns)
    got = {(r.PERIODE, r.MATRICULE): (r["101_F2"], r["PRIME_F2"]) for r in rows.collect() if r.PERIODE != "2015_04"}
    assert got == {
        ("2015_01", "a1"): ("7", "1"),
        ("2015_01", "a2"): (None, None),
        ("2015_02", "a1"): (None, "2"),
        ("2015_03", "a1"): (None, None),
    }


def test_workbooks_as_they_arrive(spark, tmp_path, monkeypatch):
    """Three runs equal one, a batch that fails and is run again adds nothing, a bad file is listed."""
    months = {
        "2015_01.xlsx": book([["Matricule", "Nom"], ["a1", "x"], ["a2", None]], [["MATRICULE||C", "101"], ["a1", 7]]),
        "2015_02.xlsx": book([["Matricule", "Grade"], ["a1", "G"]], [["MATRICULE||C", "102"], ["a1", 8]]),
        "2015_03.xlsx": b"PK not a workbook",
        "2015_04.xlsx": book([["Grade", "Clé unique"], ["H", "k"]], [["matricule||c", "101"], ["k", 9]]),
    }
    places = [str(tmp_path / name) for name in ("in", "out", "errors", "state")]
    read = workbook_reader(pairs=True)
    (tmp_path / "in").mkdir()
    table, errors = ingest_drifting(spark, *places, read)
    assert table.count() == 0 and errors.count() == 0
    for name, content in months.items():
        put(tmp_path / "in", name, content)
        if name == "2015_02.xlsx":
            # The data are written, the run dies before the batch is done.
            write, calls = incremental._spelled_as, []

            def fail(table, target):
                spelled = write(table, target)
                spelled.write.mode("overwrite").parquet(f"{target}/{incremental.BATCH}=1")
                calls.append(1)
                raise RuntimeError("ExecutorLostFailure")

            monkeypatch.setattr(incremental, "_spelled_as", fail)
            with pytest.raises(Exception, match="ExecutorLost"):
                ingest_drifting(spark, *places, read)
            monkeypatch.setattr(incremental, "_spelled_as", write)
            assert calls
        table, errors = ingest_drifting(spark, *places, read)
    columns = ["MATRICULE", "NOM", "GRADE", "CLE_UNIQUE", "101_F2", "102_F2", "PERIODE"]
    assert [e.fichier for e in errors.collect()] == ["2015_03.xlsx"]
    once = workbook.two_sheet_table(files.read_binary(spark, str(tmp_path / "in"), "*.xlsx"))
    assert rows_of(table.select(*columns)) == rows_of(once.select(*columns))
    assert table.count() == 4
    again, _ = ingest_drifting(spark, *places, read)
    assert again.count() == 4
    whole = jobs.bronze_payroll(spark, str(tmp_path / "in"), "bronze.essai_solde", errors="bronze.essai_solde_erreurs")
    assert rows_of(whole.select(*columns)) == rows_of(table.select(*columns))
    assert spark.table("bronze.essai_solde_erreurs").count() == 1


def test_text_files_as_they_arrive(spark, tmp_path, monkeypatch):
    """Columns change between and within arrivals; a file that fails while its data are read is set aside."""
    places = [str(tmp_path / name) for name in ("in", "out", "errors", "state")]
    read = csv_reader(",", "utf-8", "light")
    put(tmp_path, "in/a.csv", b"Nom,x\na,1\n")
    put(tmp_path, "in/b.csv", b"x,autre\n2,\"z\nz\"\n")
    ingest_drifting(spark, *places, read, glob="*.csv")
    put(tmp_path, "in/c.csv", b"nom\nc\n")
    put(tmp_path, "in/vide.csv", b" \n")
    put(tmp_path, "in/large.csv", b"nom\n" + b"," * 30_000 + b"\n")
    put(tmp_path, "in/d.csv", b"NOM,x\nd,4\n")
    table, errors = ingest_drifting(spark, *places, read, glob="*.csv")
    assert rows_of(table.select("Nom", "x", "autre")) == [("a", "1", None), ("c", None, None), ("d", "4", None), (None, "2", "z\nz")]
    assert sorted(e.fichier for e in errors.collect()) == ["large.csv", "vide.csv"]

    places = [str(tmp_path / name) for name in ("pin", "pout", "perrors", "pstate")]
    for number, sql in enumerate(("SELECT 1 AS id, 'x' AS v", "SELECT 'b' AS id, 3 AS w")):
        out.write_parquet(spark.sql(sql), str(tmp_path / f"pin/{number}"))
        table, errors = ingest_drifting(spark, *places, parquet_reader(), glob="*.parquet")
    assert rows_of(table.select("ID", "V", "W")) == [("1", "x", None), ("b", None, "3")]


def test_a_batch_takes_few_jobs(spark, tmp_path):
    """Headers of a batch are found for both sheets at once and broadcast uncounted; a batch is listed by cores, probed once."""
    for number in range(40):
        put(tmp_path / "in", f"m{number:02d}.xlsx", book([["Matricule", "Nom"], [f"a{number}", "x"]], [["MATRICULE||C", "101"], [f"a{number}", 7]]))
        put(tmp_path / "csv", f"m{number:02d}.csv", b"id,nom\n1,x\n" if number % 2 else b"\n,\nid,nom\n1,y\n")
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, seen = spark.conf.get(setting), []

    def counted(read, group):
        def counting(found):
            seen.append(int(found.sparkSession.conf.get(setting)))
            context.setJobGroup(group, group)
            table, bad = read(found)
            table.write.format("noop").mode("overwrite").save()
            seen.append(len(tracker.getJobIdsForGroup(group)))
            return table, bad

        return counting

    for group, read, glob, jobs_at_most in (("in", workbook_reader(pairs=True), "*.xlsx", 14), ("csv", csv_reader(), "*.csv", 20)):
        places = [str(tmp_path / name) for name in (group, f"{group}_out", f"{group}_errors", f"{group}_state")]
        table, errors = ingest_drifting(spark, *places, counted(read, group), glob=glob, files_per_batch=40)
        assert table.count() == 40 and errors.count() == 0
        tasks, jobs_run = seen[-2:]
        assert tasks <= context.defaultParallelism and 0 < jobs_run <= jobs_at_most, seen
    assert spark.conf.get(setting) == before


def test_sheet_elements_are_taken_from_the_tree_piece_by_piece():
    """Every row that is read to its end is given once, also before an error, and leaves the tree."""
    from io import BytesIO
    from xml.etree import ElementTree

    body = "".join(f'<row r="{r}"><c r="B{r}"><v>{r}</v></c></row>' for r in range(1, 2_001))
    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols><col/></cols><sheetData>'
    rows = list(workbook._sheet_rows(BytesIO(f"{head}{body}</sheetData><mergeCells/></worksheet>".encode()), str))
    assert rows == [(r, [None, f"{r}"]) for r in range(1, 2_001)]
    seen = []
    with pytest.raises(ElementTree.ParseError):
        for row in workbook._elements(BytesIO(f"{head}{body}</bad>".encode()), lambda tag: tag.endswith("}row")):
            seen.append(row.get("r"))
    assert seen == [f"{r}" for r in range(1, 2_001)]
    tree = ElementTree.fromstring(f"{head}{body}</sheetData></worksheet>")
    left = workbook._finished(tree, lambda tag: tag.endswith("}row"), False)
    assert len(list(left)) == 1_999 and len(tree) == 1 and len(tree[0]) == 1
