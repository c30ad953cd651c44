from pyspark.sql import functions as F

from stratiform.operators.enrich import CodeLookup
from stratiform.operators.gold import GoldSpec, category_totals
from stratiform.operators.versions import VersionedDataset
from stratiform.plans import jobs
from stratiform.plans.staging import workbook_bytes
from tests.conftest import rows_of

HEADER = ["Matricule", "Nom", "Situation", "Salaire Brut", "Montant net", "Ministère", "Sexe"]


def test_payroll_from_workbooks_to_gold(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for month, net in (("2015_01", 80), ("2015_02", 90)):
        agents = [
            ["a1", "x", "En activité", 100, net, "Ministère de la Santé", "1"],
            ["a2", "y", "demi-solde", "50,5", 40, "Inconnu", "2"],
            ["a3", "z", "Retraite", 10, 10, "Inconnu", "2"],
        ]
        codes = [["MATRICULE||CODE_ORGANISME", "101"], ["a1", 7]]
        (source / f"{month}.xlsx").write_bytes(workbook_bytes([("F1", [["titre"], HEADER, *agents]), ("F2", [[], *codes])]))
    (source / "2015_03.xlsx").write_bytes(b"damaged")
    before = jobs.pre_analysis(spark, str(source))
    assert rows_of(before["stats_par_periode"]) == [("2015_01", 7, 2), ("2015_02", 7, 2)]
    assert rows_of(before["codes_f2_uniques"]) == [("101",)]
    assert before["changements_f1"].count() == 0 and before["erreurs"].count() == 1
    assert before["inventaire_fichiers"].filter("sheet_no = 1").first().colonnes == "|".join(HEADER)
    bronze = jobs.bronze_payroll(spark, str(source), "bronze.panel_solde")
    assert bronze.count() == 6 and set(kind for _, kind in bronze.dtypes) == {"string"}
    dictionary = spark.createDataFrame([("MINISTERE DE LA SANTE", "S1")], "libelle_norm string, code string")
    silver = jobs.silver_payroll(bronze, [CodeLookup("code_organisme", "organisme", dictionary)], decimal_comma=True)
    assert silver.count() == 4
    assert dict(silver.dtypes)["101_f2"] == "double" and dict(silver.dtypes)["montant_brut"] == "double"
    reports = jobs.validate(silver, ["matricule", "code_organisme"], ["matricule", "periode"], ["montant_brut"], "situation_normalisee")
    saved = jobs.save_reports(reports, str(tmp_path / "reports"))
    assert saved == ["completude_colonnes_cles", "stats_colonnes_numeriques", "distribution"]
    counts = jobs.gold(silver, jobs.PAYROLL_GOLD, str(tmp_path / "exports"))
    assert rows_of(counts) == [("gold.effectifs", 4, 9), ("gold.masse_salariale", 4, 14)]
    mass = spark.table("gold.masse_salariale").filter("code_organisme = 'S1'")
    assert rows_of(mass.select("periode", "masse_brute", "masse_nette")) == [("2015_01", 100.0, 80.0), ("2015_02", 100.0, 90.0)]


def test_generic_files_to_gold(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Identifiant,Valeur,Jour,Catégorie\n1,10.5,2020-01-31,A\n1,9,2020-01-30,A\n2,x,,B\n")
    bronze = jobs.bronze_files(spark, str(tmp_path / "in"), "bronze.generique_valeurs")
    spec = jobs.SilverSpec(
        rename={"IDENTIFIANT": "id", "VALEUR": "valeur", "JOUR": "jour", "CATEGORIE": "categorie", "ABSENT": "z"},
        doubles=["valeur"],
        ints=["id"],
        dates={"jour": "yyyy-MM-dd"},
        where="id IS NOT NULL",
        key=["id"],
        key_order=["jour"],
    )
    silver = jobs.silver(bronze, spec)
    assert rows_of(silver.select("id", "valeur", F.col("jour").cast("string"))) == [(1, 9.0, "2020-01-30"), (2, None, None)]
    product = GoldSpec("gold.generique_totaux", lambda df: category_totals(df, "categorie", "valeur"), "totaux")
    assert rows_of(jobs.gold(silver, [product])) == [("gold.generique_totaux", 2, 4)]


def test_extract_of_a_new_data_set(spark, tmp_path):
    bronze = spark.createDataFrame([("O1", "E")] * 2 + [("O2", None)], "ORGANISME string, EMPLOI string")
    dataset = VersionedDataset(spark, str(tmp_path / "nouveau"))
    assert jobs.publish_extract(dataset, bronze)
    assert rows_of(dataset.read()) == [("O1", "E")]


def test_extract_published_through_a_branch(spark, tmp_path):
    bronze = spark.createDataFrame(
        [("O1", "E", "G", "S", "1/2")] * 2 + [("O2", None, "G", "S", "1/2")],
        "ORGANISME string, EMPLOI string, GRADE string, SERVICE string, `CLASSE/ECHELON` string",
    )
    dataset = VersionedDataset(spark, str(tmp_path / "extrait"))
    dataset.commit(bronze)
    assert jobs.publish_extract(dataset, bronze)
    assert dataset.read().count() == 1
    counts = jobs.gold(dataset.read(), jobs.EXTRACT_GOLD)
    assert {r.nb_lignes for r in counts.collect()} == {1}
