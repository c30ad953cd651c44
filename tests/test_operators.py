import random
import statistics

import pytest
from pyspark.sql import functions as F

from stratiform.operators import cleaning, drift, enrich, explore, gold, headers, quality
from stratiform.operators.quantiles import exact_quantiles
from tests.conftest import plan_of, rows_of


def test_union_and_headers(spark):
    a, b = spark.sql("SELECT 1 AS x, 'a' AS y"), spark.sql("SELECT 'b' AS y, 2.0D AS z")
    assert rows_of(headers.union_all([a, b])) == [(1, "a", None), (None, "b", 2.0)]
    wide = spark.range(1).select(*[F.lit(i).alias(f"Col {i % 50}") for i in range(300)])
    clean = headers.normalize_headers(wide)
    assert len(set(clean.columns)) == 300
    assert headers.suffix_columns(a, "_F2", keep=["x"]).columns == ["x", "y_F2"]
    mapped, pairs = headers.map_columns(spark.sql("SELECT 1 AS `Salaire Brut`, 2 AS `PERIODE`"))
    assert mapped.columns == ["montant_brut", "periode"]
    assert rows_of(headers.correspondence_report(spark, pairs)) == [
        ("PERIODE", "periode"),
        ("Salaire Brut", "montant_brut"),
    ]


def test_first_per_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(0, 20_000, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    first = cleaning.first_per_key(df, ["k"], [F.desc("v")])
    assert rows_of(first) == [(0, 19_998), (1, 19_999), (2, 19_997)]
    plan = plan_of(first)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dropping_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, None)], "x int, y string, z string")
    assert cleaning.drop_null_rows(df).count() == 0
    assert cleaning.drop_null_rows(df, subset=["x", "y"]).count() == 2
    assert rows_of(cleaning.empty_columns(df)) == [("z",)]
    assert cleaning.drop_duplicate_rows(df).count() == 2
    assert rows_of(cleaning.retention(df, "x = 1")) == [(3, 2, 66.7)]
    assert rows_of(cleaning.retention(df.limit(0), "x = 1")) == [(0, 0, None)]


def test_dictionary_needs_a_label_column(spark):
    sheet = spark.createDataFrame([("1", "École", 1), ("2", " ecole.", 2), ("3", "--", 3)], "c string, l string, row_no int")
    assert rows_of(enrich.load_dictionary(sheet, ["x", "l"])) == [("ECOLE", "1")]
    with pytest.raises(ValueError):
        enrich.load_dictionary(sheet, ["x", "z"])


@pytest.mark.parametrize("max_rows", [100, 0])
def test_enrichment_is_the_same_with_and_without_broadcast(spark, max_rows):
    df = spark.createDataFrame(
        [("Santé", 1), ("sante", 2), ("Inconnu", 3), (None, 4)], "organisme string, code_organisme int"
    )
    dictionary = spark.createDataFrame([("SANTE", "S1"), ("EDUCATION", "E1")], "libelle_norm string, code string")
    lookups = [
        enrich.CodeLookup("CODE_ORGANISME", "organisme", dictionary),
        enrich.CodeLookup("CODE_POSTE", "poste", dictionary),
    ]
    out = enrich.enrich_codes(df, lookups, max_rows)
    assert out.columns == ["organisme", "code_organisme_src", "CODE_ORGANISME", "CODE_POSTE"]
    assert rows_of(out) == [
        ("Inconnu", 3, None, None),
        ("Santé", 1, "S1", None),
        ("sante", 2, "S1", None),
        (None, 4, None, None),
    ]
    assert rows_of(enrich.match_rates(out, ["CODE_ORGANISME", "CODE_POSTE"])) == [
        ("CODE_ORGANISME", 4, 2, 50.0),
        ("CODE_POSTE", 4, 0, 0.0),
    ]


def test_sheets_never_match_across_files(spark):
    first = spark.createDataFrame([("f1", "k"), ("f2", "k")], "fichier string, cle string")
    second = spark.createDataFrame([("f1", "k", 5)], "fichier string, c string, montant int")
    out = enrich.join_sheets(first, second, "fichier", F.col("cle"), F.col("c"))
    assert out.columns == ["fichier", "cle", "c_F2", "montant_F2"]
    assert rows_of(out) == [("f1", "k", "k", 5), ("f2", "k", None, None)]


def test_drift(spark):
    layout = {"2015_01": "ABC", "2015_02": "ABD", "2015_04": "ABD", "2015_05": "A"}
    rows = [(p, c) for p, columns in layout.items() for c in columns]
    relation = spark.createDataFrame(rows, "periode string, colonne string")
    assert rows_of(drift.schema_drift(relation)) == [
        ("2015_01", "2015_02", "APPARUE", "D"),
        ("2015_01", "2015_02", "DISPARUE", "C"),
        ("2015_04", "2015_05", "DISPARUE", "B"),
        ("2015_04", "2015_05", "DISPARUE", "D"),
    ]
    assert rows_of(drift.column_count_stats(relation)) == [(1, 3, 2.5)]


@pytest.mark.parametrize("small_group", [1_000_000, 0])
def test_exact_quantiles_against_brute_force(spark, small_group):
    rng = random.Random(7)
    groups = {"gros": 30_000, "moyen": 501, "petit": 2, "seul": 1}
    rows = [(g, round(rng.lognormvariate(3, 2), 2)) for g, n in groups.items() for _ in range(n)]
    rows += [("gros", 5.0)] * 9_000 + [("gros", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    # The sketch must hold its promise for groups far above its accuracy.
    got = exact_quantiles(df, ["g"], "v", {"q1": 0.25, "med": 0.5, "p99": 0.99}, 2_000, small_group or 20_000)
    for row in got.collect():
        values = sorted(v for g, v in rows if g == row.g and v is not None)
        for name, q in (("q1", 0.25), ("med", 0.5), ("p99", 0.99)):
            at = (len(values) - 1) * q
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert row[name] == pytest.approx(low + (high - low) * (at - int(at))), (row.g, name)
    assert got.count() == 5
    whole = exact_quantiles(df, [], "v", {"med": 0.5}).first().med
    assert whole == pytest.approx(statistics.median(v for _, v in rows if v is not None))


def _hot(spark, n=40_000):
    """A third of the rows, and more, belong to one agent, organisation and period."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 8).select(
        F.when(hot, "A0").otherwise(F.concat(F.lit("A"), (F.col("id") % 977).cast("string"))).alias("matricule"),
        F.when(hot, "2015_01").otherwise(F.concat(F.lit("2015_0"), (1 + F.col("id") % 9).cast("string"))).alias("periode"),
        F.lit(None).cast("string").alias("code_organisme"),
        F.when(hot, "SANTE").otherwise((F.col("id") % 7).cast("string")).alias("organisme"),
        F.lit("en_activite").alias("situation_normalisee"),
        F.lit("1").alias("sexe"),
        (F.col("id") % 10_007).cast("double").alias("montant_brut"),
        (F.col("id") % 10_009).cast("double").alias("montant_net"),
    )


def test_payroll_mass_with_a_hot_group(spark):
    silver = _hot(spark)
    rows = silver.collect()
    got = {(r.periode, r.organisme): r for r in gold.payroll_mass(silver).collect()}
    groups = {}
    for row in rows:
        groups.setdefault((row.periode, row.organisme), []).append(row)
    assert set(got) == set(groups)
    for key, members in groups.items():
        row = got[key]
        assert row.nb_lignes == len(members) and row.code_organisme == "NON_CODE"
        assert row.nb_agents_uniques == len({m.matricule for m in members})
        assert row.masse_brute == sum(m.montant_brut for m in members)
        assert row.annee == "2015" and row.mois == key[0][-2:]
        gross = sorted(m.montant_brut for m in members)
        rank = abs(gross.index(row.salaire_brut_mediane) - len(gross) / 2) if row.salaire_brut_mediane in gross else 9
        assert rank <= 2 + len(gross) / 1_000


def test_gold_on_empty_input(spark):
    empty = _hot(spark).limit(0)
    assert gold.payroll_mass(empty).count() == 0
    assert gold.headcount_by_sex(empty).count() == 0
    assert rows_of(gold.panel_summary(empty)) == [(None, None, 0, 0)]


def test_step_counts_quote_the_slash(spark):
    df = spark.createDataFrame([("A/1", "G"), ("A/1", "G")], "`CLASSE/ECHELON` string, GRADE string")
    assert rows_of(gold.headcount(df, ["CLASSE/ECHELON", "GRADE"])) == [("A/1", "G", 2)]


def test_evolution(spark):
    df = spark.createDataFrame([("2015_01", 10.0), ("2015_02", 15.0), ("2015_03", 0.0), ("2015_04", 1.0)], "periode string, m double")
    assert rows_of(gold.monthly_evolution(df, "m")) == [
        ("2015_01", 10.0, None, None),
        ("2015_02", 15.0, 5.0, 50.0),
        ("2015_03", 0.0, -15.0, -100.0),
        ("2015_04", 1.0, 1.0, None),
    ]


def test_quality_rates_add_up_and_skip_absent_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, nom string")
    missing = {r.colonne: r for r in quality.null_rate(df, ["id", "nom", "zz"]).collect()}
    present = {r.colonne: r for r in quality.completeness(df, ["id", "nom", "zz"]).collect()}
    assert set(missing) == set(present) == {"id", "nom"}
    assert missing["nom"].pct_na == 66.7 and missing["nom"].statut == "ALERTE" and missing["id"].statut == "ok"
    assert all(abs(missing[c].pct_na + present[c].pct_complet - 100) < 0.11 for c in missing)
    empty = quality.null_rate(df.limit(0), ["id"]).first()
    assert empty.pct_na is None and empty.statut == "ok"


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(None if i == 0 else i,) for i in range(20)], "id int")
    assert quality.null_rate(df, ["id"]).first().statut == "ok"
    assert quality.null_rate(df, ["id"], threshold=4.9).first().statut == "ALERTE"


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 1), ("b", 1)], "m string, p int")
    assert rows_of(quality.duplicate_keys(df, ["m", "p"], ["m"])) == [("a", 1, 2)]
    assert quality.duplicate_keys_top(df, ["m", "p", "absente"]).count() == 2
    assert "TakeOrderedAndProject" in plan_of(quality.duplicate_keys_top(df, ["m", "p"]))


def test_each_control_reads_the_table_once(spark, tmp_path):
    path = str(tmp_path / "t")
    _hot(spark, 1000).write.parquet(path)
    table = spark.read.parquet(path)
    amounts = ["montant_brut", "montant_net"]
    for report in (
        quality.null_rate(table, table.columns),
        quality.numeric_profile(table, amounts),
        quality.null_rate_by_year(table, amounts),
        quality.table_profile(table),
        cleaning.retention(table, "montant_net > 3"),
        quality.net_above_gross(table),
    ):
        assert plan_of(report).count("FileScan parquet") == 1
    scan = plan_of(quality.net_above_gross(table))
    assert "ReadSchema: struct<montant_brut:double,montant_net:double>" in scan


def test_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 101), 1000, -900]], "v double")
    found = quality.outliers(df, "v").first()
    assert (found.nb_bas, found.nb_haut) == (1, 1)
    by_key = quality.outliers(df.withColumn("k", F.lit("a")), "v", ["k"]).first()
    assert (by_key.nb_bas, by_key.nb_haut) == (1, 1)


def test_models_recover_known_coefficients(spark):
    df = spark.range(400).select(
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")
    ).withColumn("y", 2 + 3 * F.col("a") - F.col("b"))
    fitted = {r.variable: r.coef for r in explore.regress_many(df, "y", ["a", "b"]).collect()}
    assert fitted == pytest.approx({"_cons": 2, "a": 3, "b": -1}, abs=1e-6)
    single = explore.regress(df.withColumn("y", 1 + 2 * F.col("a")), "y", "a").first()
    assert (single.slope, single.intercept, single.r2) == pytest.approx((2, 1, 1))
    yes = df.withColumn("y", (F.col("a") + (F.hash("b", "a") % 5) > 8).cast("int"))
    assert explore.logit(yes, "y", ["a"]).filter("variable = 'a'").first().coef > 0


def test_histogram_and_tabulate(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 1, 9, 10, 11)] + [(None,)], "v double")
    assert rows_of(explore.histogram(df, "v", 0, 10, 2)) == [(0, 1), (1, 2), (2, 1), (3, 2)]
    kinds = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    assert rows_of(explore.tabulate(kinds, "k")) == [("a", 2, 50.0, 50.0), ("b", 1, 25.0, 75.0), ("c", 1, 25.0, 100.0)]
