import datetime

import pytest
from pyspark.sql import functions as F

from stratiform.functions import casts, text
from tests.conftest import rows_of


def values(spark, raw, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    return [row.r for row in frame.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def test_labels(spark):
    cases = {
        "Ministère de l'Économie": "MINISTERE DE L ECONOMIE",
        "Ministère de l’Économie": "MINISTERE DE L ECONOMIE",
        "A   B     c": "A B C",
        "  d.g.-x (a)/[b] ; c : d,e ": "D G X A B C D E",
        "Œuvre Straße": "OEUVRE STRASSE",
        "a\u00a0\u202fb": "A B",
        "e\u0301te\u0301": "ETE",
        " .-' ": None,
        "": None,
        None: None,
    }
    assert values(spark, cases, text.normalize_label) == list(cases.values())


def test_label_rule_is_stable(spark):
    raw = ["Écoles (Nord)", "a  b", "çà et-là", "N° 5"]
    once = values(spark, raw, text.normalize_label)
    assert values(spark, once, text.normalize_label) == once


def test_categories(spark):
    cases = {
        " En  activité ": "en_activite",
        "ACTIVITE": "en_activite",
        "régul. indemnités": "regul_indemnites",
        "Demi-solde": "demi_solde",
        "1/2 solde": "demi_solde",
        "retraite": "autre",
        "": "autre",
        None: "autre",
    }
    assert values(spark, cases, text.normalize_category) == list(cases.values())
    fruits = {"rouge": ["POMME"], "jaune": ["POMME", "CITRON"]}
    got = values(spark, ["pomme", "citron", "kiwi"], lambda c: text.normalize_category(c, fruits, "?"))
    assert got == ["rouge", "jaune", "?"]


def test_blank_and_paths(spark):
    assert values(spark, [" ", "", None, "nan", " a "], text.blank_to_null) == [None, None, None, "nan", "a"]
    assert values(spark, ["nan", "x"], lambda c: text.blank_to_null(c, "nan")) == [None, "x"]
    paths = ["s3a://b/p/2015_01.xlsx", "file:/a/b.tar.gz", "nom"]
    assert values(spark, paths, text.file_name) == ["2015_01.xlsx", "b.tar.gz", "nom"]
    assert values(spark, paths, text.file_stem) == ["2015_01", "b.tar", "nom"]
    assert values(spark, paths, text.file_extension) == ["xlsx", "gz", ""]


def test_decimals(spark):
    raw = ["12500,00", "12 500,50", "1\u00a0000\u202f000", "-3,5", "abc", "", None, "7.25"]
    assert values(spark, raw, casts.parse_decimal) == [12500.0, 12500.5, 1000000.0, -3.5, None, None, None, 7.25]


def test_excel_dates(spark):
    assert values(spark, ["42005", "43831.5", "x"], casts.excel_date) == [
        datetime.date(2015, 1, 1),
        datetime.date(2020, 1, 1),
        None,
    ]


def test_casts_and_their_failures(spark):
    raw = spark.createDataFrame(
        [("1.5", "3", "2020_02"), ("x", "3.5", "2020_13"), (None, "", None)], "d string, i string, p string"
    )
    settings = dict(doubles=["d", "absent"], ints=["i"], dates={"p": "yyyy_MM"})
    typed = casts.cast_columns(raw, **settings)
    assert rows_of(typed)[0] == (1.5, 3, datetime.date(2020, 2, 1))
    assert typed.filter("d IS NULL").count() == 2
    assert rows_of(casts.cast_failures(raw, **settings)) == [("d", 2, 1), ("i", 3, 2), ("p", 2, 1)]


def test_code_columns_strings_and_recode(spark):
    df = spark.createDataFrame([("1", "2", None)], "`101_F2` string, nom string, vide string")
    assert casts.cast_code_columns(df).dtypes == [("101_F2", "double"), ("nom", "string"), ("vide", "string")]
    assert rows_of(casts.to_strings(spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b"))) == [("1", None)]
    assert values(spark, ["1", "2", "3", None], lambda c: casts.recode(c, {"1": 0, "2": 1})) == [0, 1, None, None]
    assert values(spark, ["1", "3"], lambda c: casts.recode(c, {"1": "un"}, c)) == ["un", "3"]
    assert values(spark, ["-1", "2", None], lambda c: casts.clip_negative(c.cast("double"))) == [0.0, 2.0, None]


@pytest.mark.parametrize("part, whole, expected", [(1, 3, 33.3), (0, 0, None), (0, 5, 0.0)])
def test_percent(spark, part, whole, expected):
    assert spark.range(1).select(casts.percent(F.lit(part), F.lit(whole), 1)).first()[0] == expected
