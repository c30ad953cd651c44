"""Cubes, rolling months, running totals and history against plain Python, with nulls, ties, hot keys and empty tables."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratiform.operators import rollup
from stratiform.operators.explore import tabulate
from stratiform.plans import jobs
from tests.conftest import rows_of

SCHEMA = "periode string, organisme string, matricule string, montant double"


@pytest.fixture(scope="module")
def pay(spark):
    """A hot organisation, a hot agent, agents without a number, gaps of months, repeated lines."""
    draw = random.Random(2)
    rows = []
    for _ in range(900):
        year, month = draw.choice([2019, 2020, 2021]), draw.choice([1, 2, 3, 7, 11])
        organisme = draw.choice(["hot", "hot", "b", "c", None])
        matricule = draw.choice(["a0", None, *[f"a{draw.randrange(120)}" for _ in range(6)]])
        rows.append((f"{year}_{month:02d}", organisme, matricule, draw.choice([None, 10.25, 0.5])))
    rows += [("2019_01", "rare", "a1", 1.0), ("2023_12", "rare", "a1", 1.0), ("2023_12", "rare", "a1", 1.0), ("bad", "b", "a1", 2.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_cube(spark, pay):
    dims = ["periode", "organisme"]
    rows = [tuple(r) for r in pay.collect()]
    expected = []
    for hidden in itertools.product((0, 1), repeat=2):
        cells = collections.defaultdict(list)
        for row in rows:
            cells[tuple(None if gone else value for value, gone in zip(row, hidden))].append(row)
        for cell, held in cells.items():
            paid = [r[3] for r in held if r[3] is not None]
            agents = {r[2] for r in held} - {None}
            expected.append((*cell, hidden[0] * 2 + hidden[1], len(held), len(agents), sum(paid) if paid else None))
    out = rollup.cube_agents(pay, dims, "matricule", ["montant"])
    assert out.columns == [*dims, "niveau", "nb_lignes", "nb_agents", "total_montant"]
    assert rows_of(out) == sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rollup.cube_agents(pay.limit(0), dims, "matricule").count() == 0


def test_cube_of_many_agents(spark):
    """More agents than a bitmap holds, a third of them in one cell, and columns named like the helper columns."""
    rows = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 50)).alias("cell"),
        (F.col("id") % 80_000).alias("agent"),
        (F.col("id") % 2).alias("bucket"),
    )
    out = rollup.cube_agents(rows.unionAll(rows), ["cell", "bucket"], "agent")
    plain = rows.cube("cell", "bucket").agg(F.count("*") * 2, F.count_distinct("agent"))
    assert rows_of(out.select("cell", "bucket", "nb_lignes", "nb_agents")) == rows_of(plain)


@pytest.mark.parametrize("months", [1, 12])
def test_rolling_months(pay, months):
    present = collections.defaultdict(set)
    for periode, organisme, matricule, _ in pay.collect():
        if matricule is not None and periode != "bad":
            present[organisme].add((int(periode[:4]) * 12 + int(periode[5:]) - 1, matricule))
    expected = []
    for organisme, seen in present.items():
        for month in range(min(seen)[0], max(seen)[0] + 1):
            own = {a for m, a in seen if m == month}
            held = {a for m, a in seen if month - months < m <= month}
            expected.append((organisme, f"{month // 12:04d}_{month % 12 + 1:02d}", len(own), len(held)))
    out = rollup.rolling_agents(pay, ["organisme"], "matricule", months=months)
    assert rows_of(out) == sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert ("rare", "2021_06", 0, 0) in expected
    assert rollup.rolling_agents(pay.limit(0), ["organisme"], "matricule").count() == 0


def test_running_totals(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, *range(40)]), draw.randrange(9), i) for i in range(500)] + [(5, None, 500)]
    df = spark.createDataFrame(rows, "place int, value int, part int").repartition(7)
    out = rollup.running_total(df, "place", "value", "upto")
    key = lambda place: -1 if place is None else place
    for place, _, _, upto in out.collect():
        assert upto == sum(v or 0 for p, v, _ in rows if key(p) <= key(place))
    assert out.count() == len(rows) and out.columns == ["place", "value", "part", "upto"]
    assert rollup.running_total(df.limit(0), "place", "value", "upto").count() == 0


def test_tabulate_orders_values_over_many_tasks(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("v"))
    rows = sorted(tuple(r) for r in tabulate(df, "v").collect())
    freq = collections.Counter(i % 700 for i in range(5000))
    upto = itertools.accumulate(freq[v] for v in range(700))
    assert [(r[0], r[1], r[3]) for r in rows] == [(v, freq[v], pytest.approx(100 * n / 5000, abs=0.0051)) for v, n in enumerate(upto)]


def test_history_gives_back_each_load(spark):
    draw = random.Random(9)
    rows = []
    for load in ("2020_01", "2020_02", "2020_05", "2021_01"):
        rows += [(load, draw.choice(["k1", "k2", "k3", None]), draw.choice(["x", None])) for _ in range(9)]
        rows += [(load, "hot", str(i)) for i in range(60)] + [(load, "always", "x")] * 2
    rows += [("2020_02", "always", "x"), (None, "k1", "x")]
    df = spark.createDataFrame(rows, "load string, number string, label string").repartition(5)
    history = rollup.snapshot_history(df, "load", ["number", "label"])
    for load in ("2020_01", "2020_02", "2020_05", "2021_01"):
        assert rows_of(rollup.at_load(history, load)) == rows_of(df.where(F.col("load") == load).select("number", "label"))
    always = rows_of(history.where("number = 'always'"))
    assert always == [("always", "x", 2, "2020_01", "2020_02"), ("always", "x", 2, "2020_05", None), ("always", "x", 3, "2020_02", "2020_05")]
    assert history.where("number = 'hot'").count() == 60
    assert rollup.snapshot_history(df.limit(0), "load", ["number", "label"]).count() == 0


def test_payroll_controls(spark):
    rows = [("2015_01", "m1", "a", 10.0, 9.0), ("2015_01", "m1", "a", 10.0, 12.0), ("2016_01", "m2", None, 10.0, 9.0), ("2016_02", None, None, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "periode string, matricule string, grade string, montant_brut double, montant_net double")
    reports = jobs.validate_payroll(table, ["matricule", "absent"], ["grade", "matricule"])
    assert set(reports) == {
        "completude_colonnes_cles", "na_par_annee_colonnes_surveillees", "doublons_matricule_periode", "resume", "coherence_montants"
    }
    assert rows_of(reports["completude_colonnes_cles"]) == [("matricule", 75.0, "ALERTE")]
    watched = reports["na_par_annee_colonnes_surveillees"]
    assert rows_of(watched.select("annee", "colonne", "pct_na")) == [("2015", "grade", 0.0), ("2016", "grade", 100.0)]
    assert rows_of(reports["doublons_matricule_periode"]) == [("m1", "2015_01", 2)]
    assert rows_of(reports["coherence_montants"]) == [(1, 25.0)]
    assert rows_of(reports["resume"]) == [("2015_01", "2016_02", 3, 2)]
