"""What the tasks of wide aggregations hold: read off the plans, with the results beside them."""

from stratiform.operators import cleaning, gold
from tests.conftest import plan_of, rows_of


def test_distinct_rows_are_dealt_before_they_are_held(spark):
    rows = [("a", 1, None), ("a", 1, None), (None, None, None), (None, None, None), ("a", 1, 0.0), ("a", 1, -0.0)]
    out = cleaning.drop_duplicate_rows(spark.createDataFrame(rows, "c string, `d.e` int, f double"))
    assert out.columns == ["c", "d.e", "f"]
    assert rows_of(out) == sorted([("a", 1, None), ("a", 1, 0.0), (None, None, None)], key=lambda r: tuple((v is None, str(v)) for v in r))
    plan = plan_of(out).split("Initial Plan")[0]
    # The plan reads from the result down: every hash table stands above the one exchange.
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")
    assert cleaning.drop_duplicate_rows(spark.createDataFrame([], "c string")).count() == 0


def test_summary_sorts_no_rows(spark):
    rows = [("1", "1999_02"), ("1", "1999_01"), (None, "2000_01"), ("2", None), ("2", "1999_02")]
    out = gold.panel_summary(spark.createDataFrame(rows, "matricule string, periode string"))
    assert rows_of(out) == [("1999_01", "2000_01", 3, 2)]
    assert not any(step in plan_of(out) for step in ("Sort [", "Expand"))
    other = gold.panel_summary(spark.createDataFrame([(1, 2), (1, None), (3, 2)], "a long, b int"), "a", "b")
    assert rows_of(other) == [(2, 2, 1, 2)]
