"""Exploratory statistics as aggregates; the model fits run on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.functions.casts import percent
from stratiform.operators.rollup import running_total


def summarize(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """n, mean, standard deviation, min and max of each column, in one scan."""
    measures = {
        "n": F.count,
        "mean": lambda c: F.round(F.avg(c), digits),
        "sd": lambda c: F.round(F.stddev_samp(c), digits),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    wide = df.agg(*[make(F.col(c)).alias(f"{name}:{c}") for c in columns for name, make in measures.items()])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), *[F.col(f"`{name}:{c}`").alias(name) for name in measures])
            for c in columns
        ]
    )
    return wide.select(F.inline(rows))


def tabulate(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Frequency, percentage and cumulative percentage of each value; null comes first. Values are put in order over many tasks."""
    freq = df.groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
    freq = running_total(freq, column, "freq", "upto")
    everything = freq.agg(F.sum("freq")).scalar()  # of the counted groups: no second scan
    return freq.select(
        column,
        "freq",
        percent(F.col("freq"), everything, digits).alias("pct"),
        percent(F.col("upto"), everything, digits).alias("cum_pct"),
    )


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; bin 0 and ``bins + 1`` hold what lies outside."""
    bucket = F.width_bucket(column, F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(bucket.alias("bin"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def regress(df: DataFrame, y: str, x: str, digits: int = 6) -> DataFrame:
    """Least squares of ``y`` on one ``x``."""
    return df.agg(
        F.regr_count(y, x).alias("n"),
        F.round(F.regr_slope(y, x), digits).alias("slope"),
        F.round(F.regr_intercept(y, x), digits).alias("intercept"),
        F.round(F.regr_r2(y, x), digits).alias("r2"),
    )


def _features(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(F.col(y).cast("double").alias("label"), *[F.col(x).cast("double").alias(x) for x in xs])
    return VectorAssembler(inputCols=list(xs), outputCol="features").transform(rows.dropna())


def _coefficients(df: DataFrame, model, xs: Sequence[str]) -> DataFrame:
    rows = [("_cons", float(model.intercept)), *zip(xs, map(float, model.coefficients))]
    return df.sparkSession.createDataFrame(rows, "variable string, coef double")


def regress_many(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares on several variables: ``(variable, coef)``."""
    from pyspark.ml.regression import LinearRegression

    return _coefficients(df, LinearRegression(solver="normal").fit(_features(df, y, xs)), xs)


def logit(df: DataFrame, y: str, xs: Sequence[str], max_iter: int = 50) -> DataFrame:
    """Logistic regression of a 0/1 column: ``(variable, coef)``."""
    from pyspark.ml.classification import LogisticRegression

    return _coefficients(df, LogisticRegression(maxIter=max_iter).fit(_features(df, y, xs)), xs)
