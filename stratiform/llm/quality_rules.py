"""Quality rules: word statistics of a text, and robust multivariate outliers within each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm.stored import discard, stored
from stratiform.llm.words import words

# Fixed values, for four dimensions: the part of each group that the estimate rests on, the factor that makes the
# covariance of that part consistent, and chi-square quantiles at 0.975 (reweighting) and at one in a million (rejection).
PART, FACTOR, NEAR, FAR = 0.5, 2.109, 11.143, 33.377
STATISTICS = ("x0", "x1", "x2", "x3")
SIZE = len(STATISTICS)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
#: Spread that each statistic has at least, so that a group of equal documents doesn't reject small differences.
SPREAD = (0.35, 0.04, 0.06, 0.15)
PRIOR = 50
STEPS = 4
BINS = 32
KEYS = ("lang", "source")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _windows(w: Column) -> Column:
    """Hash of every window of five words."""
    each = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))
    places = F.when(F.size(w) >= 5, F.sequence(F.lit(0), F.size(w) - 5)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, each)


def _covered(hashes: Column) -> tuple[Column, Column]:
    """Sorted windows, and from their column the words in windows found twice or more, each word once."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered_column, last = F.col("_ordered"), F.size(hashes) - 1

    def equal(window: Column, place: Column) -> Column:
        before = (place > 0) & (F.get(ordered_column, place - 1)["h"] == window["h"])
        after = (place < last) & (F.get(ordered_column, place + 1)["h"] == window["h"])
        return before | after

    places = F.sort_array(F.transform(F.filter(ordered_column, equal), lambda window: window["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    count = F.aggregate(
        places,
        start,
        lambda held, i: F.struct((held["n"] + F.least(F.lit(5), i - held["last"])).alias("n"), i.alias("last")),
        lambda held: held["n"],
    )
    return ordered, count


def text_statistics(docs: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``base_failed``; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = out.withColumn("_words", words(F.col("text")))
    out = out.withColumn("_windows", _windows(F.col("_words")))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered, covered = _covered(F.col("_windows"))
    out = out.withColumn("_ordered", F.when(again, ordered))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, " \t\x0b\x0c\r", "") != "")
    out = out.withColumn("_lines", F.when(F.contains(text, F.lit("\n")), lines))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long"),
            "n_repeat_words": F.when(F.col("_ordered").isNotNull(), covered).otherwise(0).cast("long"),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_windows", "_ordered", "_lines")


def _vector() -> dict[str, Column]:
    """Rates per word, drawn towards a common value in short texts, whose rates say little."""
    n = F.col("n_words") + PRIOR
    rates = (
        (F.col("word_chars") + 6.0 * PRIOR) / n,
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return dict(zip(STATISTICS, rates))


def _distance() -> tuple[dict[tuple[int, int], Column], list[Column]]:
    """The Cholesky factor of the covariance, and the standardised statistics it gives, written out as columns."""
    size = len(STATISTICS)
    cov = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")
    factor: dict[tuple[int, int], Column] = {}
    solved: list[Column] = []
    for i in range(size):
        rest = F.col(STATISTICS[i]) - F.col(f"m{i}")
        for j in range(i + 1):
            value = cov(i, j)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            factor[i, j] = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        solved.append(rest / F.col(f"l{i}{i}"))
    return factor, solved


def _with_distance(rows: DataFrame, estimates: DataFrame, differences: bool = False) -> DataFrame:
    """Adds ``d2`` to every row; the groups' estimates are joined null-safe. The middle and the differences from it may stay."""
    factor, solved = _distance()
    held = estimates.select(*(F.col(k).alias(f"_{k}") for k in KEYS), *(c for c in estimates.columns if c not in KEYS))
    for (i, j), value in factor.items():
        held = held.withColumn(f"l{i}{j}", value)
    names = [c for c in held.columns if c[0] != "_"]
    match = F.lit(True)
    for key in KEYS:
        match = match & F.col(key).eqNullSafe(F.col(f"_{key}"))
    out = rows.join(held, match, "left")
    for i, value in enumerate(solved):
        out = out.withColumn(f"y{i}", value)
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(solved))), F.col("y0") * F.col("y0"))
    out = out.withColumn("d2", d2)
    if differences:
        out = out.withColumns({f"e{i}": F.col(x) - F.col(f"m{i}") for i, x in enumerate(STATISTICS)})
        names = [c for c in names if c[0] != "m"]
    return out.drop(*names, *(f"_{k}" for k in KEYS), *(f"y{i}" for i in range(len(solved))))


def _bin(d2: Column) -> Column:
    return F.least(F.floor(F.log2(d2 + 2.0**-20) * BINS), F.lit(200 * BINS)).cast("int")


def _moments(near: DataFrame, *by: str) -> DataFrame:
    """Rows, and sums of their differences ``e0`` to ``e3`` from the group's middle and of the products of these."""
    return near.groupBy(*KEYS, *by).agg(
        F.count("e0").alias("n"),
        *(F.max(f"m{i}").alias(f"m{i}") for i in range(SIZE)),
        *(F.sum(f"e{i}").alias(f"s{i}") for i in range(SIZE)),
        *(F.sum(F.col(f"e{i}") * F.col(f"e{j}")).alias(f"p{i}{j}") for i, j in PAIRS),
    )


def _near_part(bins: DataFrame) -> DataFrame:
    """The nearest bins of each group, up to the one in which the wanted part of its rows is reached, put together."""
    each = Window.partitionBy(*KEYS)
    before = F.coalesce(F.sum("n").over(each.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("*", before.alias("_before"), F.sum("n").over(each).alias("_total"))
    sums = ["n", *(f"s{i}" for i in range(SIZE)), *(f"p{i}{j}" for i, j in PAIRS)]
    whole = [*(F.max(f"m{i}").alias(f"m{i}") for i in range(SIZE)), *(F.sum(c).alias(c) for c in sums)]
    return bins.where(F.col("_before") < PART * F.col("_total")).groupBy(*KEYS).agg(*whole)


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Mean and covariance from the sums of a group; every spread is at least the stated one."""
    per_row = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    out = [F.coalesce(F.col(f"m{i}") + per_row(f"s{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(SIZE)]
    for i, j in PAIRS:
        value = F.coalesce(per_row(f"p{i}{j}") - per_row(f"s{i}") * per_row(f"s{j}"), F.lit(0.0)) * factor
        out.append((value + (SPREAD[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}"))
    return sums.select(*KEYS, *out)


def fit_groups(stats: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of each language and source, over all its documents.

    Concentration steps start from all rows, with the statistics cut at their group's quartiles' reach by the first
    distance; each step keeps the nearest half of a group, so that a third of it may be copies of one odd text, and
    estimates anew, which never raises the determinant. A last step takes every row within the 0.975 quantile. Estimates are one row a group.
    They are stored tables, whose size Spark knows: that of a checkpoint behind a join counts as a product of sizes, for which each step
    would shuffle all rows and fill Bloom filters of megabytes that every task then carries.
    """
    rows = stats.where("n_words > 0").select(*KEYS, *STATISTICS)
    middle = [F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(STATISTICS)]
    start = [
        F.lit(SPREAD[i] ** 2 if i == j else 0.0).alias(f"c{i}{j}")
        for i in range(len(STATISTICS))
        for j in range(i, len(STATISTICS))
    ]
    estimates = rows.groupBy(*KEYS).agg(*middle).select("*", *start)
    held = []
    for step in range(STEPS):
        held.append(stored(estimates, "estimates"))
        near = _with_distance(rows, held[-1], differences=True)
        if step < STEPS - 1:
            sums = _near_part(_moments(near.withColumn("_bin", _bin(F.col("d2"))), "_bin"))
            estimates = _estimates(sums, FACTOR)
        else:
            given = {f"e{i}": F.when(F.col("d2") <= NEAR, F.col(f"e{i}")) for i in range(SIZE)}
            estimates = _estimates(_moments(near.withColumns(given)), 1.0)
    estimates = stored(estimates, "estimates")
    discard(*held)
    return estimates


def judge_quality(docs: DataFrame, limit: float = FAR) -> DataFrame:
    """Adds the text statistics, ``base_failed``, ``d2`` (squared distance from the group) and ``kept`` to every document.

    A document is kept when it doesn't fail the base rules and its distance is within ``limit``. Null languages and
    sources are groups of their own; a group of one or of equal documents rejects nothing; repeated rows are judged
    alike; an empty table gives an empty one; columns named like the new ones are replaced, all others come back as they
    were, whatever their names: they travel as one column. Documents are stored with their statistics, so that a text is
    read once and later expressions start from plain columns.
    """
    given = docs.drop(*COUNTS, "base_failed", "d2", "kept")
    rows = given.select(F.struct("*").alias("row"), *KEYS, "text")
    rows = stored(with_statistics(rows).drop("text"), "quality", texts=True)
    out = judged(rows, fit_groups(rows), limit)
    return out.select("row.*", *COUNTS, "base_failed", "d2", "kept")


def with_statistics(docs: DataFrame) -> DataFrame:
    return text_statistics(docs.drop(*STATISTICS, "d2", "kept")).withColumns(_vector())


def judged(rows: DataFrame, estimates: DataFrame, limit: float = FAR) -> DataFrame:
    out = _with_distance(rows, estimates)
    far = F.coalesce(F.col("d2") > limit, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop(*STATISTICS)
