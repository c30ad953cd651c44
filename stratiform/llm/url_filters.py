"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm.words import lower_ascii

PREFIX = 8


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and every subdomain when the
    path starts with the rule's path. The longest rule wins; of equal rules, block does. Without a rule the verdict is
    ``default`` and ``rule`` is null.

    The forms that rules have (labels of the host, length of the path) are read first; a URL is expanded into one
    expression per form, joined on a short prefix of its digest, and confirmed by the whole digest. Each distinct URL is
    looked up once. Null or malformed URLs have an empty host and path; repeated rows are all returned; an empty rule
    table leaves the default everywhere; rules with a null part are left out. Columns named like the new ones are replaced,
    all others come back as they were, whatever their names: they travel as one column.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
    rules = rules.select(
        F.concat("host", "path").alias("_rule"),
        "verdict",
        _digest(F.col("host"), F.col("path")).alias("_digest"),
        F.size(F.split("host", "\\.")).alias("_labels"),
        F.length("path").alias("_length"),
    )
    # As many forms as rules differ in shape: labels of a host name times lengths of a path.
    forms = [tuple(row) for row in rules.select("_labels", "_length").distinct().collect()]
    others = [F.col(f"`{name}`") for name in pages.drop("host", "path", "rule", "verdict").columns]
    given = F.col(f"`{url}`")
    pages = pages.select(F.struct(*others).alias("row"), given.alias("url"), url_host(given).alias("host"), url_path(given).alias("path"))
    if not forms:
        return pages.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    host, path = F.col("host"), F.col("path")
    dots = F.length("host") - F.length(F.replace(host, F.lit(".")))
    expressions = F.array(
        *(
            F.when(
                (dots >= labels - 1) & (F.length("path") >= length),
                _digest(F.substring_index(host, ".", -labels), F.substring(path, 1, length)),
            )
            for labels, length in sorted(forms)
        )
    )
    looked_up = pages.select(F.col("url").alias("_url"), "host", "path").where(host != "").distinct()
    looked_up = looked_up.select("_url", F.explode(F.array_compact(expressions)).alias("_asked"))
    looked_up = looked_up.withColumn("_prefix", F.substring("_asked", 1, PREFIX))
    found = looked_up.join(rules.withColumn("_prefix", F.substring("_digest", 1, PREFIX)), "_prefix")
    found = found.where("_asked = _digest")
    best = F.max(F.struct(F.length("_rule").alias("size"), "verdict", F.col("_rule").alias("rule"))).alias("_best")
    found = found.groupBy("_url").agg(best)
    out = pages.join(found, F.col("url") == F.col("_url"), "left")
    verdict = F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    return out.select("row.*", "host", "path", F.col("_best.rule").alias("rule"), verdict)


def rules_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules written as (host, path, verdict)."""
    literal = [F.struct(*(F.lit(x).alias(n) for x, n in zip(rule, ("host", "path", "verdict")))) for rule in rules]
    return reduce(DataFrame.unionAll, (spark.range(1).select(F.inline(F.array(rule))) for rule in literal))
