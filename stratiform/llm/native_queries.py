"""Queries over documents, pages and conversations whose operators use column expressions only."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.llm import chat, mixing, quality_rules, url_filters
from stratiform.llm.registry import query, table
from stratiform.llm.stored import stored

# The rules of the query, as host, path and verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

CHAT_SQL = r"""
WITH said AS (SELECT DISTINCT conv_id, turn, role, text, turn // 64 AS part FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL),
pieces AS (
  SELECT s.conv_id, p.speaker, s.part, s.turn, s.role, s.text, coalesce(s.role = p.speaker, false) AS own,
    CASE WHEN coalesce(s.role = p.speaker, false) THEN '<|im_start|>assistant' || chr(10)
         ELSE '<|im_start|>user name=' || replace(coalesce(s.role, 'unknown'), '<|', '< |') || chr(10) END AS head,
    replace(coalesce(s.text, ''), '<|', '< |') || '<|im_end|>' AS body
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM pieces)
SELECT conv_id, speaker, part, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text,
  coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY start)
    FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, speaker, part"""


@query("op3_chat_formatting", CHAT_SQL)
def op3_chat_formatting(spark, folder):
    """Every participant's view of every dialogue; ``mask`` writes the spans as ``start-stop,...``."""
    views = chat.rotate_perspectives(table(spark, folder, "conversations"))
    written = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string")))
    return views.withColumn("mask", F.array_join(written, ",")).drop("spans")


URL_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'),
  ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')),
rest AS (SELECT row_number() OVER () AS k, page_id, url,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT k, page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fitting AS (SELECT p.k, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
  max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (k)"""


@query("op5_url_filters", URL_SQL)
def op5_url_filters(spark, folder):
    """Rule and verdict of every page's URL; a URL that no rule fits is allowed."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = url_filters.rules_table(spark, RULES)
    return url_filters.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op7_quality_rules")
def op7_quality_rules(spark, folder):
    """Statistics and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    stats = stored(quality_rules.with_statistics(docs).drop("text"), "statistics")
    out = quality_rules.judged(stats, quality_rules.fit_groups(stats))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *counts, "base_failed", "kept", "d2")


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]
    AS weight, source_size::DOUBLE * 2.0::DOUBLE AS most FROM sources),
steps AS (SELECT *, coalesce(sum(most) OVER w, 0) AS held, sum(weight) OVER (ORDER BY most / weight, source
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE AS wanted FROM ranked
    WINDOW w AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT wanted - held AS top, rest FROM steps WHERE (wanted - held) / rest <= most / weight
    ORDER BY most / weight, source LIMIT 1),
targets AS (SELECT source, source_size, least(most, weight * top / rest) AS target FROM ranked, level),
rated AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE
      AS draw FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies, source
FROM rated"""


@query("op8_mixing", MIX_SQL)
def op8_mixing(spark, folder):
    """Copies and taken words of every document; sources weigh 5, 2, 1, repeating, and share 150 % of all words."""
    return mixing.mix_table(table(spark, folder, "documents"))
