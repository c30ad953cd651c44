"""Every stage of the pipeline row by row against plain Python, the estimate behind the quality rules, and clashing names."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratiform.llm import mixing, pieces, quality_rules, topk, url_filters
from stratiform.session import new_folder
from tests.llm.test_operators import uncovered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Sources of uneven size, near and exact copies, passages that several share, junk and rows that fail the base rules."""
    draw = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    words = ["".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4))) for _ in range(600)]
    passage = " ".join(draw.choice(words) for _ in range(40))
    rows = []
    for i in range(90):
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(15, 70)))
        if i % 9 == 0:
            text = f"{text} {passage} {draw.choice(words)}"
        if i % 13 == 0:
            text = f"{text}\n{text[:30]}\nend {i}"
        rows.append([i, text, ["en", "fr", None][i % 3 if i % 2 else 0], ["hot", "hot", "b", "c", None][i % 5]])
    for i in range(90, 102):
        copy = rows[i - 80][1].split(" ")
        if i % 2:
            copy[-1] = "edited"
        rows.append([i, " ".join(copy), *rows[i - 80][2:]])
    rows += [[200 + i, " ".join(f"$$%%{k}##&&{i}" for k in range(60)), "en", "hot"] for i in range(2)]
    rows += [[300, None, "en", "hot"], [301, "", None, None], [302, "too few words", "en", "b"], [303, "x y " * 90, "en", "c"]]
    return [(*row, len(row[1] or "")) for row in rows]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def statistics(text):
    w = split(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if split(line)]
    n = len(w) + 50
    rates = [(sum(map(len, w)) + 300) / n, len(re.findall(r"[#*$%&|<>]", text or "")) / n]
    rates += [(len(lines) - len(set(lines))) / n, len(covered) / n]
    x = np.array([rates[0], *np.sqrt(rates[1:])])
    return x, len(w), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def plain_quality(rows):
    """Distance and verdict of each row, by the same steps with matrices."""
    found = [statistics(row[1]) for row in rows]
    floor = np.diag([0.35**2, 0.04**2, 0.06**2, 0.15**2])
    groups, out = collections.defaultdict(list), []
    for row, (x, n, _) in zip(rows, found):
        if n:
            groups[row[2], row[3]].append(x)
    fits = {}
    for key, xs in groups.items():
        xs = np.array(xs)
        mean, cov = np.sort(xs, axis=0)[math.ceil(len(xs) / 2) - 1], floor
        for step in range(4):
            d2 = np.einsum("ij,jk,ik->i", xs - mean, np.linalg.inv(cov), xs - mean)
            if step < 3:
                bins = np.floor(np.log2(d2 + 2.0**-20) * 32)
                use = bins <= np.sort(bins)[math.ceil(len(xs) / 2) - 1]
            else:
                use = d2 <= 11.143
            mean = xs[use].mean(axis=0) if use.any() else np.zeros(4)
            spread = np.cov(xs[use].T, bias=True) if use.any() else np.zeros((4, 4))
            cov = spread * (2.109 if step < 3 else 1.0) + floor
        fits[key] = mean, np.linalg.inv(cov)
    for row, (x, _, failed) in zip(rows, found):
        mean, inverse = fits.get((row[2], row[3]), (None, None))
        d2 = None if mean is None else float((x - mean) @ inverse @ (x - mean))
        out.append((row[0], d2, not failed and not (d2 is not None and d2 > 33.377)))
    return out


def plain_near_duplicates(rows):
    sets = {}
    for row in rows:
        w = split(row[1].lower())
        sets[row[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    low = {key: key for key in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[a] != low[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return [row for row in rows if low[row[0]] == row[0]]


def plain_repeats(rows):
    texts = dict(uncovered([row[:2] for row in rows], 50))
    return [(row[0], texts[row[0]], row[2], row[3], len(texts[row[0]])) for row in rows]


def plain_mix(rows):
    sizes = collections.Counter()
    for row in rows:
        sizes[row[3]] += len(split(row[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            target.update({s: weight[s] * level for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left, open_ = left - sum(2 * sizes[s] for s in over), open_ - over
    out = []
    for row in rows:
        rate = target[row[3]] / sizes[row[3]] if sizes[row[3]] else 0.0
        drawn = int(hashlib.md5(f"mix:{row[0]}".encode()).hexdigest()[:13], 16) / 16.0**13
        out += [row] * (math.floor(rate) + (drawn < rate - math.floor(rate)))
    return out


def best_score(text, scores, longest):
    value = [0.0] + [-math.inf] * len(text)
    for i in range(1, len(text) + 1):
        for size in range(1, min(longest, i) + 1):
            score = scores.get(text[i - size : i])
            if score is not None:
                value[i] = max(value[i], value[i - size] + score)
    return value[-1]


def same(frame, rows):
    got = collections.Counter(tuple(r) for r in frame.select(*COLUMNS).collect())
    assert got == collections.Counter(rows)


def test_stages_row_by_row(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plain = {
        "quality rules": lambda rows: [row for row, (_, _, kept) in zip(rows, plain_quality(rows)) if kept],
        "n-gram Jaccard join": plain_near_duplicates,
        "suffix-array dedup": plain_repeats,
        "mixing sources": plain_mix,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = len(rows), plain[name](rows)
        folder = new_folder(spark, "test")
        stage(spark, docs, "").write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.columns == COLUMNS
        same(docs, rows)
        assert rows and (name == "suffix-array dedup" or len(rows) != before)
    model = pieces.read_model(corpus_pipeline.MODEL)
    scores = {text: score for text, score, kind in model if kind == 1}
    longest = max(map(len, scores))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(row[0] for row in rows)
    texts = {row[0]: row[1] for row in rows}
    for r in {r["doc_id"]: r for r in out}.values():
        assert r["lossless"] and r["n_pieces"] == len(r["ids"])
        marked = "▁" + texts[r["doc_id"]].replace(" ", "▁")
        if "\n" not in marked:
            assert "".join(model[i][0] for i in r["ids"]) == marked
            assert sum(model[i][1] for i in r["ids"]) == pytest.approx(best_score(marked, scores, longest), abs=1e-3)


def test_distances_by_matrices(spark):
    rows = corpus()
    out = {r["doc_id"]: r for r in quality_rules.judge_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    for key, d2, kept in plain_quality(rows):
        assert out[key]["d2"] == (None if d2 is None else pytest.approx(d2, rel=1e-6, abs=1e-9))
        assert out[key]["kept"] == kept
    assert not out[200]["kept"] and not out[201]["kept"]


def test_steps_of_the_fit_join_tables_of_known_size(spark, monkeypatch):
    """No step shuffles all rows or fills Bloom filters to find estimates of one row a group."""
    plans, plain = [], quality_rules._with_distance

    def seen(*args, **named):
        out = plain(*args, **named)
        query = out._jdf.queryExecution()
        plans.append(query.optimizedPlan().toString() + query.executedPlan().toString())
        return out

    monkeypatch.setattr(quality_rules, "_with_distance", seen)
    assert quality_rules.judge_quality(spark.createDataFrame(corpus(), SCHEMA)).count() == len(corpus())
    assert len(plans) == quality_rules.STEPS + 1
    for plan in plans:
        assert "BroadcastHashJoin" in plan
        assert "might_contain" not in plan and "Exchange hashpartitioning" not in plan


def test_columns_of_any_name_come_back(spark):
    names = ["m0", "l10", "c01", "x0", "y0", "d2", "row", "copy", "_copy", "_words", "_source", "_url", "_best", "_rule", "dotted.name", "url"]
    extra = {name: F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")) for name in names}
    docs = spark.createDataFrame(corpus(), SCHEMA).withColumns(extra)
    again = [name for name in names if name != "d2"]

    def whole(frame, kept):
        for row in frame.select("doc_id", *[F.col(f"`{name}`") for name in kept]).collect():
            assert list(row[1:]) == [f"{name} {row[0]}" for name in kept]

    judged = quality_rules.judge_quality(docs)
    assert judged.count() == docs.count() and dict(judged.dtypes)["d2"] == "double"
    whole(judged, again)
    mixed = mixing.mix_sources(docs)
    whole(mixed, names)
    whole(mixing.emit_copies(mixed), names)
    rules = url_filters.rules_table(spark, [("net", "/", "block")])
    pages = docs.withColumns({"address": F.lit("http://a.net/b"), "host": F.lit("old")})
    for some in (rules, rules.limit(0)):
        out = url_filters.filter_urls(pages, some, url="address")
        whole(out, names)
        assert {r["host"] for r in out.select("host").collect()} == {"a.net"}
    assert {r["verdict"] for r in url_filters.filter_urls(pages, rules, url="address").collect()} == {"block"}


def test_search_of_uneven_vectors(spark):
    """Lengths over three powers of ten, several bands a task and ties, against all products."""
    draw = np.random.default_rng(3)
    base = draw.normal(size=(900, 12)) * 10 ** draw.uniform(-2, 1, size=(900, 1))
    base[50:60] = base[40]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    out = topk.top_products(frame, F.col("vec_id") % 10 == 0)
    whole = np.floor(1024 * base).astype(np.int64)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 90
    for query, answer in got.items():
        products = whole @ whole[query]
        order = sorted((i for i in range(900) if i != query), key=lambda i: (-products[i], i))[:10]
        assert sorted(answer) == [(k + 1, i, products[i]) for k, i in enumerate(order)]
