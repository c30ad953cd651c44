"""Spelling variants, periodic runs and approximate neighbours against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.llm import ann, runs, spelling
from stratiform.llm.queries import registry

SCHEMA = "doc_id long, text string, word string, n long, runs string, key string, rep long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y", "z", 2) for d, t in rows], SCHEMA).repartition(3)


def written(docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda row: tuple((v is None, str(v)) for v in row))


# -- spelling variants ------------------------------------------------------------------------------------------------


def plain_variants(rows):
    count = collections.Counter()
    for key, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            count[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    mates = collections.defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            mates[a].append(b)
            mates[b].append(a)
    form = {}
    for word in words:
        best = min(mates[word], key=lambda w: (-words[w], w), default=None)
        if best and words[best] >= 2 * words[word]:
            form[word] = best
    out = []
    for word, n in words.items():
        root = word
        while root in form:
            root = form[root]
        out.append((word, form.get(word), root, n, len(mates[word]), words[form[word]] if word in form else None))
    return out


def edited(draw, word, letters):
    at = draw.randrange(len(word) + 1)
    return draw.choice([word[:at] + draw.choice(letters) + word[at + draw.randrange(2) :], word[:at] + word[at + 1 :]])


def test_variants(spark, tmp_path):
    draw = random.Random(3)
    letters = "abcé"
    base = ["".join(draw.choice(letters) for _ in range(draw.randrange(4, 9))) for _ in range(60)] + ["aaaaaaa", "ababababab", "Éàÿ÷×àé"]
    base += [edited(draw, w, letters) for w in base for _ in range(4)]
    base += [edited(draw, w, letters) for w in base[60:120]]
    words = [w for w in base for _ in range(draw.choice([1, 2, 3, 4, 7, 15, 40]))]
    draw.shuffle(words)
    rows = [(i, " ".join(words[i * 9 : i * 9 + 9]).title()) for i in range(len(words) // 9 + 1)]
    rows += [(None, "abcab, abcab. abcab_abcac"), (5, None), (6, ""), (7, "12 34"), (0, rows[0][1]), (0, rows[0][1])]
    rows += [(99, "ab" * 20000 + " " + "longword " * 3000)]
    docs = documents(spark, rows)
    expected = order(plain_variants(rows))
    assert sum(r[1] is not None for r in expected) > 30 and any(r[1] != r[2] for r in expected if r[1])
    assert order(spelling.group_variants(docs).collect()) == expected
    got = registry.QUERIES["op11_spelling_variants"](spark, written(docs, tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert order(got.collect()) == expected


def test_variants_of_nothing(spark):
    assert spelling.group_variants(documents(spark, [])).collect() == []
    assert spelling.group_variants(documents(spark, [(1, None), (2, "few words")])).collect() == []


def test_near_words_by_all_pairs(spark):
    """Every pair of a dense set, words of four letters and repeated letters included."""
    words = ["".join(w) for size in (4, 5, 6) for w in itertools.product("ab", repeat=size)]
    words += ["".join(w) for w in itertools.product("xyz", repeat=5)]
    got = {(r["word"], r["near"]) for r in spelling.near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()}
    shorter = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} for w in words}
    expected = set()
    for a, b in itertools.permutations(words, 2):
        if (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or a in shorter[b] or b in shorter[a]:
            expected.add((a, b))
    assert got == expected


def test_pivots_cost_least():
    draw = random.Random(1)
    for _ in range(300):
        places = sorted(draw.sample(range(12), 5))
        left, right = ([draw.randrange(50) for _ in places] for _ in "ab")
        a, b = spelling.pivots_of(places, left, right)
        cost = {(p, q): left[i] + right[j] for i, p in enumerate(places) for j, q in enumerate(places) if q - p >= 2}
        assert cost[a, b] == min(cost.values())


# -- periodic runs ----------------------------------------------------------------------------------------------------


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digests(rows):
    out = []
    for key, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        n, h = len(words), None if key is None else zlib.crc32(str(key).encode())
        if h is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        dropped = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        out.append((key, len(found), *best, 1000 * best[1] // best[2] if found else None, digest(listed), digest(kept)))
    return out


def looped(draw):
    n, alphabet = draw.choice([0, 1, 5, 6, 9, 40, 90]), draw.choice([1, 2, 3, 30])
    words = [draw.choice(["a", "bé", "A", "c,"]) if alphabet < 4 and draw.random() < alphabet / 4 else f"w{draw.randrange(alphabet)}" for _ in range(n)]
    if n and draw.random() < 0.6:
        a = draw.randrange(n)
        p = 1 + (n - a) // draw.randrange(3, 11)
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    return draw.choice([" ", "\n", "  \t"]).join(words)


def test_periodic_runs(spark, tmp_path):
    draw = random.Random(9)
    rows = [(i, looped(draw)) for i in range(400)]
    rows += [(None, "a b " * 9), (7, "a b " * 9), (7, "a b " * 9), (401, None), (402, ""), (403, " \n"), (404, "no " * 30000), (405, "x y z " * 4000 + "x")]
    docs = documents(spark, rows)
    expected = order(plain_digests(rows))
    assert sum(r[1] > 1 for r in expected) > 10
    got = registry.QUERIES["op12_periodic_runs"](spark, written(docs, tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert order(got.collect()) == expected
    assert runs.find_runs(documents(spark, [])).collect() == []


def test_grammar_extensions(monkeypatch):
    """Extensions both ways against comparing symbol by symbol, and runs when candidates come in small groups."""
    draw = random.Random(2)
    for trial in range(200):
        size, alphabet = draw.randrange(2, 80), draw.choice([1, 2, 5])
        inner = [draw.randrange(alphabet) for _ in range(size)]
        text = np.array([90, *inner, 91])
        a, b = np.array([x for x in itertools.combinations(range(1, size + 1), 2)]).T
        grammar = runs.Grammar(text)

        def reach(i, j, step):
            n = 0
            while text[i + n * step] == text[j + n * step]:
                n += 1
                if min(i + n * step, j + n * step) < 0 or max(i + n * step, j + n * step) >= len(text):
                    break
            return n

        assert grammar.ahead(a, b).tolist() == [reach(i, j, 1) for i, j in zip(a, b)]
        assert grammar.behind(a, b).tolist() == [reach(i, j, -1) for i, j in zip(a, b)]
    monkeypatch.setattr(runs, "TOGETHER", 5)
    words = [draw.randrange(2) for _ in range(200)] + [3, 4] * 30
    got = runs.runs_of(np.array(words), np.array([200, 0, 60]))
    expected = plain_runs(words[:200]) + [(s + 200, n, q) for s, n, q in plain_runs(words[200:])]
    assert [tuple(int(v) for v in r) for r in zip(*got)] == expected


# -- approximate neighbours -------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, rep string, score double, list int")


def plain_neighbours(rows, k=5):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            sound[i] = min(sound.get(i, v), v)
    ids = sorted(sound)
    points = np.array([sound[i] for i in ids], dtype=np.float32).astype(float)
    points /= np.linalg.norm(points, axis=1)[:, None]
    out = {}
    for row, i in enumerate(ids):
        if i % 50 == 0:
            score = np.round(points @ points[row], 12)
            best = sorted((-s, j) for s, j in zip(score, ids) if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


@pytest.mark.parametrize("part", [16384, 40])
def test_neighbours(spark, monkeypatch, tmp_path, part):
    """Clusters, a third of all rows copies of one vector, scaled copies, and vectors that take no part."""
    monkeypatch.setattr(ann, "PART", part)
    draw = np.random.default_rng(4)
    middle = draw.standard_normal((12, 24))
    rows = [(i, (middle[i % 12] + 0.4 * draw.standard_normal(24)).tolist()) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(900, 1350)]
    rows += [(1400, None), (1450, [0.0] * 24), (1500, [1.0, None] * 12), (1550, [float("nan")] * 24), (1551, [float("inf")] * 24), (None, [1.0] * 24)]
    rows += [(300, rows[300][1])]
    folder = str(tmp_path)
    vectors(spark, rows).write.parquet(f"{folder}/embeddings.parquet")
    got = collections.defaultdict(list)
    out = registry.QUERIES["op13_nearest_neighbours"](spark, folder)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    for r in out.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    expected = plain_neighbours(rows)
    assert set(got) == set(expected)
    found = 0
    for key, best in expected.items():
        assert [r for r, _, _ in got[key]] == [1, 2, 3, 4, 5]
        assert len({v for _, v, _ in got[key]}) == 5 and key not in {v for _, v, _ in got[key]}
        assert all(a >= b for (_, _, a), (_, _, b) in zip(got[key], got[key][1:]))
        found += len({v for _, v, _ in got[key]} & {v for v, _ in best})
    assert found >= 0.95 * 5 * len(expected)
    copies = [v for _, v, _ in got[900]]
    assert copies == [0, 901, 902, 903, 904]


def test_few_vectors(spark):
    ask = F.col("vec_id") % 50 == 0
    assert ann.nearest(vectors(spark, []), ask).collect() == []
    assert ann.nearest(vectors(spark, [(0, [0.0])]), ask).collect() == []
    assert ann.nearest(vectors(spark, [(0, [1.0, 2.0])]), ask).collect() == []
    assert ann.nearest(vectors(spark, [(1, [1.0]), (2, [2.0])]), ask).collect() == []
    got = ann.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [2.0, 2.0]), (-50, [1e-30, 0.0]), (3, [-1e30]), (4, [5.0])]), ask)
    rows = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in got.collect()}
    half = round(0.5**0.5, 9)
    assert rows == {
        (0, 1): (-50, 1.0), (0, 2): (4, 1.0), (0, 3): (1, half), (0, 4): (3, -1.0),
        (-50, 1): (0, 1.0), (-50, 2): (4, 1.0), (-50, 3): (1, half), (-50, 4): (3, -1.0),
    }


def test_scan_gives_up_candidates():
    """The test abandons most candidates early, and loses almost none of the nearest."""
    draw = np.random.default_rng(8)
    turn = np.linalg.qr(draw.standard_normal((64, 64)))[0]
    points = (ann._unit(draw.standard_normal((20, 64)).repeat(300, axis=0) + 0.7 * draw.standard_normal((6000, 64))) @ turn).astype(np.float32)
    scan = ann.Scan(np.arange(6000), points, 18)
    hits = 0
    for i in range(50):
        ids, _ = scan.nearest(points[i * 7])
        exact = ((points - points[i * 7]) ** 2).sum(axis=1)
        hits += len(set(ids[:6].tolist()) & set(np.argsort(exact, kind="stable")[:6].tolist()))
    assert hits >= 0.97 * 300
    assert scan.given_up > scan.finished
