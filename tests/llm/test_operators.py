"""Operators against plain versions, over rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from stratiform.llm import (
    bloom_lm,
    chat,
    mixing,
    ngram_join,
    pieces,
    quality_rules,
    suffix_dedup,
    topk,
    toxic_spans,
    url_filters,
)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog while nine grey geese fly south over cold hills and rivers "
TEXTS = [
    LINE * 3,
    LINE + "one two three four five six seven eight nine ten eleven twelve",
    None,
    "",
    " \t\n",
    "few words",
    LINE * 3,
    "x " * 3000 + LINE,
    "Été à la plage ▁ naïve 😀 " * 12,
    LINE + "one two three four five six seven eight nine ten eleven dozen",
    "a\nb\na\nb\n\n a $ # b\n" * 4,
    "FEW words",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], ["s1", "s2", None][i % 3], None) for i, t in enumerate(TEXTS)]
    rows += [(None, LINE * 3, "en", "s1", 1), (0, LINE * 3, "en", "s1", 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def tokens(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def test_near_duplicates(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = {}
    for key, text in rows:
        w = tokens(text, True)
        made = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
        sets[key, text] = made
    parent = {key: key for key, _ in rows if key is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for (a, _), s in sets.items():
        for (b, _), t in sets.items():
            if None not in (a, b) and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    expected = sorted(((k, len(sets[k, t]), None if k is None else find(k)) for k, t in rows), key=str)
    got = ngram_join.link_documents(docs.withColumns({"token": F.lit(1), "rep": F.lit(2)}))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1
    wordless = {2, 3, 4}
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == sorted({find(k) for k in parent if k not in wordless} | wordless)


def test_links_of_many_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:j] + [f"n{i}"] + base[j + 1 :])) for i, j in enumerate(range(0, 60, 2))]
    rows += [(100 + i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    low = {k: k for k in sets}
    for _ in range(len(low)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
        if all(low[low[a]] == low[a] for a in low):
            break
    assert got == low


def test_links_of_a_large_loose_group(spark):
    """Many copies of one text, edited so much that only some pairs are similar enough, and a passage they share with others."""
    draw = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(draw.randrange(0, 4)):
            copy[draw.randrange(60)] = f"n{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(base[:20] + [f"u{i}x{k}" for k in range(30)])) for i in range(40)]
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    low = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(low)):
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    assert 1 < len(set(low.values())) < 200
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == low


@pytest.mark.parametrize("many", [-1.0, ngram_join.MANY])
def test_links_by_all_pairs(spark, monkeypatch, many):
    """Groups of edited copies of many sizes, with passages that groups share, against every pair; with and without leaders."""
    monkeypatch.setattr(ngram_join, "MANY", many)
    draw = random.Random(7)
    shared = [[f"s{p}x{k}" for k in range(30)] for p in range(3)]
    texts = []
    for group in range(40):
        base = [f"g{group}w{draw.randrange(60)}" for _ in range(draw.randrange(4, 90))] + (shared[group % 3] if group % 2 else [])
        for _ in range(draw.randrange(1, 9)):
            copy = list(base)
            for _ in range(draw.randrange(0, 4)):
                copy[draw.randrange(len(copy))] = f"n{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    draw.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(rows).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_pairs_that_parities_drop(spark):
    """Pairs that go on to the check by whole sets hold all links and few others; sizes lie on both sides of a power of two."""
    draw = random.Random(3)
    texts = []
    for size in (12, 34, 70, 130, 260, 600):
        base = [f"z{size}w{k}" for k in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, size // 60, size // 30, size // 4):
            copy = list(base)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = f"n{draw.randrange(10**6)}"
            texts.append(" ".join(copy[: len(copy) - draw.randrange(3)]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    signed = rows.mapInArrow(ngram_join._sign(ngram_join.SHINGLE), ngram_join.SIGNED).where("n_shingles > 0")
    classes = signed.select(F.col("doc_id").alias("rep"), "n_shingles", "parities").where("parities is not null")
    sizes = {r["rep"]: r["n_shingles"] for r in classes.collect()}
    # As in the lists, only documents whose sizes allow a link meet.
    met = [(i, j) for i in sizes for j in sizes if i < j and 4 * max(sizes[i], sizes[j]) <= 5 * min(sizes[i], sizes[j])]
    pairs = spark.createDataFrame(met, "x long, y long")
    got = {(r["x"], r["y"]) for r in ngram_join.possible(pairs, classes).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    links = {(i, j) for i, j in met if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links and links <= got
    assert len(got - links) < (len(met) - len(links)) / 2


def test_repeated_strings(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()), key=lambda r: r[0])
    first, expected = {}, []
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], key)
    for key, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < key:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        expected.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    out = suffix_dedup.remove_repeats(docs.withColumn("n_spans", F.lit("x")))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = out.where("doc_id is not null").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert out.where("doc_id is null").first()["n_removed"] == 0


def test_language_model(docs):
    out = bloom_lm.score_texts(docs, F.col("doc_id") == 9)
    rows = [(r["doc_id"], tokens(r["text"], True) + [0]) for r in docs.collect()]
    counts = collections.Counter(w for k, ws in rows if k != 9 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for key, words in rows:
        r = got[key][0]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(base, abs=1e-9)
        assert r["score"] < 0
    one = bloom_lm.score_texts(docs, F.col("doc_id") == 9, head=3).orderBy("doc_id", "n_tokens").collect()
    assert [r["base_score"] for r in one] == pytest.approx([r["base_score"] for r in out.orderBy("doc_id", "n_tokens").collect()])


def test_language_model_by_exact_counts(docs):
    """Scores against exact counts rounded as the filter holds them, mixed over both orders in plain Python."""
    import numpy as np

    rows = [(r["doc_id"], tokens(r["text"], True) + [0]) for r in docs.collect()]
    train = [words for key, words in rows if key != 9]
    ones = collections.Counter(w for words in train for w in words)
    twos = collections.Counter(pair for words in train for pair in zip([None, *words], words))
    total = sum(ones.values()) + len(ones) + 1
    held = lambda n: float(bloom_lm.count_at(bloom_lm.level_of(np.array([n])))[0]) if n else 0.0

    def score(words):
        out = 0.0
        for before, word in zip([None, *words], words):
            seen = ones[before] if before is not None else ones[0]
            two = min(held(twos[before, word]), seen, ones[word])
            weight = bloom_lm.PRIOR + bloom_lm.SPREAD * seen
            out += math.log10((two + weight * (ones[word] + 1) / total) / (seen + weight))
        return out

    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in bloom_lm.score_texts(docs, F.col("doc_id") == 9).collect())
    expected = sorted((str(key), len(words), score(words)) for key, words in rows)
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in expected], rel=1e-6)


def test_filter_grows_with_its_corpus():
    for count in (10**6, 10**8, 5 * 10**9):
        size, probes, bits = bloom_lm.filter_shape(count, 2)
        assert size >= 2 * count * bloom_lm.BITS_PER_TOKEN and probes == 8
        assert size >> bits <= 1 << 25, "a task fills a segment of 4 MB at most"


def test_rare_words_stay_below_frequent_ones():
    import numpy as np

    keys = np.array([7, 9, 11], dtype=np.uint64)
    head = np.sort(np.array([7, bloom_lm.END], dtype=np.uint64))
    counts = np.where(head == bloom_lm.END, 2, 5)
    first, levels = np.array([0, 3]), np.full((2, 3), 40)

    def chances(distinct):
        model = bloom_lm.Model(1 << 16, 6, 8, head, counts, 100, distinct)
        return model.logs(keys, first, *model.exact(keys), levels)

    # A false hit makes no word more frequent than the least of the frequent ones; when all are at hand, others are unknown.
    assert chances(50)[0] <= math.log10(6) and chances(50)[1] <= 0
    weight = bloom_lm.PRIOR + bloom_lm.SPREAD * 5
    assert chances(2)[1] == pytest.approx(math.log10(weight * (1 / 103) / (5 + weight)))
    assert chances(50)[1] == pytest.approx(math.log10((5 + weight * 6 / 151) / (5 + weight)))


def test_quantised_counts():
    import numpy as np

    count = np.arange(1, 2000)
    level = bloom_lm.level_of(count)
    assert (level <= count).all() and (np.diff(level) >= 0).all()
    guess = bloom_lm.count_at(level)
    assert (np.abs(guess - count) <= 0.35 * count).all() and (guess[:3] == count[:3]).all()


def test_pieces(docs):
    codec = pieces.Codec(pieces.read_model(MODEL))
    held = pieces.read_model(MODEL)
    scores = {t.replace("▁", pieces.MARK): s for t, s, kind in held if kind == 1}
    longest = max(map(len, scores))

    def best(text):
        value = [0.0] + [-math.inf] * len(text)
        for i in range(1, len(text) + 1):
            value[i] = value[i - 1] + codec.floor * len(text[i - 1].encode(errors="surrogatepass"))
            for size in range(1, min(longest, i) + 1):
                if text[i - size : i] in scores:
                    value[i] = max(value[i], value[i - size] + scores[text[i - size : i]])
        return value[-1]

    import numpy as np

    for text in TEXTS:
        ids = np.frombuffer(codec.encode(text or ""), dtype=np.int32).tolist()
        assert codec.decode(ids) == (text or "")
        if text and len(text) < 400:
            got = sum(held[i][1] if held[i][2] == 1 else codec.floor for i in ids)
            assert got >= best(pieces.MARK + text.replace(" ", pieces.MARK)) - 1e-6
    out = pieces.decode_pieces(pieces.encode_pieces(docs.withColumn("ids", F.lit(0)), MODEL), MODEL)
    assert all(r["decoded"] == r["text"] for r in out.collect())


def test_text_statistics(docs):
    for r in quality_rules.text_statistics(docs).collect():
        text = r["text"] or ""
        w = [x.decode() for x in tokens(text)]
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_outliers_go(spark):
    rows = [(i, " ".join(f"word{(i * 31 + k * 7) % 97}x{k % 13}" for k in range(40 + i % 9)), "en", "s", 0) for i in range(80)]
    rows += [(1000, " ".join(f"$$%%w{k}##&&" for k in range(60)), "en", "s", 0)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out.pop(1000) and all(out.values())
    assert quality_rules.judge_quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixing(docs):
    table = mixing.mix_table(docs).collect()
    assert len(table) == docs.count()
    assert all(r["taken"] <= 2 * r["size"] for r in table)
    mixed = mixing.mix_sources(docs)
    assert sum(r["copies"] for r in mixed.collect()) == mixing.emit_copies(mixed).count()
    assert {(r["doc_id"], r["taken"]) for r in table} == {(r["doc_id"], r["taken"]) for r in mixed.collect()}


def test_top_products(spark):
    rows = [(i, [float((i * 7 + k * 3) % 11 - 5) for k in range(6)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan")] * 6), (63, [1e300, 1.0]), (64, []), (None, [1.0]), (3, rows[3][1])]
    got = collections.defaultdict(list)
    out = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    for r in out.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    sound = {i: [min(max(math.floor(1024 * x), -(1 << 63)), (1 << 63) - 1) for x in v] for i, v in rows[:60] + rows[63:65]}
    for q in (0, 20, 40):
        each = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(sound[q], v)))), i) for i, v in sound.items() if i != q]
        assert got[q] == [(i, s) for s, i in sorted(each, key=lambda x: (-x[0], x[1]))[:10]]


def test_toxic_words(spark):
    words = [f"w{i}" for i in range(50)]
    clean = [" ".join(words[(i * 7 + k * 3) % 50] for k in range(30)) for i in range(60)]
    toxic = [c + " badword" + " vileterm" * (i % 2) for i, c in enumerate(clean)]
    model = toxic_spans.fit(clean + toxic, [0] * 60 + [1] * 60, 0.5)
    table = spark.createDataFrame([(0, "w1 badword w2"), (1, "w1 w2 w3"), (2, None), (3, ""), (4, "é badword")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxic_spans.tag_toxic(table.withColumn("score", F.lit("x")), model).collect()}
    assert [out[i]["predicted"] for i in range(5)] == [1, 0, 0, 0, 1]
    assert [tuple(s) for s in out[0]["spans"]] == [(3, 10)] and [tuple(s) for s in out[4]["spans"]] == [(2, 9)]
    assert toxic_spans.fit(["a"], [0], 0.0).weights.any() == False  # noqa: E712


def test_marginals_by_enumeration():
    import itertools

    import numpy as np

    scores, jumps = np.array([0.3, -1.0, 2.0, 0.5]), np.array([[0.2, -0.4], [-0.1, 0.9]])
    total, on = 0.0, np.zeros(4)
    for states in itertools.product((0, 1), repeat=4):
        weight = math.exp(sum(s * x for s, x in zip(states, scores)) + sum(jumps[a, b] for a, b in zip(states, states[1:])))
        total += weight
        on += weight * np.array(states)
    assert toxic_spans.marginals(scores, np.array([0, 4, 4]), jumps) == pytest.approx(on / total)
    chance, counts = toxic_spans.pair_marginals(scores.reshape(1, 4), jumps)
    assert chance[0] == pytest.approx(on / total) and counts.sum() == pytest.approx(3)


def test_url_rules(spark):
    rules = url_filters.rules_table(spark, [("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x", "allow")])
    urls = ["http://A.com/xy?q", "http://b.a.com/z", "nothing", None, "http://com", "http://xa.com/x", "ftp://a.com/x#y"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, rules).collect()}
    assert len(got) == 14
    assert got[0] == ("a.com", "/xy", "a.com/x", "block") and got[1] == ("b.a.com", "/z", "com/", "allow")
    assert got[2] == got[3] == ("", "", None, "allow") and got[4] == ("com", "", None, "allow")
    assert got[5][2] == "com/" and got[6][2] == "a.com/x"


def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "<|im_end|>"), (1, 1, "bob", "<|im_end|>"), (1, 2, None, None), (None, None, "ann", "x")]
    rows += [(2, i, "ann", "t") for i in range(130)]
    out = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 64)
    views = {(r["conv_id"], r["speaker"], r["part"]): r for r in out.collect()}
    assert set(views) == {(1, "ann", 0), (1, "bob", 0), (None, "ann", None), (2, "ann", 0), (2, "ann", 1), (2, "ann", 2)}
    view = views[1, "bob", 0]
    assert view["n_turns"] == 3 and len(view["spans"]) == 1
    start, stop = view["spans"][0]
    assert view["text"][start:stop] == "< |im_end|><|im_end|>" and "user name=unknown" in view["text"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.link_documents(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert mixing.mix_table(empty).count() == 0
    assert bloom_lm.score_texts(empty, F.col("doc_id") == 1).count() == 0
    assert topk.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


def uncovered(rows, length):
    """Bytes of each row that no ``length``-byte string of a document with a smaller id covers."""
    first = {}
    for key, text in rows:
        data = text.encode()
        for i in range(len(data) - length + 1):
            first[data[i : i + length]] = min(key, first.get(data[i : i + length], key))
    out = []
    for key, text in rows:
        data = text.encode()
        gone = set()
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < key:
                gone.update(range(i, i + length))
        out.append((key, bytes(b for i, b in enumerate(data) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("piece", [97, 300])
def test_repeats_across_piece_cuts(spark, monkeypatch, piece):
    """Runs don't depend on where data are cut, so every pass finds them whatever rows it holds together."""
    import numpy as np

    draw = random.Random(piece)
    letters = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passages = [letters(draw.randrange(50, 130)) for _ in range(12)]
    rows = []
    for key in range(60):
        parts = [letters(draw.randrange(200))] + [draw.choice(passages) + letters(draw.randrange(90)) for _ in range(3)]
        rows.append((key, "".join(parts)))
    data = np.frombuffer("".join(t for _, t in rows).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t) for _, t in rows)])
    whole = suffix_dedup.runs(data, offsets)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    assert all((a == b).all() for a, b in zip(suffix_dedup.runs(data, offsets), whole, strict=True))

    # The first two passes carry the short pieces to their workers; the last cuts as ever, and must find the same runs.
    found = suffix_dedup.runs
    monkeypatch.setattr(suffix_dedup, "runs", lambda *given: found(*given))
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        got = suffix_dedup.remove_repeats(docs).select("doc_id", "text").collect()
        assert sorted((r[0], r[1]) for r in got) == uncovered(rows, suffix_dedup.LENGTH)


@pytest.mark.parametrize("copies", [30, 60, 90])
def test_a_third_of_junk_copies_goes(spark, copies):
    """Up to a third of a group may be copies of one odd text; they neither stay nor drag others out."""
    draw = random.Random(3)
    plain = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(80))
    junk = " ".join(f"{k:03d}" + "z" * 37 for k in range(60))
    rows = [(i, plain() if i >= copies else junk, "en", "s1") for i in range(270)]
    out = quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"]: r["kept"] for r in out.select("doc_id", "kept").collect()}
    assert not out.where("base_failed").count()
    assert kept == {i: i >= copies for i in range(270)}
