"""Operators for training data: brute force on small fixtures, and nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from framesieve.functions.text import py_words
from framesieve.llm import bpe, distinctive, leaks, quantiles, ranking, records, repetition, stuffing, terms, truncation
from framesieve.llm import common
from framesieve.llm.common import one_per_id
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
LONG = "word " * 200_000
TEXTS = [None, "", "  \t", "?!…", "A cat, a cat!", "a cat a cat", "a cat a cat", "ÄÖ ß x² 12", "the end", LONG]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def texts(spark, values=TEXTS):
    """(id, text), with columns whose names operators use inside."""
    return spark.createDataFrame([(k, t, "x", 1, "y") for k, t in enumerate(values)], "doc bigint, body string, text string, id int, term string")


def empty(spark):
    return texts(spark).filter("doc < 0")


# 1


def brute_counts(values, sigma):
    cf, df = Counter(), Counter()
    for t in values:
        w = py_words(t)
        own = [(" ".join(w[i : i + n]), n) for n in range(1, sigma + 1) for i in range(len(w) - n + 1)]
        cf.update(own)
        df.update(set(own))
    return sorted(((g, n, cf[g, n], df[g, n]) for g, n in cf), key=repr)


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_term_counts(spark, sigma):
    rng = random.Random(sigma)
    values = [" ".join(rng.choices("a a a b c dd e.".split(), k=rng.randint(0, 9))) for _ in range(300)] + TEXTS[:-1]
    df = texts(spark, values).repartition(5)
    counts, n = terms.term_counts(df, "body", sigma)
    assert rows(counts, "term", "n", "cf", "df") == brute_counts(values, sigma) and n == len(values)
    counts, n = terms.term_counts(empty(spark), "body", sigma)
    assert counts.count() == 0 and n == 0


def test_term_counts_hot_and_long(spark):
    got = rows(terms.term_counts(texts(spark), "body", 2)[0], "term", "n", "cf", "df")
    assert ("word", 1, 200_000, 1) in got and ("word word", 2, 199_999, 1) in got


def test_marks_and_ids(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 10)], "term string, df bigint")
    assert rows(terms.marked_terms(counts, 100), "term", "mark") == [("a", "rare"), ("b", "rare"), ("c", "kept"), ("d", "common")]
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "z")], "doc bigint, c0 string")
    assert rows(one_per_id(twice, "doc", "c0"), "doc", "c0") == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        terms.term_counts(twice, "c0", 0)


def test_joined_by_key(spark, monkeypatch):
    left = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 7}") for k in range(200)] + [(999, "none"), (1000, None)], "row int, key string").repartition(3)
    table = spark.createDataFrame([("hot", 1), *((f"k{k}", k) for k in range(6))], "key string, n int")
    want = rows(left.join(table, "key", "left"), "row", "key", "n")
    for hot in (1000, 50, 0):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        monkeypatch.setattr(common, "HOT_SHARE", 0.0)
        assert rows(common.joined_by_key(left, table, "key"), "row", "key", "n") == want


# 2


def test_cells_keep_order():
    x = np.sort(np.concatenate([np.random.default_rng(0).normal(0, 100, 5000), [0.0, -0.0, 1e-300, np.inf, -np.inf, 1e300]]))
    cell = quantiles.cells(x)
    low, high = quantiles.cell_ends(cell)
    assert (np.diff(cell) >= 0).all() and (low <= x).all() and (x <= high).all()


@pytest.mark.parametrize("k", [5, 50, 500])
def test_fold_bound(k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.lognormal(0, 2, 4000), np.zeros(2000), rng.integers(0, 5, 1000)])
    parts = [quantiles.fold(quantiles.cells(p) + (1 << quantiles.BITS), np.ones(len(p), np.int64), k) for p in np.array_split(rng.permutation(x), 7)]
    nodes, counts = quantiles.fold(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), k)
    assert counts.sum() == len(x) and len(nodes) <= 3 * k + quantiles.BITS
    shares = [0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    cell = quantiles.cells(x)
    for p, c in zip(shares, quantiles.answer(nodes, counts, shares), strict=True):
        below, most = (cell < c).sum(), (cell <= c).sum()
        assert most >= p * len(x) - 1 and below <= p * len(x) + quantiles.BITS * len(x) / k + 1


def test_percentiles(spark):
    rng = random.Random(1)
    data = [("h" if rng.random() < 0.5 else rng.choice(["a", None]), k % 3, rng.choice([None, float("nan"), 0.0, rng.expovariate(0.1)]), 1) for k in range(6000)]
    df = spark.createDataFrame(data, "g string, day int, x double, value int").repartition(6)
    error = 0.01
    daily = quantiles.sketch(df, ["g", "day"], ["x"], error)
    for digest in (quantiles.merge(quantiles.sketch(df, ["g"], ["x"], error), ["g"], error, 200), quantiles.merge(daily, ["g"], error, 6)):
        answers = quantiles.percentiles(digest, ["g"], [0.5, 0.99], error)
        checked = quantiles.rank_check(df, answers, ["g"], ["x"])
        assert checked.count() == 6 and checked.filter("not within").count() == 0
    assert quantiles.merge(quantiles.sketch(df.filter("day > 9"), ["g"], ["x"]), ["g"]).count() == 0
    with pytest.raises(ValueError):
        quantiles.sketch(df.withColumn("node", F.lit(1)), ["node"], ["x"])


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_periods(spark, monkeypatch, held):
    """Answers of all days, merged from the days' digests, and of each day lie between exact order statistics; so they do when a task gives its digests out early."""
    monkeypatch.setattr(quantiles, "HELD", held)
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, float("nan"), 1.0, rng.lognormvariate(0, 2)])) for _ in range(8000)]
    df = spark.createDataFrame(data, "g string, day int, x double").repartition(3)
    error, shares = 0.01, [0.0, 0.5, 0.99, 1.0]
    got = quantiles.by_period(df, ["g"], "day", ["x"], shares, error, 8).collect()
    own = defaultdict(list)
    for g, day, x in data:
        if x is not None and x == x:
            own["period", g, day].append(x)
            own["all", g, None].append(x)
    assert len(got) == len(own) * len(shares) and {(r.level, r.g, r.day) for r in got} == set(own)
    for r in got:
        x = sorted(own[r.level, r.g, r.day])
        first = max(1, int(np.ceil(r.p * len(x) - 1e-9)))
        assert r.n == len(x) and r.max_rank_error == int(error * len(x))
        assert x[first - 1] <= r.value and r.low <= x[min(len(x), first + r.max_rank_error + 2) - 1]
    assert quantiles.by_period(df.filter("day > 99"), ["g"], "day", ["x"], shares).count() == 0


def test_registered_percentiles_lie_between_exact_ones(spark, data):
    from framesieve.llm.queries import p2_exact, p2_percentiles

    exact = {(r.sampling_method, r.metric, r.p): r for r in p2_exact(spark, data).collect()}
    totals = [r for r in p2_percentiles(spark, data).collect() if r.level == "all"]
    assert len(totals) == len(exact) > 8
    for r in totals:
        e = exact[r.sampling_method, r.metric, r.p]
        assert r.n == e.n and e.least <= r.value and r.low <= e.most


# 3


def walk(table, damping=0.85, rounds=300):
    """The chain as a dense matrix; table has a list of scores (None for missing) a row, more is better."""
    n = len(table)
    m = np.zeros((n, n))
    for i, row in enumerate(table):
        own = [k for k, v in enumerate(row) if v is not None]
        for k in own:
            better = [j for j in range(n) if table[j][k] is not None and table[j][k] > row[k]]
            for j in better or range(n):
                m[i, j] += 1 / len(own) / len(better or range(n))
        if not own:
            m[i] = 1 / n
    p = np.full(n, 1 / n)
    for _ in range(rounds):
        p = (1 - damping) / n + damping * p @ m
    return p * n


@pytest.mark.parametrize("fine", [1 << 16, 12])
def test_rank_walk(spark, fine):
    """Cells of single values give the dense chain; coarser ones stay near it."""
    rng = random.Random(3)
    data = [(k, rng.choice([None, 0.0, -0.0, round(rng.random(), 1)]), rng.choice([float("nan"), float("inf"), rng.random() * 1000]), 1.0) for k in range(40)]
    df = spark.createDataFrame(data + [(100, None, None, 1.0), (101, 0.5, 7.0, 1.0), (102, 0.5, 7.0, 1.0)], "item bigint, good double, cost double, score double")
    table = [[r.good, None if r.cost is None or r.cost != r.cost else -r.cost] for r in df.collect()]
    want = dict(zip([r.item for r in df.collect()], walk(table), strict=True))
    got = ranking.rank_walk(df, "item", {"good": True, "cost": False}, fine=fine).collect()
    for r in got:
        assert abs(r.score - want[r.item]) < (2e-9 if fine > 100 else 0.05)
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(1, len(got) + 1))
    assert all((-a.score, a.item) < (-b.score, b.item) for a, b in zip(order, order[1:]))
    scores = {r.item: r.score for r in got}
    assert scores[101] == scores[102]


def test_cells(spark):
    """Values with many better ones share cells, values of many rows don't, and there are few cells for many values."""
    rng = random.Random(4)
    data = [(float(k // 2),) for k in range(6000)] + [(1234.0,)] * 3000 + [(None,)] * 50 + [(float("inf"),), (float("-inf"),)]
    rng.shuffle(data)
    values = [x for (x,) in data if x is not None]
    own = sorted(ranking.cells(spark.createDataFrame(data, "s0 double").repartition(5), 1, 64).collect(), key=lambda r: r.lowest)
    assert len(own) < 2 * 64 * (1 + np.log(9000 / 64) + 1) and sum(r.n for r in own) == len(values)
    assert all(a.highest < b.lowest for a, b in zip(own, own[1:])) and [r.n for r in own if r.lowest == 1234.0] == [3002]
    for r in own[:: 20]:
        inside = [x for x in values if r.lowest <= x <= r.highest]
        better = [sum(y > x for y in values) for x in inside]
        assert len(inside) == r.n and abs(r.each - np.mean([1 / b if b else 0 for b in better])) < 1e-12
        assert inside.count(r.highest) == r.n_highest and (r.lowest == r.highest or max(better) <= min(better) * (1 + 2 / 64))


def test_hot_ties_and_nulls(spark):
    """A third of all rows share a value, another third has no score at all."""
    data = [(k, 0.0 if k % 3 == 0 else None, float(k % 7) if k % 3 == 0 else None) for k in range(60)] + [(k, float(k), None) for k in range(60, 75)]
    want = walk([[a, b] for _, a, b in data])
    got = {r.item: r.score for r in ranking.rank_walk(spark.createDataFrame(data, "item bigint, a double, b double").repartition(4), "item", {"a": True, "b": True}).collect()}
    assert max(abs(got[k] - w) for (k, _, _), w in zip(data, want, strict=True)) < 2e-9


def test_rank_walk_scale_and_empty(spark):
    df = spark.createDataFrame([(k, float(k), float((k * 7) % 11)) for k in range(11)], "item bigint, a double, b double")
    first = rows(ranking.rank_walk(df, "item", {"a": True, "b": True}), "item", "position")
    scaled = df.withColumn("a", F.exp("a") * 1e6)
    assert rows(ranking.rank_walk(scaled, "item", {"a": True, "b": True}), "item", "position") == first
    assert ranking.rank_walk(df.filter("a < 0"), "item", {"a": True}).count() == 0


# 4

PAYLOADS = [
    '{"video_id": "video1", "caption": "A cat, sits."}', '{"caption":"a  CAT sits","video_id":"Video-1"}', '\t{"video_id":"video1","caption":"acat sits","video":3}',
    '{"video_id": "video1", "caption": "a cat sit"}', '{"video_id": null, "caption": "x"}', '{"caption": "X!"}', '{"video_id": 7, "caption": "x"}', '{"video_id": "7", "caption": "x"}',
    '{"video_id": "v", "caption": null}', '{"video_id": "v", "caption": "..."}', '{"video_id": "v", "caption": 5}', '{"video_id": "v"', "", None, "[1]", '"x"', json.dumps({"video_id": "v", "caption": LONG}), json.dumps({"caption": LONG.upper(), "video_id": "v"}),
]


@pytest.mark.parametrize("bucket_rows", [1, 3, 100_000])
def test_same_records(spark, bucket_rows):
    values = PAYLOADS + [json.dumps({"video_id": f"video{k % 5}", "caption": f"{'same start of all captions ' * 2}{k % 30}"}) for k in range(200)]
    df = spark.createDataFrame([(1000 - k, p, "z") for k, p in enumerate(values)], "rec bigint, body string, canon string").repartition(7)
    groups, copies = records.same_records(df, "rec", "body", bucket_rows)
    want = defaultdict(list)
    for k, p in enumerate(values):
        if (c := records.canonical(p)) is not None:
            want[c].append(1000 - k)
    assert rows(groups, "keep_id", "copies") == sorted(((min(x), len(x)) for x in want.values()), key=repr)
    assert rows(copies, "keep_id", "copy_id") == sorted(((min(x), y) for x in want.values() for y in x if y != min(x)), key=repr)


def test_same_records_empty_and_trie(spark):
    df = spark.createDataFrame([], "rec bigint, body string")
    groups, copies = records.same_records(df, "rec", "body")
    assert groups.count() == 0 and copies.count() == 0
    trie, want = records.BurstTrie(4), {}
    for k in range(500):
        key = format(k % 90, "b").encode() * (k % 3)
        trie.add(key, 1, k)
        n, first = want.get(key, (0, k))
        want[key] = (n + 1, min(first, k))
    assert {k: (n, f) for k, n, f in trie.items()} == want


# 5


def brute_repeats(w, width=4):
    seen, hit, longest = set(), [0] * len(w), 0
    for i in range(len(w) - width + 1):
        g = tuple(w[i : i + width])
        if g in seen:
            hit[i : i + width] = [1] * width
        seen.add(g)
    for n in range(len(w) - 1, 0, -1):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        if len(set(grams)) < len(grams):
            longest = n
            break
    return len(w), sum(hit), longest


def test_repetition(spark):
    rng = random.Random(5)
    values = TEXTS[:-1] + [" ".join(rng.choices("abc" if k % 2 else "abcdefgh", k=rng.randint(0, 30))) for k in range(300)]
    got = {r.doc: r for r in repetition.repetition(texts(spark, values), "doc", "body").collect()}
    for k, t in enumerate(values):
        r = got[k]
        assert (r.n_words, r.repeated_words, r.longest_repeat) == brute_repeats(py_words(t)), t
        assert r.repeated_share == (r.repeated_words / r.n_words if r.n_words else 0.0)
    assert len(got) == len(values) and repetition.repetition(empty(spark), "doc", "body").count() == 0
    [long] = repetition.repetition(texts(spark, [LONG]), "doc", "body").collect()
    assert (long.repeated_words, long.longest_repeat) == (199_999, 199_999)


def test_looping_bounds(spark):
    report = spark.createDataFrame([(1, 20, 6, 9), (2, 20, 5, 9), (3, 11, 11, 10), (4, 12, 4, 4), (5, 20, 20, 3)], "doc bigint, n_words bigint, repeated_words bigint, longest_repeat bigint")
    assert rows(repetition.looping(report), "doc") == [(1,), (4,)] and rows(repetition.looping(report, longest=9), "doc") == [(1,)]


@pytest.mark.parametrize("most", [1, 7, 100])
def test_groups_of_words(spark, monkeypatch, most):
    monkeypatch.setattr(repetition, "TOGETHER", most)
    documents = [["a"] * n for n in (0, 3, 9, 0, 2, 2, 2, 50, 1)]
    own = list(repetition.groups(documents, most))
    assert [d for g in own for d in g] == documents and all(len(g) == 1 or sum(map(len, g)) <= most for g in own)
    test_repetition(spark)


# 6


def test_log_entropy(spark, monkeypatch):
    rng = random.Random(6)
    data = [(rng.choice(["a", "a", "a", "b", "c", None]), k if k % 9 else None, " ".join(rng.choices("x y z q1 q2 q3".split(), k=rng.randint(0, 6))) if k % 5 else None) for k in range(3000)]
    data += data[:500]
    df = spark.createDataFrame(data, "v string, i bigint, body string").withColumns({"record": F.lit(1), "words": F.lit("w")})
    once = {(v, i): t for v, i, t in data if v is not None and i is not None and t is not None}
    tf, held = Counter(), Counter()
    for (v, _), t in once.items():
        tf.update((v, w) for w in py_words(t))
        held.update({(v, w) for w in py_words(t)})
    frequencies = distinctive.term_frequencies(df, "v", "i", "body")
    assert rows(frequencies, "record", "term", "tf", "texts") == sorted((*k, tf[k], held[k]) for k in tf)
    scored = distinctive.log_entropy(frequencies, 3)
    for r in scored.collect():
        shares = np.array([tf[v, r.term] for v in "abc" if tf[v, r.term]]) / sum(tf[v, r.term] for v in "abc")
        weight = max(0.0, 1 + (shares * np.log(shares)).sum() / np.log(3))
        assert abs(r.weight - weight) < 1e-9 and abs(r.score - np.log1p(r.tf) * weight) < 1e-9
    assert distinctive.log_entropy(distinctive.term_frequencies(df.filter("v = 'none'"), "v", "i", "body"), 0).count() == 0
    assert all(r.weight == 1 for r in distinctive.log_entropy(frequencies, 1).collect())
    monkeypatch.setattr(distinctive, "HOT_TEXTS", 10)  # records and terms with more are spread
    monkeypatch.setattr(distinctive, "HOT_SHARE", 0.0)
    spread = distinctive.term_frequencies(df, "v", "i", "body")
    assert rows(spread, "record", "term", "tf", "texts") == rows(frequencies, "record", "term", "tf", "texts")
    monkeypatch.setattr(distinctive, "HOT_TEXTS", 2)
    rounded = [F.round(c, 9).alias(c) if c in ("weight", "score") else c for c in scored.columns]
    assert rows(distinctive.log_entropy(spread, 3).select(*rounded), *scored.columns) == rows(scored.select(*rounded), *scored.columns)


def test_marking_terms_come_through_weights(spark):
    """Every term of few records has the weight that is asked for; a term of more records can have it, and is then left out by its count."""
    n = 100
    data = [(v, f"even{m}", 5, 5) for m in range(1, 12) for v in range(m)] + [(v, "uneven", 500 if v == 0 else 1, 5) for v in range(8)] + [(v, "rare", 5, 3) for v in range(2)]
    frequencies = spark.createDataFrame(data, "record bigint, term string, tf bigint, texts bigint")
    scored = distinctive.log_entropy(frequencies, n)
    floor = distinctive.least_weight(n, 6)
    assert {r.term for r in scored.filter(F.col("weight") >= floor - 1e-9).collect()} == {*(f"even{m}" for m in range(1, 7)), "uneven", "rare"}
    found = distinctive.marking_terms(scored, n)
    assert {r.term for r in found.collect()} == {f"even{m}" for m in range(2, 7)}
    assert "ln" in found._jdf.queryExecution().optimizedPlan().toString().lower() or "weight" in found._jdf.queryExecution().optimizedPlan().toString()


# 7


def test_endings():
    complete = ["A cat sits.", "“A cat sits.”", "Sits! 🙂", "Is it?", "A cat (see 0:26).", "猫がいる。"]
    cut = ["A cat sits and the…", "A cat sits an [cut]", "A cat sits [...]", "A cat sits. The do", "A cat, and", "A cat sits,", "A cat (see", "A cat sits and..."]
    assert [truncation.ending(t) for t in complete] == ["complete"] * len(complete)
    assert [truncation.ending(t) in ("cut", "loose") for t in cut] == [True] * len(cut)
    assert [truncation.ending(t) for t in (None, "", " \n", "🙂", "a cat sits")] == ["blank"] * 4 + ["open"]


def test_truncation(spark):
    rng = random.Random(7)
    nouns, verbs = "cat dog bird horse mouse".split(), "holding washing painting throwing".split()
    values = []
    for k in range(1500):
        t = f"a {rng.choice(nouns)} is {rng.choice(verbs)} a {rng.choice('red green blue'.split())} {rng.choice(nouns)}"
        values.append((f"s{k % 2}", t, False))
    for k in range(1500):
        t = " ".join(f"The {rng.choice(nouns)} was seen {rng.choice(verbs)} {'very ' * rng.randint(0, 6)}slowly today." for _ in range(rng.randint(1, 3)))
        values.append(("s3", t[:60], len(t) > 60 and not t[:60].rstrip().endswith(".")))
    cuts = ["a cat is holding a", "a dog is washing a red", "a cat is thro", "a bird is", "a mouse is holding a green ho", None, "", "  "]
    values += [("s4", t, bool(t and t.strip())) for t in cuts] + [(None, "A cat sits.", False), ("s4", LONG + ".", False)]
    df = spark.createDataFrame([(k, s, t, 1) for k, (s, t, _) in enumerate(values)], "doc bigint, source string, body string, cut int").repartition(4)
    report, limits = truncation.truncation(df, "doc", "body", "source")
    assert ("s3", "chars", 60) in rows(limits, "source", "unit", "length")
    got = {r.doc: r for r in report.collect()}
    wrong = [(values[k], got[k].state, got[k].end_rate) for k in range(len(values)) if got[k].cut != values[k][2]]
    assert len(got) == len(values) and len(wrong) <= 5, wrong[:20]
    rates = {r.source: r for r in truncation.cut_rates(report).collect()}
    assert rates["s0"].n_cut == 0 and rates["s3"].cut_rate > 0.3 and rates[None].n_texts == 1
    report, limits = truncation.truncation(df.filter("doc < 0"), "doc", "body", "source")
    assert report.count() == 0 and limits.count() == 0


@pytest.mark.parametrize("copies", [1, 2, 50])
def test_copies_do_not_vouch_for_a_cut(spark, copies):
    rng = random.Random(70)
    crowd = "crowd river tower garden child".split()
    values = [f"a {rng.choice('drummer singer dancer'.split())} {k} sings to the {rng.choice(crowd)}" for k in range(150)]
    values += ["a drummer sings to" + " " * (k % 3) for k in range(copies)] + ["a singer 3 sings to the crowd"] * 50
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(values)], "doc bigint, source string, body string").repartition(4)
    report = {r.doc: r.cut for r in truncation.truncation(df, "doc", "body", "source")[0].collect()}
    assert report == {k: t.rstrip() == "a drummer sings to" for k, t in enumerate(values)}


def test_limits_decide(spark):
    """The same endings, which the words alone leave open, are cut at a length where their source stops far too often, and nowhere else."""
    rng = random.Random(72)
    nouns = [a + b for a in "bal der fim gon hul jap".split() for b in "ton rik sel mar".split()]
    more = ["near the {}", "by {}", "with a small {}", "on top of the {}"]
    values = []
    for k in range(4000):  # behind each noun a clause ends with a chance of one in five
        t = " ".join(["a", *rng.choices("old small red".split(), k=rng.randint(0, 7)), rng.choice(nouns)])
        while rng.random() < 0.8:
            t += " " + rng.choice(more).format(rng.choice(nouns))
        values.append(("free", t, False) if k % 2 else ("limited", " ".join(t.split()[:14]), None))
    df = spark.createDataFrame([(k, s, t) for k, (s, t, _) in enumerate(values)], "doc bigint, source string, body string").repartition(4)
    report, limits = truncation.truncation(df, "doc", "body", "source")
    assert rows(limits.filter("unit = 'words'"), "source", "length") == [("limited", 14)], rows(limits, *limits.columns)
    got = {r.doc: r for r in report.collect()}
    by = Counter((r.reason, r.at_limit) for r in got.values())
    assert by["limit", True] > 400 and not by["limit", False] and all((r.reason is not None) == r.cut for r in got.values())
    # With the hazards switched off, rows that only a limit's laxer bound decides are no longer cut.
    strict, _ = truncation.truncation(df, "doc", "body", "source", low_at_limit=0.0)
    lost = {r.doc for r in strict.collect() if not r.cut} & {k for k, r in got.items() if r.cut}
    assert len(lost) > 100 and all(got[k].reason == "limit" and got[k].end_rate >= 0.1 for k in lost)
    assert sum(r.cut for k, r in got.items() if values[k][0] == "free") < 0.05 * 2000  # a chance of one in five is near the bound of 0.1
    rates = {r.source: r for r in truncation.cut_rates(report).collect()}
    assert rates["limited"].n_by_limit > 1000 and sum(r.n_by_limit for r in rates.values()) == by["limit", True]


def test_sources_that_leave_out_full_stops(spark):
    """Of two kinds of sources, one closes its sentences, the other, with more than a third of the rows, none."""
    rng = random.Random(71)
    nouns, verbs = "cat dog bird horse mouse".split(), "holding washing painting throwing".split()

    def text():
        return f"A {rng.choice(nouns)} is {rng.choice(verbs)} a {rng.choice('red green blue'.split())} {rng.choice(nouns)}"

    for bare in (300, 1500):  # the collection as a whole closes more, and less, than the bound
        values = [("bare", text(), False) for _ in range(bare)] + [("closing", text() + ".", False) for _ in range(900)]
        values += [("closing", t, True) for t in ("A cat is holding a red ho", "A dog is washing a", "A bird is", "A mouse is painting a blue cat")]
        values += [("bare", t, True) for t in ("A dog is washing a", "A bird is", "A cat is thro")]
        df = spark.createDataFrame([(k, s, t) for k, (s, t, _) in enumerate(values)], "doc bigint, source string, body string").repartition(4)
        got = {r.doc: r.cut for r in truncation.truncation(df, "doc", "body", "source")[0].collect()}
        assert [values[k] for k in got if got[k] != values[k][2]] == []


# 8


def test_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    peer = tiktoken.Encoding("peer", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    values = TEXTS[:-1] + ["a" * 3000, "ab" * 700 + " " * 300 + "\n" * 400, "<|endoftext|> x", "x" * 256, "y" * 257, "word " * 5000]
    values += ["".join(chr(rng.choice([*range(32, 127), *range(0xA0, 0x250), 0x4E2D, 0x1F642, 0x301])) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    got = {r.doc: list(r.ids) for r in bpe.encode(texts(spark, values), "doc", "body", path, P.PATTERN).collect()}
    assert got == {k: peer.encode_ordinary(t) if t else [] for k, t in enumerate(values)}
    assert b"".join(peer.decode_single_token_bytes(x) for x in got[len(values) - 1]).decode() == values[-1]
    assert bpe.encode(empty(spark), "doc", "body", path, P.PATTERN).count() == 0


def test_pair_table():
    rng = random.Random(1)
    pairs = {(rng.randrange(50_000), rng.randrange(50_000)): k for k in range(5000)}
    table = bpe.PairTable(pairs)
    a, b = (np.array([p[x] for p in pairs]) for x in (0, 1))
    assert table.get(a, b).tolist() == list(pairs.values())
    assert (table.get(a + 50_000, b) == bpe.NONE).all()


# 9


def test_leaks(spark):
    item = "Between second 122 and second 837 the child stops folding, and walks slowly toward the angry museum again today"
    w = py_words(item)
    docs = [None, "", "x " * 50, f"Intro. {item.upper()}! End", "so: " + "\n".join(w[3:13]) + " end", "so " + " ".join(w[3:12]) + " end", " ".join(w[:10]) + " and " + " ".join(w[:10]), "İ" * 3 + " " + " ".join(w[2:12]), LONG + " ".join(w[:12])]
    df = texts(spark, docs)
    items = spark.createDataFrame([(2, item, 0), (1, f"“{item}”", 0), (3, "too short", 0), (4, None, 0), (1, item, 0)], "item bigint, body string, text int")
    found = leaks.leaked_passages(df, "doc", "body", items, "item", "body")
    assert rows(found, "doc", "item", "n_words") == [(3, 1, len(w)), (4, 1, 10), (6, 1, 10), (6, 1, 11), (7, 1, 10), (8, 1, 12)]
    for r in found.collect():
        assert docs[r.doc][r.start : r.end] == r.passage and len(py_words(r.passage)) == r.n_words
        assert " ".join(py_words(r.passage)) in " ".join(w)
    assert rows(leaks.item_classes(items, "item", "body"), "representative", "item") == [(1, 1), (1, 2), (3, 3)]
    sharded = leaks.leaked_passages(df, "doc", "body", items, "item", "body", shard_words=9)
    assert rows(sharded, "doc", "item", "start", "end") == rows(found, "doc", "item", "start", "end")
    assert leaks.leaked_passages(df, "doc", "body", items.filter("item > 9"), "item", "body").count() == 0
    assert leaks.leaked_passages(empty(spark), "doc", "body", items, "item", "body").count() == 0


@pytest.mark.parametrize("width", [1, 2, 7, 10])
def test_runs(width):
    """All longest shared runs, against comparison of every pair of places."""
    rng = random.Random(width)
    items = [(k, rng.choices("abc" if k % 2 else "abcdefghij", k=rng.randint(0, 40))) for k in range(8)]
    scanner = leaks.Scanner(items, width)
    for _ in range(60):
        doc = rng.choices("abcx", k=rng.randint(0, 30))
        _, own = rng.choice(items)
        at = rng.randint(0, len(doc))
        doc[at:at] = own[rng.randint(0, 5) : rng.randint(5, 40)]
        want = set()
        for item, w in items:
            for i in range(len(doc)):
                for j in range(len(w)):
                    n = 0
                    while i + n < len(doc) and j + n < len(w) and doc[i + n] == w[j + n]:
                        n += 1
                    if n >= width and not (i and j and doc[i - 1] == w[j - 1]):
                        want.add((item, i, i + n - 1))
        assert set(scanner.runs(doc)) == want


def test_size_of_automata():
    """A shard's automaton and vocabulary stay under 300 bytes a word of the items, so SHARD_WORDS words take at most 600 MB, mostly new words included."""
    import tracemalloc

    rng = random.Random(9)
    items = [(k, [f"w{rng.randrange(10**9)}" for _ in range(200)]) for k in range(500)]
    tracemalloc.start()
    scanner = leaks.Scanner(items, 10)
    python = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert scanner.automaton.get_stats()["total_size"] + python < 300 * 100_000


def test_several_shards(spark):
    rng = random.Random(10)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for k in range(300)]
    docs = [f"intro {' '.join(t.split()[5:25])} end" if k % 2 else "nothing to see here" for k, t in items]
    df = texts(spark, docs).repartition(3)
    table = spark.createDataFrame(items, "item bigint, body string")
    found = leaks.leaked_passages(df, "doc", "body", table, "item", "body", shard_words=4000)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") > 4
    assert rows(found, "doc", "item", "n_words") == [(k, k, 20) for k in range(1, 300, 2)] or {(r.doc, r.item) for r in found.collect()} == {(k, k) for k in range(1, 300, 2)}


# 10


def test_stuffing(spark):
    rng = random.Random(10)
    nouns, verbs, places = "cat dog bird horse mouse lamp tower river".split(), "holds washes paints throws".split(), "kitchen garden market station".split()

    def sentence():
        return f"The {rng.choice(nouns)} near the {rng.choice(places)} {rng.choice(verbs)} a small {rng.choice(nouns)} {rng.choice(['twice', 'slowly', 'at noon', 'again'])}."

    prose = [" ".join(sentence() for _ in range(rng.randint(2, 12))) for _ in range(200)]
    keywords = [s.join(rng.choice(["buy cat", "cat food", "cheap cat", "cat online", "best cat food"]) for _ in range(60)) for s in (", ", "\n", " | ", ". ", " ")]
    links = ["\n".join(f"[{rng.choice(nouns)}](https://shop{rng.randint(1, 99)}.example/p/{rng.randint(1, 9999)})" for _ in range(20)), " ".join(f"https://a{k}.test/x-{k}" for k in range(30)), " ".join(f"#{rng.choice(nouns)}_{rng.choice(places)}" for _ in range(40))]
    products = ["\n".join(f"{rng.choice(nouns)} {rng.choice(places)} ${rng.randint(1, 99)}.50 in stock" for _ in range(25))]
    mixed = [prose[0] + "\n\n" + "\n".join(f"[more](https://shop.example/{k})" for k in range(2)), "\n".join(f"{k}, {k * 3}, {k * k}" for k in range(60)), "deadbeef" * 40, prose[1] + " #cat #dog"]
    values = prose + keywords + links + products + mixed + [None, "", " ", LONG + "."]
    df = spark.createDataFrame([(k, t, rng.choice(["en", "en", None, "xx"]), 5) for k, t in enumerate(values)], "doc bigint, body string, lang string, blocks int").repartition(3)
    report = stuffing.block_report(df, "doc", "body", "lang")
    found = [r[0] for r in rows(stuffing.stuffed_pages(report), "doc")]
    assert found == list(range(len(prose), len(prose) + len(keywords + links + products)))
    assert report.count() == len(values) - 1
    assert stuffing.block_report(df.filter("doc < 0"), "doc", "body", "lang").count() == 0


def test_segments():
    cases = {"One. Two! Three": ["One. ", "Two! ", "Three"], "a.b c": ["a.b c"], "Is it?”  Yes.\n\n x": ["Is it?”  ", "Yes.\n\n ", "x"], "猫。犬！x": ["猫。", "犬！", "x"], "\r\n\n a\nb\n": ["\r\n\n ", "a\n", "b\n"], "": [], "...": ["..."]}
    assert {t: stuffing.segments(t) for t in cases} == cases
    rng = random.Random(12)
    for _ in range(500):
        t = "".join(rng.choices("ab .!?。\"')\n\r\t", k=rng.randint(0, 40)))
        assert "".join(stuffing.segments(t)) == t
    assert [stuffing.ends_well(t) for t in ("a.", "a.” ", "a", ". a", "")] == [True, True, False, False, False]
    links = {"see bad.example.com/x-1 now": "see L now", "a/b and 1.5/2": "a/b and 1.5/2", "[x](y) [z](": "L [z](", "<a href=q>w</a>!": "L!", "(https://e.x/y)": "(L", "a..b.com/": "a..b.com/"}
    assert {t: stuffing.without_links(t, "L") for t in links} == links


@pytest.mark.parametrize("unit", [".", "a-", "a.", "[", "[a](", "<a x>", "www.", "#a ", "$1,", "。a", '."', " ", "\n", "aB3/", "a, "])
def test_long_lines_take_linear_time(unit):
    import time

    for tail in ("x", "/", ""):
        text = "/ " + unit * (1_000_000 // len(unit)) + tail
        began = time.process_time()
        stuffing.blocks(text)
        assert time.process_time() - began < 6, (unit, tail)  # about one second; a quadratic pattern takes hours


def test_many_languages(spark):
    """Each language is measured by itself, however many there are."""
    prose = "The cat near the river holds a small lamp at noon. "
    df = spark.createDataFrame([(k, prose * (1 + k % 3), f"l{k // 3}") for k in range(6000)], "doc bigint, body string, lang string").repartition(4)
    assert stuffing.stuffed_pages(stuffing.block_report(df, "doc", "body", "lang", min_blocks=1)).count() == 0


def test_stuffing_with_full_stops(spark):
    rng = random.Random(11)
    nouns, places = "cat dog bird horse mouse lamp tower river".split(), "kitchen garden market station".split()
    prose = [" ".join(f"The {rng.choice(nouns)} near the {rng.choice(places)} holds a small {rng.choice(nouns)} {rng.choice(['twice', 'slowly', 'at noon'])}." for _ in range(rng.randint(2, 12))) for _ in range(200)]
    prose += ["The tiny red balloon costs $35.80 with free shipping. " + prose[0], "They bought eggs, milk, bread, salt, rice and a small lamp. " * 30, "We walked through the old market at noon #travel.", "Someone in the kitchen holds the lamp. " * 40]
    phrases = ["buy cat", "cat food", "cheap cat", "cat online", "best cat food"]
    stuffed = [s.join(rng.choice(phrases) for _ in range(1500)) + "." for s in (", ", " | ", " ")]
    stuffed += ["\n".join("#" + " #".join(rng.sample(nouns, 5)) + "." for _ in range(30)), "\n".join(f"{rng.choice(['red', 'blue'])} tiny {rng.choice(nouns)} ${rng.randint(1, 99)}.80 free shipping." for _ in range(30))]
    stuffed += [" ".join(f"Buy cheap {rng.choice(nouns)} food online." for _ in range(60)), "、".join(rng.choice(["猫粮", "便宜猫粮", "狗粮"]) for _ in range(200)) + "。", " ".join(f"https://a{k}.test/x-{k}" for k in range(30)) + " read all our best deals."]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(prose + stuffed)], "doc bigint, body string, lang string").repartition(3)
    found = [r[0] for r in rows(stuffing.stuffed_pages(stuffing.block_report(df, "doc", "body", "lang")), "doc")]
    assert found == list(range(len(prose), len(prose + stuffed)))


def test_registered_queries(spark, data):
    """Queries with SQL agree with it on the smallest test data; the others run."""
    import duckdb
    from framesieve.llm.queries import QUERIES
    from framesieve.llm.sql import SQL

    con = duckdb.connect()
    for t in ("sentences", "results", "baseline_results", "raw_records", "documents", "eval_items"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, query in QUERIES.items():
        df = query(spark, data)
        if name in SQL:
            columns = sorted(df.columns)
            assert rows(df, *columns) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall(), key=repr), name
        else:
            assert df.count() > 0 or name == "p7_limits", name  # too few texts for a limit
