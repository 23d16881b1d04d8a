"""Selection, aggregation, scoring, statistics, runs, inference, sources, sinks and streams of the core."""

import json
import math
import random
import re
import time
import zipfile
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import frame_rows, noise, ramp, white
from framesieve.config import Config
from framesieve.functions import image, text, vector
from framesieve.operators import combine, folds, infer, order, runs, score, select, stats
from framesieve.plans import benchmark
from framesieve.session import checkpoint_folder, released, stored
from framesieve.sources import datasets, frames, sinks
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# --- session


def test_shared_folder(spark):
    """A cluster without a shared folder is refused; a local master, and a named folder, are not."""

    def session(master, folder=None):
        unset = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, _jsc=unset))

    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            checkpoint_folder(session(master))
        assert checkpoint_folder(session(master, "hdfs:///x")) == "hdfs:///x"
    assert checkpoint_folder(session("local[4]")).startswith("file:///")


def test_stored_and_released(spark):
    table = stored(spark.range(10), "numbers")
    [folder] = {x.rsplit("/", 1)[0] for x in table.inputFiles()}
    assert table.count() == 10 and Path(folder.removeprefix("file:")).exists()
    released(table)
    assert not Path(folder.removeprefix("file:")).exists()
    released(spark.range(3))  # no table of ours


def test_order_statistics(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 1.0, 1.0, rng.gauss(0, 9)])) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    own = {}
    for g, v in data:
        if v is not None:
            own.setdefault(g, []).append(v)
    got = {r.g: r for r in order.order_statistics(df, ["g"], "v", lambda n: F.array(F.lit(1).cast("bigint"), n, F.ceil(n / 3))).collect()}
    assert set(got) == set(own)
    for g, v in own.items():
        v.sort()
        assert got[g].n == len(v) and got[g]["values"] == [v[0], v[-1], v[math.ceil(len(v) / 3) - 1]]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    for r in order.percentiles(df, ["g"], "v", shares).collect():
        assert np.allclose(r["values"], np.percentile(own[r.g], [100 * p for p in shares]))
    assert order.percentiles(df.filter("v > 1e9"), ["g"], "v", shares).count() == 0


# --- text and vectors


def test_text_functions(spark):
    df = spark.createDataFrame([(1, "A Cat's  dog, dog!"), (2, None), (3, " \t "), (4, "I cannot gonna")], "k int, t string")
    got = {r.k: r for r in df.select("k", text.token_set("t").alias("s"), text.token_list("t", True).alias("c"), text.or_placeholder("t", "none").alias("p"), text.ngrams(text.corpus_tokens("t"), 2).alias("g")).collect()}
    assert got[1].s == ["a", "cats", "dog"] and got[1].p == "A Cat's dog, dog!" and got[1].g == ["a cat's", "cat's dog,", "dog, dog!"]
    assert got[2].s is None and got[2].p == "none" and got[3].s == [] and got[3].g == [] and got[4].c == ["i", "can", "not", "gon", "na"]
    assert text.py_words("Ä b_c 12² ½x\n") == ["ä", "b", "c", "12", "x"]
    assert df.select(text.words("t").alias("w")).first().w == text.py_words("A Cat's  dog, dog!")
    [key] = df.limit(1).select(text.cache_key(F.lit("v1"), F.lit("fps1"), "org/m:2", "rev 1").alias("k")).collect()
    assert key.k == "v1_fps1_org_m_2_rev_1"
    with pytest.raises(ValueError, match="revision"):
        text.cache_key("k", "k", "m", "")


def test_prompts(spark):
    df = spark.createDataFrame([("vlm_only", "a cat", 1), ("vlm_plus_llm", " ", 1), ("vlm_only", "", 0)], "m string, c string, n int")
    prompts = [r.p for r in df.select(text.final_prompt("c", "n", F.lit("hello"), "m").alias("p")).collect()]
    assert prompts[0] == "a cat" and text.NO_SUMMARY in prompts[1] and "hello" in prompts[1] and prompts[2] == text.NO_CAPTIONS


def test_vectors(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 64))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    bits = df.select(vector.median_bits("a").alias("x"), vector.median_bits("b").alias("y"))
    r = bits.select(vector.hamming("x", "y").alias("h"), vector.hamming_packed(vector.packed("x"), vector.packed("y")).alias("p"), "x").first()
    want = [bool(v > np.median(a[1:])) for v in a]
    assert r.x == want and r.h == r.p == sum(x != (v > np.median(b[1:])) for x, v in zip(want, b, strict=True))
    g = df.select(vector.grid_stats("a").alias("g"), vector.cosine_distance(vector.normalised("a"), vector.normalised("b")).alias("d")).first()
    grid = a.reshape(8, 8)
    assert np.allclose((g.g.mean, g.g["var"], g.g.lap_var), (grid.mean(), grid.var(), image.laplacian(grid).var()))
    assert math.isclose(g.d, 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), rel_tol=1e-9)


# --- selection


@pytest.mark.parametrize(("fps", "every"), [(30.0, 30), (12.5, 12), (13.5, 14), (0.0, 30), (None, 30), (float("nan"), 30), (0.2, 1)])
def test_interval(spark, fps, every):
    videos = spark.createDataFrame([("v", fps, 90)], "video_id string, fps double, total_frames bigint")
    assert [r.frame_idx for r in select.interval_sample(select.frames_of(videos)).orderBy("frame_idx").collect()] == list(range(0, 90, every))


def test_random_uniform_budget(spark):
    videos = spark.createDataFrame([("a", 10.0, 95), ("b", 0.0, 61), ("c", 10.0, 0), ("d", 0.5, 3)], "video_id string, fps double, total_frames bigint")
    counts = {r.video_id: r["count"] for r in select.random_sample(videos).groupBy("video_id").count().collect()}
    assert counts == {"a": 10, "b": 3, "d": 3}
    assert sorted(r.frame_idx for r in select.mersenne_sample(videos).filter("video_id = 'a'").collect()) == sorted(random.Random(42).sample(range(95), 10))
    assert rows(select.read_until(select.interval_indices(videos))) == [("a", 91), ("b", 61), ("d", 3)]
    assert [r.frame_idx for r in select.uniform_indices(videos.filter("video_id = 'd'"), 5).orderBy("place").collect()] == [0, 0, 1, 1, 2]
    chosen = select.frames_of(videos).filter("video_id = 'a' and frame_idx < 14")
    assert {r.budget for r in select.budget_indices(chosen).collect()} == {12, 8}
    few = select.frames_of(videos).filter("video_id = 'd'")
    assert rows(select.budget_indices(few), "budget", "frame_idx") == [(3, 0), (3, 1), (3, 2)]


def test_mersenne_sample_of_dirty_fps(spark):
    fps = {"a": 10.0, "b": None, "c": float("nan"), "d": 0.0, "e": -5.0, "f": 0.5, "g": 25.0, "h": None}
    videos = spark.createDataFrame([(v, x, 0 if v == "h" else 95) for v, x in fps.items()], "video_id string, fps double, total_frames bigint").repartition(3)
    want = {v: [0, 30, 60, 90] for v in "bcde"} | {v: sorted(random.Random(42).sample(range(95), min(95, math.ceil(95 / fps[v])))) for v in "afg"}
    assert rows(select.mersenne_sample(videos), "video_id", "frame_idx") == sorted(((v, k) for v, own in want.items() for k in own), key=repr)


def test_changes(spark):
    rng = random.Random(1)
    values = [(v, k, rng.choice([None, rng.getrandbits(63) - 2**62, rng.getrandbits(4)])) for v in "abc" for k in range(200)]
    df = spark.createDataFrame(values, "video_id string, frame_idx bigint, hash bigint").repartition(5)
    want = []
    for v in "abc":
        last = None
        for _, k, h in (x for x in values if x[0] == v):
            if h is not None and (last is None or ((last ^ h) & (2**64 - 1)).bit_count() > 2):
                want.append((v, k))
                last = h
    assert rows(select.changes(df, 2), "video_id", "frame_idx") == sorted(want, key=repr)
    assert select.changes(df, 2, most=5).count() == 15
    assert select.changes(df.filter("hash is null"), 2).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_folds_of_long_keys(spark, seed):
    """A key in many parts is folded as in one, with and without a cap, for folds that agree soon, late or never."""
    rng = random.Random(seed)
    step = (1, 40, 3)[seed]
    x, data = 0, []
    for k in range(1500):
        x += rng.choice([-1, 0, 1]) * step if seed < 2 else 1
        data.append(("long", k, x))
    data += [("short", k, k) for k in range(5)] + [(None, k, 7) for k in range(3)]
    df = spark.createDataFrame(data, "g string, k int, x int").repartition(6)
    for most in (None, 11):
        want = []
        for g in ("long", "short", None):
            last, kept = None, 0
            for _, k, v in (r for r in data if r[0] == g):
                if (most is None or kept < most) and (last is None or abs(v - last) > 4):
                    last, kept = v, kept + 1
                    want.append((g, k))
        assert rows(folds.chained(df, ["g"], ["k"], "x", lambda a, b: abs(a - b) > 4, most), "g", "k") == sorted(want, key=repr)


def test_diverse_groups(spark):
    """Groups over several Arrow batches, null vectors, and a group that is too large for a task."""
    rng = np.random.default_rng(8)
    data = [(f"v{k % 3}", k, None if k % 50 == 0 else (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(rng.normal(size=(600, 4)))]
    df = spark.createDataFrame(data, "g string, k int, e array<double>").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = rows(select.diverse(df, "g", "k", "e", 12, adaptive=False), "g", "rank", "k")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for g in ("v0", "v1", "v2"):
        own = [(k, e) for x, k, e in data if x == g and e]
        taken, _ = select.farthest_first(np.array([e for _, e in own]), 12)
        want += [(g, n + 1, own[t][0]) for n, t in enumerate(taken)]
    assert got == sorted(want, key=repr)
    with pytest.raises(Exception, match="filter them for changes"):
        select.diverse(df, "g", "k", "e", 12, most_bytes=1000).collect()


def test_farthest_first():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    taken, stopped = select.farthest_first(v, 10)
    want = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(want) < 10:
        want.append(max((k for k in range(60) if k not in want), key=lambda k: (min(1 - v[k] @ v[w] for w in want), -k)))
    assert taken == want and not stopped
    assert select.farthest_first(np.repeat([[1.0, 0.0]], 5, axis=0), 5)[0] == [0]
    some, stopped = select.farthest_first(v, 60, 0.8, adaptive=True)
    assert stopped and 1 < len(some) < 60 and select.farthest_first(v[:0], 3) == ([], False)


@pytest.fixture(scope="module")
def measured(spark):
    clips = {"white": white(30), "mixed": np.concatenate([x for k in range(15) for x in (white(1), noise(1, k))]), "noise": noise(60, 100), "ramp": ramp(60), "blocks": np.concatenate([np.repeat(noise(1, k), 10, axis=0) for k in (1, 2, 3)])}
    out = image.measured_frames(frame_rows(spark, clips)).cache()
    videos = spark.createDataFrame([(c, 30.0) for c in [*clips, "missing"]], "video_id string, fps double")
    return out, videos


def _embed(pool):
    """A vector for each frame; the same one for frames of `blocks`."""
    return pool.withColumn("embedding", F.when(F.col("video_id") == "blocks", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.cos(F.col("frame_idx") / 20), F.sin(F.col("frame_idx") / 20))))


def test_two_stage_invariants(measured):
    table, videos = measured
    selected, meta = select.two_stage(table, videos, _embed, "adaptive", min_distance=0.05)
    facts = {r.video_id: r for r in meta.collect()}
    chosen = {v: [r.frame_idx for r in selected.filter(F.col("video_id") == v).orderBy("frame_idx").collect()] for v in facts}
    assert facts["white"].frames_degenerate_dropped == 10 and facts["white"].fallback_used and facts["white"].frames_original == 30
    assert facts["mixed"].frames_degenerate_dropped == 5 and not facts["mixed"].fallback_used
    assert facts["noise"].frames_degenerate_dropped == 0 and facts["noise"].candidate_pool_size > 5
    assert facts["ramp"].fallback_used and facts["blocks"].candidate_pool_size >= 2
    assert facts["missing"].frames_original == 0 and not facts["missing"].fallback_used and chosen["missing"] == []
    assert len(chosen["blocks"]) == 1
    for v, r in facts.items():
        assert r.vlm_calls == len(chosen[v]) == len(set(chosen[v])) <= r.candidate_pool_size
    fixed, _ = select.two_stage(table, videos, _embed, "FIXED ")
    assert fixed.filter("video_id = 'noise'").count() == 2
    _, only = select.perceptual(table, videos)
    assert {r.video_id: r.vlm_calls for r in only.collect()}["noise"] == facts["noise"].candidate_pool_size


@pytest.mark.parametrize(("bad", "field"), [({"threshold": 0}, "threshold"), ({"threshold": 1}, "threshold"), ({"min_distance": 1}, "min_distance"), ({"min_distance": -1}, "min_distance"), ({"mode": "x"}, "mode")])
def test_two_stage_errors(bad, field):
    with pytest.raises(ValueError, match=field):
        select.check_two_stage(**({"mode": "fixed", "threshold": 0.5, "min_distance": 0.1} | bad))


def test_kernels():
    picture = noise(1)[0]
    assert image.shrink(white(1)[0], 32, 32).tolist() == [[[255] * 3] * 32] * 32
    assert np.allclose(image.shrink(picture, 16, 9).astype(float), picture.reshape(9, 20, 16, 20, 3).mean(axis=(1, 3)), atol=0.51)
    assert image.perceptual_hash(image.grey(picture)) != image.perceptual_hash(image.grey(noise(1, 9)[0]))
    assert image.laplacian(np.full((5, 5), 7)).tolist() == [[0.0] * 5] * 5
    assert set(select.samplers(["phash", "nothing"])) == {"fps1", "fps2", "random", "phash"}


# --- captions


def brute_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("block", [1024, 4])
def test_aggregators(spark, monkeypatch, block):
    monkeypatch.setattr(combine, "BLOCK", block)
    rng = random.Random(block)
    data = [(k, n, None if rng.random() < 0.05 else " ".join(rng.choices("a b c d e f.".split(), k=rng.randint(0, 5))), "x") for k in ("p", "q", "s") for n in range(30 if k == "p" else 3)] + [("t", 0, "only one", "x")]
    df = spark.createDataFrame(data, "k string, n int, c string, tokens string").repartition(4)
    own = {}
    for k, n, c, _ in data:
        if c is not None:
            own.setdefault(k, []).append((n, c, set(c.replace(".", "").lower().split())))
    raw = {r.k: r for r in combine.concatenated(df, "k", "n", "c").collect()}
    medoid = {r.k: r for r in combine.medoid(df, "k", "n", "c").collect()}
    dedup = combine.without_repeats(df, "k", "n", "c", 0.5)
    for k, captions in own.items():
        assert raw[k].caption == " ".join(c for _, c, _ in captions) and raw[k].n_captions == len(captions)
        sums = [round(sum(brute_jaccard(a, b) for j, (_, _, b) in enumerate(captions) if j != i), 9) for i, (_, _, a) in enumerate(captions)]
        assert medoid[k].caption == captions[sums.index(max(sums))][1], k
        last, kept = None, []
        for n, _, t in captions:
            if last is None or brute_jaccard(last, t) <= 0.5:
                kept.append(n)
                last = t
        assert sorted(r.n for r in dedup.filter(F.col("k") == k).collect()) == kept
    assert combine.medoid(df.filter("n > 99"), "k", "n", "c").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_sums_of_similarities(monkeypatch, seed):
    """Counting by shared words gives the sums of all pairs, with frequent, rare and no words, and sets of many."""
    monkeypatch.setattr(combine, "CHUNK", 16)
    monkeypatch.setattr(combine, "HOT", (0, 2, 16, 3)[seed])
    monkeypatch.setattr(combine, "LONG", (48, 5, 48, 3)[seed])
    rng = np.random.default_rng(seed)
    sides = [[np.unique((rng.random(rng.integers(0, 9)) ** 3 * 40).astype(int)) for _ in range(m)] for m in (90, 70)]
    n = rng.integers(1, 4, 70).astype(float)
    want = [sum(w * brute_jaccard(set(x.tolist()), set(y.tolist())) for y, w in zip(sides[1], n, strict=True)) for x in sides[0]]
    packed = [v for side in sides for v in (np.concatenate(side), np.array([len(x) for x in side]))]
    np.testing.assert_allclose(combine._sums(*packed, n), want, atol=1e-9)
    np.testing.assert_allclose(combine._dense(*packed, n), want, atol=1e-9)


def test_sums_of_many_sets():
    """50,000 sets are compared with each other by shared words; by products that took minutes."""
    rng = np.random.default_rng(5)
    sets = np.sort(rng.random((50_000, 5)) ** 2 * 5000, axis=1).astype(int) + np.arange(5)
    began = time.process_time()
    got = combine._sums(sets.ravel(), np.full(50_000, 5), sets.ravel(), np.full(50_000, 5), np.ones(50_000))
    assert time.process_time() - began < 60
    some = sets[:20]
    np.testing.assert_allclose(got[:20], combine._dense(some.ravel(), np.full(20, 5), sets.ravel(), np.full(50_000, 5), np.ones(50_000)), atol=1e-6)


# --- scores


def test_lcs_and_meteor():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.choices("abcd", k=rng.randint(0, 9)), rng.choices("abcd", k=rng.randint(0, 9))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert score.lcs_length(a, score.places(b), len(b)) == t[-1][-1]
    for h, r, want in (("the cat sat", "the cat sat", (3, 1)), ("a b c", "c b a", (3, 3)), ("x", "y", (0, 0)), ("a b x b c", "b c a b", (4, 2))):
        assert score._matches(h.split(), score.places(r.split())) == want


def test_scores(spark):
    refs = spark.createDataFrame([("v", 1, "a cat sits on the mat"), ("v", 2, "the cat is here"), ("v", 3, " "), ("w", 1, "dogs run fast today"), ("u", 1, None)], "id string, ref_no int, caption string")
    hyps = spark.createDataFrame([("v", "a cat sits on the mat"), ("w", None), ("x", "no reference"), ("u", "none either")], "id string, caption string")
    idf = score.document_frequency(refs)
    got = {r.id: r for r in score.all_metrics(refs, hyps, idf).collect()}
    assert set(got) == {"v", "w"} and got["w"].cider == 0 and got["w"].rouge_l == 0
    assert math.isclose(got["v"].bleu1, 1, abs_tol=1e-6) and math.isclose(got["v"].bleu4, 1, abs_tol=1e-6) and math.isclose(got["v"].rouge_l, 1) and got["v"].meteor > 0.99
    assert 5 < got["v"].cider <= 10
    assert {(r.gram): r.df for r in idf.filter("n = 1").collect()}["the"] == 1
    [c] = score.reference_coverage(refs.filter("caption is not null")).collect()
    assert (c.n_videos, c.n_references, c.n_sparse) == (2, 4, 1)
    [d] = score.input_diagnostics(refs, hyps).collect()
    assert (d.blank_references, d.blank_hypotheses, d.too_few) == (2, 1, True)


@pytest.mark.parametrize("name", ["cider", "bleu", "all_metrics"])
def test_texts_and_grams_are_not_broadcast(spark, name):
    """Small files of texts become large tables of n-grams: no join of them goes through the driver."""
    refs = spark.createDataFrame([("v", k, f"a cat sits on mat {k}") for k in range(20)], "id string, ref_no int, caption string")
    hyps = spark.createDataFrame([(k, "v", f"the cat sits on mat {k}") for k in range(20)], "id int, of string, caption string")
    idf = [] if name == "bleu" else [score.document_frequency(refs)]
    plan = getattr(score, name)(refs, hyps, *idf)._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"(\w+Join|CartesianProduct)\b([^\n]*)", plan)
    grams = [kind for kind, keys in joins if "gram#" in keys]
    assert set(grams) == {"SortMergeJoin"}, joins
    # Beside them: the texts with the lengths of their references, and blocks with blocks.
    assert sum(kind == "SortMergeJoin" and keys.startswith(" [of#") and "gram#" not in keys for kind, keys in joins) == (2 if name == "all_metrics" else 1), joins


def test_references_without_hypothesis(spark):
    """References of ids that nothing is scored against are not prepared."""
    refs = spark.createDataFrame([(v, k, f"a cat {k}") for v in "vwx" for k in range(3)], "id string, ref_no int, caption string")
    texts = score.prepared(refs, spark.createDataFrame([(1, "v", "a cat")], "id int, of string, caption string"))
    assert rows(texts.refs, "of", "m") == [("v", 1)] * 3 and texts.hyps.count() == 1


def test_grams_in_batches(monkeypatch):
    """A batch of texts gives batches of n-grams of bounded size, and all n-grams."""
    texts = [[f"w{k % 3}", "of", f"w{k}", "of", f"w{k % 3}"][: k % 6] for k in range(200)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(200)), "tokens": texts})
    [whole] = score._count_grams([batch])
    monkeypatch.setattr(score, "BATCH", 50)
    parts = list(score._count_grams([batch]))
    assert len(parts) > 10 and max(p.num_rows for p in parts) < 50 + 20
    assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([whole]).combine_chunks())


# --- statistics


def test_t_quantile():
    for df, t in ((1, 12.706205), (2, 4.302653), (9, 2.262157), (30, 2.042272), (99, 1.984217), (2_000_000, 1.959966)):
        assert abs(stats.t_quantile(df) - t) < 2e-6


def test_grouped_statistics(spark):
    data = [("a", "raw", "m", 1.0, 5, 0.9), ("a", "raw", "m", 3.0, None, 0.99), ("a", "raw", "m", float("nan"), 7, 0.95), ("b", "raw", "m", 2.0, 5, None), (None, "raw", "m", 9.0, 1, 0.5)]
    df = spark.createDataFrame(data, "sampling_method string, aggregation_method string, caption_mode string, processing_time_s double, frames_selected int, bleu1 double")
    got = {r.sampling_method: r for r in stats.grouped_statistics(df).collect()}
    a, b = got["a"], got["b"]
    assert set(got) == {"a", "b"} and a["count"] == 3 and a.processing_time_s_mean == 2 and a.processing_time_s_median == 2 and math.isclose(a.processing_time_s_std, math.sqrt(2))
    assert a.processing_time_s_ci95_lower == 0 and math.isclose(a.processing_time_s_ci95_upper, 2 + 12.7062047 * math.sqrt(2) / math.sqrt(2), rel_tol=1e-6)
    assert a.bleu1_ci95_upper == 1 and b.processing_time_s_std == 0 and b.processing_time_s_ci95_lower == b.processing_time_s_ci95_upper == 2 and b.bleu1_mean is None
    assert "cider_mean" not in a.asDict()
    with pytest.raises(RuntimeError):
        stats.ranking_metric(stats.grouped_statistics(df).drop("bleu1_mean"))
    assert stats.ranking_metric(stats.grouped_statistics(df)) == "bleu1_mean"


def test_bootstrap_and_labels(spark, data):
    rng = random.Random(1)
    df = spark.createDataFrame([("a", "raw", "m", rng.gauss(5, 1), k) for k in range(400)], "sampling_method string, aggregation_method string, caption_mode string, cider double, row_id bigint")
    [r] = stats.bootstrap_means(df, "cider").collect()
    assert 4.7 < r.lower < 5 < r.upper < 5.3
    points = spark.createDataFrame([("a", "x", "m", 1.01, 0.5), ("b", "x", "m", 1.02, 0.51), ("c", "x", "m", 1.03, 0.9), ("d", "x", "m", 3.0, 0.5)], "sampling_method string, aggregation_method string, caption_mode string, processing_time_s double, cider double")
    assert rows(stats.label_offsets(points), "sampling_method", "offset") == [("a", 0), ("b", 1), ("c", 0), ("d", 0)]
    assert rows(stats.frontier(points), "sampling_method") == [("a",), ("b",), ("c",)]


# --- runs


def test_assembled(spark):
    keys = "video_id string, sampling_method string, aggregation_method string, caption_mode string"
    predictions = spark.createDataFrame([("v", "fps1", "raw", "m"), ("v", "phash", "raw", "m")], keys)
    telemetry = spark.createDataFrame([("v", "fps1", "raw", "m", 8, 1.0, 0.0, 0.0, 0.0), ("v", "phash", "raw", "m", 4, 1.0, 0.0, 0.0, 0.0)], keys + ", frames_selected bigint, processing_time_s double, peak_vram_mb double, peak_ram_delta_mb double, gpu_utilization_pct double")
    metrics = spark.createDataFrame([("v", "phash", "raw", "m", 0.8, 0.1, 0.1, 0.1, 0.1)], keys + ", cider double, bleu1 double, bleu4 double, rouge_l double, meteor double")
    meta = spark.createDataFrame([("v", "phash", 9, 1, False, 4)], "video_id string, sampling_method string, candidate_pool_size bigint, frames_degenerate_dropped bigint, tass_stopped_early boolean, vlm_calls bigint")
    got = {r.sampling_method: r for r in runs.assembled(predictions, telemetry, metrics, meta).collect()}
    assert got["fps1"].cider == 0 and got["fps1"].semantic_yield is None and got["phash"].vlm_calls_saved_pct == 50 and math.isclose(got["phash"].semantic_yield, 0.2)
    assert runs.assembled(predictions, telemetry, metrics, meta, compat=True).filter("sampling_method = 'phash'").first().vlm_calls_saved_pct == -300


def test_reductions_union_available(spark):
    records = spark.createDataFrame([("fps1", "v", 100, 10, None), ("old", "v", None, 50, None), ("old", "w", None, 5, None), ("x", "w", 0, 5, 12.5)], "sampler string, video_id string, original_frame_count bigint, selected_frame_count bigint, reduction_pct double")
    assert rows(runs.reductions(records)) == [("fps1", "v", 90.0), ("old", "v", 50.0), ("x", "w", 12.5)]
    a, b = spark.createDataFrame([("v", 1)], "video_id string, x int"), spark.createDataFrame([(None, 2)], "video_id string, y int")
    both = runs.union_runs([a, b])
    assert both.columns == ["video_id", "x", "y"] and both.count() == 2 and runs.distinct_videos(both).first().videos == 2
    listed = spark.createDataFrame([("m:7b",), ("m",), ("mm",)], "n string")
    assert rows(listed.filter(runs.available("n", "m"))) == [("m",), ("m:7b",)] and rows(listed.filter(runs.available("n", "m:7b"))) == [("m",), ("m:7b",)]


# --- inference


def test_in_batches():
    calls = []

    def model(batch):
        calls.append(len(batch))
        if len(batch) > 2:
            raise infer.OutOfMemory
        if "bad" in batch:
            raise ValueError("bad")
        return [x.upper() for x in batch]

    out, errors = infer.in_batches(model, ["a", "b", "c", "d", "bad", "e", "f"], 4, "-")
    assert out == ["A", "B", "C", "D", "-", "E", "F"] and [bool(e) for e in errors] == [False] * 4 + [True, False, False] and calls[0] == 4
    assert infer.in_batches(lambda b: (_ for _ in ()).throw(infer.OutOfMemory("full")), ["a"], 4, "-") == (["-"], ["full"])
    assert infer.by_budget(lambda f: "ok" if len(f) <= 12 else 1 / 0, list(range(20))) == ("ok", 12, True)
    assert infer.by_budget(lambda f: "ok", [1, 2]) == ("ok", 2, False)


def test_caption_stage(spark):
    frames_ = spark.createDataFrame([("v", k, f"pic{k}") for k in range(6)], "video_id string, frame_idx bigint, data string")
    cache = spark.createDataFrame([("v", 0, "kept")], "video_id string, frame_idx bigint, caption string")
    work = frames_.select("video_id", "frame_idx")

    def compute(todo):
        return infer.captioned(frames_.join(todo, ["video_id", "frame_idx"]), "data", lambda: lambda batch: [x + "!" for x in batch])

    every, new = infer.cached_captions(work, cache, ["video_id", "frame_idx"], compute)
    assert new.count() == 5 and rows(every, "frame_idx", "caption") == [(0, "kept"), *((k, f"pic{k}!") for k in range(1, 6))]
    clips = spark.createDataFrame([("v", "a"), ("w", "silent"), ("x", "broken")], "video_id string, video_path string")
    out, keep = infer.transcribed(clips, lambda: lambda p: {"a": ("hi", True, 2.0, 0.1), "silent": ("", False, 0.0, 1.0)}[p])
    assert rows(out, "video_id", "transcript", "audio_present", "audio_duration") == [("v", "hi", True, 2.0), ("w", "", False, 0.0), ("x", "", True, 0.0)] and keep.count() == 2
    unit = infer.embedded(frames_, lambda: lambda batch: np.ones((len(batch), 4)), prepare=str)
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 and r.error is None for r in unit.collect())

    def some_fail(batch):
        if "pic2" in batch:
            raise ValueError("bad")
        return [[0.0, 0.0] if x == "pic1" else [3.0, 4.0] for x in batch]

    mixed = {r.frame_idx: r for r in infer.embedded(frames_, lambda: some_fail).collect()}
    assert len(mixed) == 6 and mixed[1].embedding is None and mixed[1].error and "bad" in mixed[2].error and mixed[0].error is None and mixed[3].embedding


def _factory(word):
    return lambda: lambda batch: [word for _ in batch]


def test_models_are_told_apart(spark):
    """Loaders of one factory load different models; a name shares a model, another name does not."""
    one = spark.createDataFrame([("x",)], "t string").coalesce(1)
    for word in ("A", "B", "C", "A"):
        assert infer.captioned(one, "t", _factory(word)).first().caption == word
    named = [infer.captioned(one, "t", _factory(w), model=n).first().caption for w, n in (("A", "m@1"), ("B", "m@2"))]
    assert named == ["A", "B"]


def test_models_are_asked_once(spark, tmp_path):
    """What is cached is what was made, though the model never says the same twice."""
    work = spark.createDataFrame([("v", k) for k in range(8)], "video_id string, frame_idx bigint")
    cache = work.limit(0).withColumn("caption", F.lit(""))

    def compute(todo):
        return infer.captioned(todo.withColumn("x", F.col("frame_idx").cast("string")), "x", lambda: lambda batch: [str(random.random()) for _ in batch])

    every, new = infer.cached_captions(work, cache, ["video_id", "frame_idx"], compute)
    assert rows(every) == rows(new) == rows(every) and new.count() == 8


def test_lost_models(spark):
    """After a model is lost no further call is made; what was made stays."""
    df = spark.createDataFrame([(k, str(k)) for k in range(12)], "k int, t string").coalesce(1)

    def load():
        calls = []

        def model(batch):
            calls.append(batch)
            if len(calls) > 2:
                raise infer.ModelLost("device")
            return [x + "!" for x in batch]

        return model

    got = {r.k: r for r in infer.captioned(df, "t", load, batch=3).collect()}
    assert [got[k].caption for k in range(6)] == [f"{k}!" for k in range(6)] and all(got[k].error.startswith(infer.LOST) for k in range(6, 12)) and all(r.seconds >= 0 for r in got.values())


def test_encoded_frames(spark):
    import base64
    import zlib

    clip = frame_rows(spark, {"v": noise(1, 0, 32, 24)}).unionByName(frame_rows(spark, {"w": noise(1, 1, 32, 24)}).withColumn("data", F.lit(None).cast("binary")))
    got = {r.video_id: r.image for r in infer.encoded_frames(clip, size=16).collect()}
    assert got["w"] is None
    raw = base64.b64decode(got["v"])
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[16:24] == bytes([0, 0, 0, 16] * 2)
    size = int.from_bytes(raw[33:37], "big")
    pixels = np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(16, 49)[:, 1:].reshape(16, 16, 3)[:, :, ::-1]
    assert (pixels == image.shrink(noise(1, 0, 32, 24)[0], 16, 16)).all()
    own = infer.encoded_frames(clip, lambda x: x.tobytes(), 4)
    assert base64.b64decode(own.filter("video_id = 'v'").first().image) == image.shrink(noise(1, 0, 32, 24)[0], 4, 4).tobytes()


def test_benchmark_run(spark, tmp_path):
    """Frames to report with stand-in models, and what is written."""
    clips = frame_rows(spark, {v: noise(8, k * 10, 32, 24) for k, v in enumerate(("v", "w"))})
    videos = spark.createDataFrame([("v", 4.0, 8), ("w", 4.0, 8), ("gone", 4.0, 8)], "video_id string, fps double, total_frames bigint")
    refs = spark.createDataFrame([("v", 1, "a cat sits"), ("w", 1, "a dog runs")], "video_id string, ref_no int, caption string")
    models = benchmark.Models(lambda: lambda batch: [f"a cat {len(x) % 7}" for x in batch], lambda: lambda batch: ["a cat sits" for _ in batch], embed=_embed)
    done = benchmark.run(videos, clips, refs, models, ["fps1", "random", "phash", "tass_fixed", "tass_adaptive", "unknown"], ["raw", "centroid", "temporal", "unknown"], ["vlm_only", "vlm_plus_llm"], info={"date": "today", "dataset": "test"}, out=str(tmp_path / "out"))
    table = {(r.video_id, r.sampling_method, r.aggregation_method, r.caption_mode): r for r in done.rows.collect()}
    assert len(table) == 2 * 5 * 3 * 2 and done.statistics.count() == 30
    r = table["v", "fps1", "raw", "vlm_plus_llm"]
    assert r.frames_selected == 2 and r.processing_time_s > 0 and r.cider > 0 and r.meteor > 0.9 and r.tass_candidate_pool is None and r.semantic_yield is None
    assert table["v", "random", "raw", "vlm_only"].tass_candidate_pool == 2 and table["v", "random", "raw", "vlm_only"].semantic_yield is not None
    assert {(x.video_id, x.reason) for x in done.skipped.collect()} == {("gone", "no frames")}
    chosen = {(x.sampler, x.video_id): x for x in done.selections.collect()}
    assert {s for s, _ in chosen} == {"fps1", "random", "phash", "tass_fixed", "tass_adaptive"}
    assert chosen["fps1", "v"].original_frame_count is None and chosen["fps1", "v"].frame_indices == [0, 4] and chosen["random", "v"].reduction_pct == 75
    text_ = (tmp_path / "out" / "reports" / "benchmark_summary.md").read_text()
    assert text_ == done.report and "## Highlights" in text_ and "- **Best (CIDER)**: " in text_ and "Generated on: today" in text_ and "**Dataset**: test" in text_
    back = datasets.runs_csv(spark, str(tmp_path / "out" / "csv" / "results"))
    assert back.count() == 60
    both, statistics, report = benchmark.combine_runs([back, back], out=str(tmp_path / "all"))
    assert both.count() == 120 and statistics.count() == 30 and benchmark.COMBINED in report and "**Videos**: 2" in report
    captions = spark.read.json(str(tmp_path / "out" / "captions"))
    assert captions.count() == 60 and rows(captions.filter("video_id = 'v'").select("ground_truth").distinct()) == [(["a cat sits"],)]


def stand_ins():
    return benchmark.Models(lambda: lambda batch: ["a cat sits" for _ in batch])


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from framesieve.__main__ import main

    (tmp_path / "frames").mkdir()
    for k, v in enumerate("ab"):
        np.save(tmp_path / "frames" / f"{v}.npy", noise(6, k, 16, 8))
    (tmp_path / "d.json").write_text(json.dumps({"videos": [{"video_id": v} for v in "abc"], "sentences": [{"video_id": v, "caption": f"a cat {v}", "sen_id": k} for k, v in enumerate("abc")]}))
    (tmp_path / "c.yaml").write_text("experiment: {videos: 3, fps: 2}\npipeline: {samplers: [fps1, random], aggregators: [raw], caption_modes: [vlm_only]}\nmodels: {vlm: {name: m, revision: r}}\n")
    given = ["--config", str(tmp_path / "c.yaml"), "--data", str(tmp_path / "d.json"), "--frames", str(tmp_path / "frames"), "--output-dir", str(tmp_path / "out")]
    assert main(["run", *given, "--models", "test_core:stand_ins"]) == 0
    assert "**VLM**: m" in capsys.readouterr().out and datasets.runs_csv(spark, str(tmp_path / "out" / "csv" / "results")).count() == 4
    assert main(["combine", "--runs", str(tmp_path / "out" / "csv" / "results"), "--output-dir", str(tmp_path / "all")]) == 0
    assert "**Videos**: 2" in capsys.readouterr().out
    assert datasets.acquired(spark.range(12)) and not datasets.acquired(spark.range(9))


def test_baseline_flow(spark, tmp_path):
    clips = frame_rows(spark, {v: noise(8, k * 10, 32, 24) for k, v in enumerate(("v", "w"))})
    videos = spark.createDataFrame([("v", 4.0, 8), ("w", 4.0, 8), ("gone", 4.0, 8), ("none", 4.0, 0)], "video_id string, fps double, total_frames bigint")
    refs = spark.createDataFrame([("v", 1, "a cat sits"), ("w", 1, "a dog runs")], "video_id string, ref_no int, caption string")

    def load():
        def model(images):
            if len(images) > 12:
                raise MemoryError
            return "a cat sits"

        return model

    got, skipped, statistics = benchmark.baseline(videos, clips, refs, load, out=str(tmp_path / "out"))
    table = {r.video_id: r for r in got.collect()}
    assert set(table) == {"v", "w"} and table["v"].frames_selected == 16 and table["v"].actual_frames_used == 12 and table["v"].oom_fallback_triggered
    assert table["v"].rouge_l == 1 and table["w"].cider < table["v"].cider and table["v"].benchmark_type == "single_model" and table["v"].processing_time_s >= 0
    assert rows(skipped) == [("gone", "no frames"), ("none", "no frames")] and statistics.count() == 1
    records = {r.video_id: r for r in spark.read.json(str(tmp_path / "out" / "captions")).collect()}
    assert records["v"].asDict() == {"video_id": "v", "method": "qwen_vl_3b", "generated": "a cat sits", "reference": ["a cat sits"]}


def test_perceptual_hash_by_definition():
    """The hash of a 32 x 32 image from cosines written out."""
    picture = np.random.default_rng(5).integers(0, 256, (32, 32)).astype(np.uint8)
    k = np.arange(32)
    low = [[sum(picture[y, x] * math.cos(math.pi * (2 * x + 1) * u / 64) * math.cos(math.pi * (2 * y + 1) * v / 64) for y in k for x in k) * (math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1) for u in range(8)] for v in range(8)]
    flat = np.array(low).ravel()
    bits = flat > np.median(flat[1:])
    assert image.perceptual_hash(picture) & (2**64 - 1) == int("".join("1" if b else "0" for b in bits), 2)


# --- sources and sinks


def test_datasets(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"videos": [{"video_id": " a "}, {"video_id": "b"}, {"video_id": "a"}, {"video_id": ""}], "sentences": [{"video_id": "a", "caption": " x ", "sen_id": 1}, {"video_id": "a", "caption": "", "sen_id": 2}, {"video_id": "c", "caption": "y", "sen_id": 3}]}))
    videos, refs = datasets.dataset_json(spark, str(tmp_path / "d.json"))
    assert rows(videos, "video_id") == [("a",)] and rows(refs) == [("a", 0, "x"), ("c", 2, "y")]
    assert datasets.detect_fields(["n", "Caption", "video", "id"]) == ("id", "Caption") and datasets.detect_fields(["captions", "video", "text", "vid_id"]) == ("vid_id", "text") and datasets.detect_fields(["video", "captions"]) == ("video", "captions")
    with pytest.raises(ValueError):
        datasets.detect_fields(["n"])
    one, many = spark.createDataFrame([("a", " x ")], "video_id string, caption string"), spark.createDataFrame([(1, ["y", " "])], "clip_id int, captions array<string>")
    assert rows(datasets.reference_captions([one, many])) == [("1", "y"), ("a", "x")]
    assert datasets.shuffled(spark.range(50).select(F.col("id").cast("string").alias("video_id")), 7).count() == 7
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("video/a.mp4", b"1")
        z.writestr("x.txt", b"2")
    assert rows(datasets.archive_members(spark, str(tmp_path / "z.zip"), ".mp4"), "name", "data") == [("a.mp4", bytearray(b"1"))]


def test_saved_runs(spark, tmp_path):
    one = spark.createDataFrame([("v", "fps1", 0.5), ("w", "fps1", None)], "video_id string, sampling_method string, cider double")
    sinks.write_results(one, str(tmp_path / "results_1"), "csv")
    sinks.write_results(one, str(tmp_path / "combined" / "x"), "csv")
    back = datasets.runs_csv(spark, str(tmp_path / "results_*"))
    assert rows(back, "video_id", "cider", "meteor") == [("v", 0.5, None), ("w", None, None)]
    made = []
    build = lambda: made.append(1) or one
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), build).count() == 2
    assert made == [1]
    records = runs.selection_records(spark.createDataFrame([("v", 3), ("v", 0)], "video_id string, frame_idx bigint"), spark.createDataFrame([("v", 9, False), ("w", 0, True)], "video_id string, frames_original bigint, fallback_used boolean"), "fps1")
    assert rows(records, "video_id", "frame_indices", "reduction_pct") == [("v", [0, 3], 77.78), ("w", [], None)]
    sinks.write_selections(records, str(tmp_path / "sel"))
    folder = tmp_path / "fs"
    folder.mkdir()
    (folder / "v_fps1.json").write_text(json.dumps({"sampler": "fps1", "video_id": "v", "original_frame_count": 9, "selected_frame_count": 2, "frame_indices": [0, 3], "reduction_pct": None}))
    (folder / "bad.json").write_text("{")
    good, bad = datasets.frame_selections(spark, str(folder))
    assert good.count() == 1 and bad.count() == 1 and rows(runs.reductions(good, "file")) == [("fps1", "v", 77.78)]


def test_raw_frames(spark, tmp_path):
    np.save(tmp_path / "clip.npy", noise(20, 0, 16, 8))
    (tmp_path / "broken.npy").write_bytes(b"no array")
    table = frames.raw_frames(spark, str(tmp_path))
    assert table.count() == 20 and bytes(table.filter("frame_idx = 3").first().data) == noise(20, 0, 16, 8)[3].tobytes()
    assert image.measured_frames(table.withColumn("data", F.lit(None).cast("binary"))).filter("hash is null").count() == 20
    split = spark.read.format("rawframes").option("partBytes", "1000").option("framesPerBatch", "2").load((tmp_path).as_uri())
    assert split.rdd.getNumPartitions() > 5 and rows(split, "frame_idx", "data") == rows(table, "frame_idx", "data")


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("pipeline:\n  samplers: [fps1, random]\nmodels:\n  vlm: {name: m, revision: ''}\n")
    config = Config.load(path)
    assert config.samplers == ["fps1", "random"] and config.aggregators == [] and config.caption_model == "m"
    with pytest.raises(RuntimeError, match="revision"):
        _ = config.caption_revision
    with pytest.raises(FileNotFoundError):
        Config.load(tmp_path / "none.yaml")
