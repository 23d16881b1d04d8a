"""The registered queries of the core over whole tables, each beside its SQL.

videos serve as frame streams of total_frames frames, sentences as reference captions (each sen_id once), rows of
baseline_results with a video as predictions for it (cider, bleu and rouge_l take a video's last caption; those of their names with _each,
and all_metrics and rouge_meteor, take every row), embeddings as hash inputs and vectors of ten streams."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import image, text, vector
from ..operators import combine, runs, score, select, stats
from ..streaming import selectors
from . import benchmark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tables of the queries in SQL.
_FPS = "CASE WHEN fps IS NOT NULL AND NOT isnan(fps) AND fps > 0 THEN fps ELSE 30.0 END"
_FRAMES = f"f AS (SELECT video_id, fps, total_frames, {_FPS} AS rate, unnest(range(0, total_frames)) AS frame_idx FROM videos WHERE total_frames > 0)"
_REFS = "r AS (SELECT sen_id, min(video_id) AS video_id, min(caption) AS caption FROM sentences WHERE sen_id IS NOT NULL GROUP BY sen_id)"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_HYPS = "p AS (SELECT video_id, arg_max(generated_caption, row_id) AS caption FROM baseline_results WHERE video_id IS NOT NULL AND trim(generated_caption) <> '' GROUP BY video_id)"
_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+'), lambda x: x <> ''))".replace('\\"', '"')
_LAST = "RUNS AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at) AS nth FROM results WHERE row_id IS NOT NULL) WHERE nth = 1)"


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return select.frames_of(_read(spark, d, "videos"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """(sen_id, video_id, caption), each sen_id once."""
    rows = _read(spark, d, "sentences").select("sen_id", "video_id", "caption").filter("sen_id is not null")
    return rows.groupBy("sen_id").agg(F.min("video_id").alias("video_id"), F.min("caption").alias("caption"))


def _captions(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).filter("video_id is not null and caption is not null")


def _refs_and_hyps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = _references(spark, d).select(F.col("video_id").alias("id"), F.col("sen_id").alias("ref_no"), "caption")
    told = _read(spark, d, "baseline_results").filter("video_id is not null and trim(generated_caption) <> ''")
    return refs, told.groupBy(F.col("video_id").alias("id")).agg(F.max_by("generated_caption", "row_id").alias("caption"))


def _refs_and_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References, and every row of baseline_results with a video as a hypothesis of its own; blank captions get their placeholder."""
    refs = _references(spark, d).select(F.col("video_id").alias("id"), F.col("sen_id").alias("ref_no"), "caption")
    told = _read(spark, d, "baseline_results").filter("video_id is not null")
    return refs, told.select(F.col("row_id").alias("id"), F.col("video_id").alias("of"), F.col("generated_caption").alias("caption"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """results with each row_id once: deliveries of a row are equal, so any of their columns' minima is the row."""
    rows = _read(spark, d, "results").filter("row_id is not null")
    kept = [c for c in rows.columns if c not in ("row_id", "loaded_at")]
    return rows.groupBy("row_id").agg(*(F.min(c).alias(c) for c in kept))


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select("label", "vec_id", vector.median_bits("embedding").alias("bits"))


# --- frame selection


@query(f"WITH {_FRAMES} SELECT video_id, frame_idx FROM f WHERE frame_idx % greatest(1, CAST(round_even(rate, 0) AS BIGINT)) = 0")
def interval_sample_1(spark, d):
    return select.interval_indices(_read(spark, d, "videos"))


@query(f"WITH {_FRAMES} SELECT video_id, frame_idx FROM f WHERE frame_idx % greatest(1, CAST(round_even(rate / 2, 0) AS BIGINT)) = 0")
def interval_sample_2(spark, d):
    return select.interval_indices(_read(spark, d, "videos"), 2.0)


@query(
    f"""WITH {_FRAMES}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5('42:' || CAST(frame_idx AS VARCHAR)), frame_idx) AS place FROM f)
SELECT video_id, frame_idx FROM o WHERE CASE WHEN fps IS NOT NULL AND NOT isnan(fps) AND fps > 0 THEN place <= greatest(1, ceil(total_frames / fps))
ELSE frame_idx % greatest(1, CAST(round_even(rate, 0) AS BIGINT)) = 0 END"""
)
def random_sample_seeded(spark, d):
    return select.random_sample(_read(spark, d, "videos"))


@query()
def random_sample_mersenne(spark, d):
    return select.mersenne_sample(_read(spark, d, "videos"))


@query("SELECT video_id, place, CAST(floor(place * total_frames / 8) AS BIGINT) AS frame_idx FROM (SELECT video_id, total_frames, CAST(unnest(range(0, 8)) AS INTEGER) AS place FROM videos WHERE total_frames > 0)")
def uniform_n(spark, d):
    return select.uniform_indices(_read(spark, d, "videos"), 8)


@query(f"WITH {_FRAMES} SELECT video_id, count(*) AS frames, count(*) FILTER (WHERE frame_idx % 3 = 0) AS strided FROM f GROUP BY video_id")
def stride_filter(spark, d):
    return _frames(spark, d).groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if(F.col("frame_idx") % select.STRIDE == 0).alias("strided"))


@query(f"SELECT video_id, greatest(1, CAST(ceil(greatest(1.0, total_frames / ({_FPS}))) AS BIGINT)) AS target FROM videos WHERE total_frames IS NOT NULL")
def second_budgets(spark, d):
    return _read(spark, d, "videos").filter("total_frames is not null").select("video_id", select.seconds_budget("total_frames", "fps").alias("target"))


_GRID = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT vec_id, e, list_transform(range(0, 64), lambda p:
  e[CASE WHEN p % 8 = 0 THEN p + 2 ELSE p END] + e[CASE WHEN p % 8 = 7 THEN p ELSE p + 2 END]
  + e[CASE WHEN p < 8 THEN p + 9 ELSE p - 7 END] + e[CASE WHEN p >= 56 THEN p - 7 ELSE p + 9 END] - 4 * e[p + 1]) AS g FROM v),
s AS (SELECT vec_id, list_avg(e) AS mean, list_var_pop(e) AS var, list_var_pop(g) AS lap_var FROM l)"""


@query(f"WITH {_GRID} SELECT vec_id, round(mean, 6) + 0.0 AS mean, round(var, 6) AS var, round(lap_var, 6) AS lap_var, mean > 0.02 OR mean < -0.02 OR var < 0.0 OR lap_var < 0.3 AS is_degenerate FROM s")
def degenerate_filter(spark, d):
    grid = _read(spark, d, "embeddings").select("vec_id", vector.grid_stats("embedding").alias("g")).select("vec_id", "g.*")
    return grid.select("vec_id", (F.round("mean", 6) + 0.0).alias("mean"), F.round("var", 6).alias("var"), F.round("lap_var", 6).alias("lap_var"), select.degenerate(0.02, -0.02, 0.0, 0.3).alias("is_degenerate"))


_BITS = """b AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > m) AS bits FROM (SELECT vec_id, label, embedding, list_sort(embedding[2:64])[32] AS m FROM embeddings))"""
_DISTANCE = "len(list_filter(list_zip({0}, {1}), lambda z: z[1] <> z[2]))"


@query(f"WITH {_BITS}, n AS (SELECT vec_id, label, bits, lag(bits) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM b) SELECT vec_id, label, CAST({_DISTANCE.format('bits', 'before')} AS BIGINT) AS distance FROM n WHERE before IS NOT NULL")
def bit_hash_hamming(spark, d):
    before = F.lag("bits").over(W.partitionBy("label").orderBy("vec_id"))
    return _hashed(spark, d).withColumn("before", before).filter("before is not null").select("vec_id", "label", vector.hamming("bits", "before").alias("distance"))


_CHAIN = f"""WITH RECURSIVE {_BITS},
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM b),
c AS (SELECT label, rn, vec_id, bits AS last, true AS keep FROM o WHERE rn = 1
  UNION ALL SELECT o.label, o.rn, o.vec_id, CASE WHEN {_DISTANCE.format("o.bits", "c.last")} > 28 THEN o.bits ELSE c.last END, {_DISTANCE.format("o.bits", "c.last")} > 28
  FROM c JOIN o ON o.label = c.label AND o.rn = c.rn + 1)"""


def _changed(spark, d):
    # A label is no video: the cap on a video's candidates is not for it.
    return select.changes(_hashed(spark, d).withColumn("hash", vector.packed("bits")), 28, "label", "vec_id", most=None)


@query(f"{_CHAIN} SELECT label, vec_id FROM c WHERE keep")
def change_filter_chain(spark, d):
    return _changed(spark, d).select("label", "vec_id")


@query(
    f"""{_CHAIN}, {_FRAMES}, k AS (SELECT 'video' || CAST(label AS VARCHAR) AS video_id, vec_id AS frame_idx, false AS fallback_used FROM c WHERE keep),
x AS (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS place FROM f WHERE video_id NOT IN (SELECT video_id FROM k) AND frame_idx % greatest(1, CAST(round_even(rate, 0) AS BIGINT)) = 0)
SELECT * FROM k UNION ALL SELECT video_id, frame_idx, true FROM x WHERE place <= 2000"""
)
def change_filter_fallback(spark, d):
    kept = _changed(spark, d).select(F.concat(F.lit("video"), F.col("label").cast("string")).alias("video_id"), F.col("vec_id").alias("frame_idx"))
    return select.with_fallback(kept, _frames(spark, d))


_SEED = """v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
mid AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label),
s0 AS (SELECT v.label, arg_max(vec_id, (list_dot_product(e, c), -vec_id)) AS vec_id FROM v JOIN mid USING (label) GROUP BY v.label)"""


def _greedy(steps: int, stop: str) -> str:
    return f"""WITH RECURSIVE {_SEED},
g AS (SELECT label, 1 AS rank, [vec_id] AS taken, false AS stopped FROM s0
  UNION ALL SELECT g.label, g.rank + 1, CASE WHEN n.stop THEN g.taken ELSE list_append(g.taken, n.vid) END, n.stop FROM g, LATERAL (
    SELECT arg_max(vec_id, (md, -vec_id)) AS vid, {stop} AS stop FROM (SELECT a.vec_id, min(1 - list_dot_product(a.e, b.e)) AS md FROM v a JOIN v b ON a.label = b.label
      WHERE a.label = g.label AND list_contains(g.taken, b.vec_id) AND NOT list_contains(g.taken, a.vec_id) GROUP BY a.vec_id)) n WHERE g.rank < {steps} AND NOT g.stopped AND n.vid IS NOT NULL),
f AS (SELECT label, arg_max(taken, rank) AS taken, bool_or(stopped) AS stopped_early FROM g GROUP BY label)
SELECT label, taken[k] AS vec_id, CAST(k AS INTEGER) AS rank, stopped_early FROM (SELECT label, taken, stopped_early, unnest(range(1, len(taken) + 1)) AS k FROM f)"""


@query(_greedy(10, "false"))
def diversity_fixed(spark, d):
    return select.diverse(_read(spark, d, "embeddings"), "label", "vec_id", "embedding", 10, 0.0, adaptive=False)


@query(_greedy(1000, "max(md) < 0.8"))
def diversity_adaptive(spark, d):
    return select.diverse(_read(spark, d, "embeddings"), "label", "vec_id", "embedding", None, 0.8)


# --- captions


@query(f"WITH {_REFS} SELECT video_id, count(*) AS n_captions, string_agg(caption, ' ' ORDER BY sen_id) AS caption FROM r WHERE video_id IS NOT NULL AND caption IS NOT NULL GROUP BY video_id")
def caption_raw(spark, d):
    return combine.concatenated(_captions(spark, d), "video_id", "sen_id", "caption")


_SETS = f"t AS (SELECT sen_id, video_id, caption, {_TOKENS.format('caption')} AS k, row_number() OVER (PARTITION BY video_id ORDER BY sen_id) AS rn FROM r WHERE video_id IS NOT NULL AND caption IS NOT NULL)"
_JACCARD = "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE END"


@query(
    f"""WITH RECURSIVE {_REFS}, {_SETS},
c AS (SELECT video_id, rn, sen_id, k AS last, true AS keep FROM t WHERE rn = 1
  UNION ALL SELECT t.video_id, t.rn, t.sen_id, CASE WHEN {_JACCARD.format("t.k", "c.last")} > 0.5 THEN c.last ELSE t.k END, NOT {_JACCARD.format("t.k", "c.last")} > 0.5
  FROM c JOIN t ON t.video_id = c.video_id AND t.rn = c.rn + 1)
SELECT video_id, sen_id FROM c WHERE keep"""
)
def caption_dedup(spark, d):
    return combine.without_repeats(_captions(spark, d), "video_id", "sen_id", "caption", 0.5).select("video_id", "sen_id")


@query(
    f"""WITH RECURSIVE {_REFS}, {_SETS},
c AS (SELECT video_id, rn, sen_id, caption, k AS last, true AS keep FROM t WHERE rn = 1
  UNION ALL SELECT t.video_id, t.rn, t.sen_id, t.caption, CASE WHEN {_JACCARD.format("t.k", "c.last")} > 0.85 THEN c.last ELSE t.k END, NOT {_JACCARD.format("t.k", "c.last")} > 0.85
  FROM c JOIN t ON t.video_id = c.video_id AND t.rn = c.rn + 1)
SELECT video_id, count(*) AS n_captions, string_agg(caption, ' ' ORDER BY sen_id) AS caption FROM c WHERE keep GROUP BY video_id"""
)
def caption_temporal(spark, d):
    return combine.temporal(_captions(spark, d), "video_id", "sen_id", "caption")


@query(
    f"""WITH {_REFS}, {_SETS},
s AS (SELECT a.video_id, a.sen_id, a.caption, round(coalesce(sum({_JACCARD.format("a.k", "b.k")}), 0), 9) AS s FROM t a LEFT JOIN t b ON a.video_id = b.video_id AND a.sen_id <> b.sen_id GROUP BY ALL)
SELECT video_id, count(*) AS n_captions, arg_max(caption, (s, -sen_id)) AS caption FROM s GROUP BY video_id"""
)
def caption_medoid(spark, d):
    return combine.medoid(_captions(spark, d), "video_id", "sen_id", "caption")


@query(f"WITH {_REFS}, {_SETS}, n AS (SELECT *, lag(k) OVER (PARTITION BY video_id ORDER BY sen_id) AS b FROM t) SELECT video_id, sen_id, round({_JACCARD.format('b', 'k')}, 6) AS similarity FROM n WHERE b IS NOT NULL")
def token_jaccard_pairs(spark, d):
    pairs = combine.token_pairs(_captions(spark, d), "video_id", "sen_id", "caption")
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("SELECT row_id, sampling_method || '_' || video_id AS k, translate('org/model:v 1', '/: ', '___') AS model FROM baseline_results WHERE video_id IS NOT NULL AND sampling_method IS NOT NULL")
def cache_keys(spark, d):
    rows = _read(spark, d, "baseline_results").filter("video_id is not null and sampling_method is not null")
    return rows.select("row_id", F.concat_ws("_", "sampling_method", "video_id").alias("k"), F.translate(F.lit("org/model:v 1"), "/: ", "___").alias("model"))


@query(f"SELECT row_id, coalesce(nullif({_SQUEEZE.format('generated_caption')}, ''), 'no caption generated') AS caption FROM baseline_results")
def placeholder_captions(spark, d):
    return _read(spark, d, "baseline_results").select("row_id", text.or_placeholder("generated_caption", text.NO_CAPTION).alias("caption"))


# --- corpus scoring

_WORDS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
_CORPUS = f"""{_REFS}, cw AS (SELECT video_id, {_WORDS.format("lower(" + _SQUEEZE.format("caption") + ")")} AS w FROM r WHERE video_id IS NOT NULL AND caption IS NOT NULL AND {_SQUEEZE.format("caption")} <> ''),
cg AS (SELECT DISTINCT video_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT video_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cw, (VALUES (1), (2), (3), (4)) v(n) WHERE len(w) >= n)),
idf AS (SELECT n, gram, count(*) AS df, ln(((SELECT count(DISTINCT video_id) FROM cw) + 1) / count(*)) AS idf FROM cg GROUP BY n, gram)"""
_REF_WORDS = f"""rr AS (SELECT video_id AS vid, sen_id AS ref_no, {_WORDS.format(_SQUEEZE.format("caption"))} AS w FROM r WHERE video_id IS NOT NULL AND {_SQUEEZE.format("caption")} <> '')"""
_GRAMS = """hg AS (SELECT id, vid, n, array_to_string(w[i : i + n - 1], ' ') AS gram, count(*) AS tf, any_value(len(w)) AS words FROM (SELECT id, vid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM hh, (VALUES (1), (2), (3), (4)) v(n) WHERE len(w) >= n) GROUP BY ALL),
rg AS (SELECT vid, ref_no, n, array_to_string(w[i : i + n - 1], ' ') AS gram, count(*) AS tf, any_value(len(w)) AS words FROM (SELECT vid, ref_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT * FROM rr WHERE vid IN (SELECT vid FROM hh)), (VALUES (1), (2), (3), (4)) v(n) WHERE len(w) >= n) GROUP BY ALL)"""
#: Hypotheses hh: the last caption of each video, and every row.
_LAST_TEXTS = f"""{_HYPS}, {_REF_WORDS}, hh AS (SELECT video_id AS id, video_id AS vid, {_WORDS.format(_SQUEEZE.format("caption"))} AS w FROM p WHERE video_id IN (SELECT vid FROM rr)), {_GRAMS}"""
_EACH_TEXTS = f"""{_REF_WORDS}, hh AS (SELECT row_id AS id, video_id AS vid, {_WORDS.format(f"coalesce(nullif({_SQUEEZE.format('generated_caption')}, ''), 'no caption generated')")} AS w FROM baseline_results WHERE video_id IN (SELECT vid FROM rr)), {_GRAMS}"""


@query(f"WITH {_CORPUS} SELECT CAST(n AS INTEGER) AS n, gram, df, round(idf, 6) AS idf FROM idf")
def corpus_idf(spark, d):
    return score.document_frequency(_captions(spark, d), "video_id").withColumn("idf", F.round("idf", 6))


_CIDER = """hw AS (SELECT id, vid, n, gram, words, tf * coalesce(idf, 0) AS w FROM hg LEFT JOIN idf USING (n, gram)), rw AS (SELECT vid, ref_no, n, gram, words, tf * coalesce(idf, 0) AS w FROM rg LEFT JOIN idf USING (n, gram)),
hn AS (SELECT id, n, sqrt(sum(w * w)) AS norm, any_value(words) AS words FROM hw GROUP BY id, n), rn AS (SELECT vid, ref_no, n, sqrt(sum(w * w)) AS norm, any_value(words) AS words FROM rw GROUP BY vid, ref_no, n),
s AS (SELECT id, vid, ref_no, n, sum(least(hw.w, rw.w) * rw.w) AS dot FROM hw JOIN rw USING (vid, n, gram) GROUP BY id, vid, ref_no, n),
c AS (SELECT s.id, sum(dot / (hn.norm * rn.norm) * exp(-pow(greatest(hn.words - 1, 0) - greatest(rn.words - 1, 0), 2) / 72)) AS total FROM s JOIN hn USING (id, n) JOIN rn USING (vid, ref_no, n) WHERE hn.norm > 0 AND rn.norm > 0 GROUP BY s.id),
n_refs AS (SELECT vid, count(*) AS n_refs FROM rr GROUP BY vid),
cider AS (SELECT hh.id, round(coalesce(total / 4 / n_refs * 10, 0), 6) AS cider FROM hh JOIN n_refs USING (vid) LEFT JOIN c USING (id))"""
_ORDERS = ", ".join(f"coalesce(max(c) FILTER (WHERE n = {n}), 0) AS c{n}" for n in range(1, 5))


def _bleu_sql(k: int) -> str:
    logs = " + ".join(f"ln((coalesce(c{n}, 0) + 1e-15) / (greatest(t - {n - 1}, 0) + 1e-9))" for n in range(1, k + 1))
    return f"round(exp(({logs}) / {k}) * CASE WHEN ratio < 1 THEN exp(1 - 1 / ratio) ELSE 1 END, 6) AS bleu{k}"


_BLEU = f"""clip AS (SELECT vid, n, gram, max(tf) AS most FROM rg GROUP BY ALL),
bm AS (SELECT id, n, sum(least(tf, most)) AS c FROM hg JOIN clip USING (vid, n, gram) GROUP BY id, n), m4 AS (SELECT id, {_ORDERS} FROM bm GROUP BY id),
bl AS (SELECT hh.id, len(hh.w) AS t, arg_min(len(rr.w), (abs(len(rr.w) - len(hh.w)), len(rr.w))) AS l FROM hh JOIN rr USING (vid) GROUP BY hh.id, t),
bb AS (SELECT bl.*, m4.* EXCLUDE (id), (t + 1e-15) / (l + 1e-9) AS ratio FROM bl LEFT JOIN m4 USING (id)),
bleu AS (SELECT id, {", ".join(_bleu_sql(n) for n in range(1, 5))} FROM bb)"""
#: Pairs of hypothesis and reference, equal references once; the table of the longest common subsequence and the matches of METEOR grow by a word a round.
_PAIRS = """q AS (SELECT DISTINCT hh.id, hh.w AS h, rr.w AS r FROM hh JOIN rr USING (vid)),
l AS (SELECT id, h, r, 0 AS i, list_transform(range(0, len(r) + 1), lambda z: 0::BIGINT) AS t FROM q
  UNION ALL SELECT id, h, r, i + 1, list_reduce(range(1, len(r) + 1), lambda acc, j: list_append(acc, CASE WHEN r[j] = h[i + 1] THEN t[j] + 1 ELSE greatest(t[j + 1], acc[j]) END), [0::BIGINT]) FROM l WHERE i < len(h)),
lm AS (SELECT id, max(t[len(r) + 1] / len(h)::DOUBLE) AS p, max(t[len(r) + 1] / len(r)::DOUBLE) AS rc FROM l WHERE i = len(h) GROUP BY id),
rouge AS (SELECT id, round(CASE WHEN p > 0 AND rc > 0 THEN 2.44 * p * rc / (rc + 1.44 * p) ELSE 0 END, 6) AS rouge_l FROM lm)"""
_METEOR = """mt AS (SELECT id, h, r, 0 AS i, 0 AS runs, -1::BIGINT AS last, []::BIGINT[] AS used FROM q
  UNION ALL SELECT id, h, r, i + 1, runs + CASE WHEN spot IS NOT NULL AND spot <> last + 1 THEN 1 ELSE 0 END, coalesce(spot, -1), CASE WHEN spot IS NULL THEN used ELSE list_append(used, spot) END FROM
  (SELECT *, CASE WHEN list_contains(own, last + 1) THEN last + 1 ELSE own[1] END AS spot FROM (SELECT *, list_filter(range(1, len(r) + 1), lambda k: r[k] = h[i + 1] AND NOT list_contains(used, k)) AS own FROM mt WHERE i < len(h)))),
mf AS (SELECT id, runs, len(used) AS found, len(used) / len(h)::DOUBLE AS p, len(used) / len(r)::DOUBLE AS q FROM mt WHERE i = len(h)),
meteor AS (SELECT id, round(max(CASE WHEN found > 0 THEN 10 * p * q / (q + 9 * p) * (1 - 0.5 * pow(runs / found, 3)) ELSE 0 END), 6) AS meteor FROM mf GROUP BY id)"""


def _six(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _idf(spark: SparkSession, d: str) -> DataFrame:
    return score.document_frequency(_captions(spark, d), "video_id")


@query(f"WITH {_CORPUS}, {_LAST_TEXTS}, {_CIDER} SELECT * FROM cider")
def cider(spark, d):
    return _six(score.cider(*_refs_and_hyps(spark, d), _idf(spark, d)))


@query(f"WITH {_REFS}, {_LAST_TEXTS}, {_BLEU} SELECT * FROM bleu")
def bleu(spark, d):
    return _six(score.bleu(*_refs_and_hyps(spark, d)))


@query(f"WITH RECURSIVE {_REFS}, {_LAST_TEXTS}, {_PAIRS} SELECT * FROM rouge")
def rouge_l(spark, d):
    return _six(score.rouge_meteor(*_refs_and_hyps(spark, d)).select("id", "rouge_l"))


@query(f"WITH RECURSIVE {_REFS}, {_EACH_TEXTS}, {_PAIRS}, {_METEOR} SELECT * FROM rouge JOIN meteor USING (id)")
def rouge_meteor(spark, d):
    return _six(score.rouge_meteor(*_refs_and_rows(spark, d)))


@query()
def rouge_meteor_stems(spark, d):
    return _six(score.rouge_meteor(*_refs_and_rows(spark, d), stems=True))


@query(f"WITH RECURSIVE {_CORPUS}, {_EACH_TEXTS}, {_CIDER}, {_BLEU}, {_PAIRS}, {_METEOR} SELECT id, cider, bleu1, bleu4, rouge_l, meteor FROM cider JOIN bleu USING (id) JOIN rouge USING (id) JOIN meteor USING (id)")
def all_metrics(spark, d):
    return _six(score.all_metrics(*_refs_and_rows(spark, d), _idf(spark, d)))


@query(f"WITH {_CORPUS}, {_EACH_TEXTS}, {_CIDER} SELECT * FROM cider")
def cider_each(spark, d):
    return _six(score.cider(*_refs_and_rows(spark, d), _idf(spark, d)))


@query(f"WITH {_REFS}, {_EACH_TEXTS}, {_BLEU} SELECT * FROM bleu")
def bleu_each(spark, d):
    return _six(score.bleu(*_refs_and_rows(spark, d)))


@query(f"WITH RECURSIVE {_REFS}, {_EACH_TEXTS}, {_PAIRS} SELECT * FROM rouge")
def rouge_l_each(spark, d):
    return _six(score.rouge_meteor(*_refs_and_rows(spark, d)).select("id", "rouge_l"))


@query(f"WITH {_REFS}, g AS (SELECT video_id, count(*) AS n FROM r WHERE video_id IS NOT NULL GROUP BY video_id) SELECT count(*) AS n_videos, sum(n)::BIGINT AS n_references, round(avg(n), 6) AS mean_references, count(*) FILTER (WHERE n < 2) AS n_sparse FROM g")
def reference_coverage(spark, d):
    refs, _ = _refs_and_hyps(spark, d)
    return score.reference_coverage(refs).withColumn("mean_references", F.round("mean_references", 6))


@query(f"WITH {_REFS}, {_HYPS} SELECT (SELECT count(*) FROM r) AS n_references, (SELECT count(*) FROM r WHERE coalesce(trim(caption), '') = '') AS blank_references, (SELECT count(*) FROM p) AS n_ids, (SELECT count(*) FROM p WHERE coalesce(trim(caption), '') = '') AS blank_hypotheses, (SELECT count(*) FROM p) < 50 AS too_few")
def input_diagnostics(spark, d):
    return score.input_diagnostics(*_refs_and_hyps(spark, d))


@query(f"WITH {_REFS}, h AS (SELECT * FROM baseline_results WHERE video_id IS NOT NULL) SELECT (SELECT count(*) FROM r) AS n_references, (SELECT count(*) FROM r WHERE coalesce(trim(caption), '') = '') AS blank_references, (SELECT count(*) FROM h) AS n_ids, (SELECT count(*) FROM h WHERE coalesce(trim(generated_caption), '') = '') AS blank_hypotheses, (SELECT count(*) FROM h) < 50 AS too_few")
def input_diagnostics_each(spark, d):
    return score.input_diagnostics(*_refs_and_rows(spark, d))


# --- joins and experiment rows


@query(f"WITH {_REFS}, {_HYPS} SELECT video_id AS id, {_SQUEEZE.format('caption')} AS caption FROM p WHERE video_id IN (SELECT video_id FROM r WHERE {_SQUEEZE.format('caption')} <> '')")
def refs_semi_join(spark, d):
    return score.cleaned(*_refs_and_hyps(spark, d))[1]


@query(f"WITH {_REFS} SELECT row_id AS id, video_id AS \"of\", coalesce(nullif({_SQUEEZE.format('generated_caption')}, ''), 'no caption generated') AS caption FROM baseline_results WHERE video_id IN (SELECT video_id FROM r WHERE {_SQUEEZE.format('caption')} <> '')")
def refs_semi_join_each(spark, d):
    return score.cleaned(*_refs_and_rows(spark, d))[1]


@query("SELECT video_id FROM videos WHERE video_id NOT IN (SELECT video_id FROM baseline_results WHERE video_id IS NOT NULL)")
def pending_anti_join(spark, d):
    done = _read(spark, d, "baseline_results").select("video_id").distinct()
    return runs.kept_and_pending(_read(spark, d, "videos").select("video_id"), done, ["video_id"])[1]


@query("SELECT video_id, s AS sampling_method, a AS aggregation_method, m AS caption_mode FROM videos, (VALUES ('fps1'), ('fps2'), ('phash')) x(s), (VALUES ('raw'), ('centroid')) y(a), (VALUES ('vlm_only'), ('vlm_plus_llm')) z(m)")
def config_cross_join(spark, d):
    return runs.planned(_read(spark, d, "videos"), runs.configurations(spark, ["fps1", "fps2", "phash"], ["raw", "centroid"], ["vlm_only", "vlm_plus_llm"]))


@query(
    f"""WITH {_LAST}, u AS (SELECT avg(frames_selected) AS usual FROM RUNS WHERE sampling_method = 'fps1')
SELECT row_id, round((usual - frames_selected) / usual * 100, 6) AS vlm_calls_saved_pct, round(cider / greatest(1, frames_selected), 10) AS semantic_yield FROM RUNS, u"""
)
def row_metrics(spark, d):
    rows = _runs(spark, d).drop("vlm_calls_saved_pct", "semantic_yield")
    usual = rows.agg(F.avg(F.when(F.col("sampling_method") == "fps1", F.col("frames_selected"))).alias("usual"))
    made = rows.withColumns({"vlm_calls": F.col("frames_selected"), "candidate_pool_size": F.col("tass_candidate_pool"), "frames_degenerate_dropped": F.col("tass_degenerate_dropped")})
    out = runs.with_savings(made.join(F.broadcast(usual)))  # one row
    return out.select("row_id", F.round("vlm_calls_saved_pct", 6).alias("vlm_calls_saved_pct"), F.round("semantic_yield", 10).alias("semantic_yield"))


@query(f"WITH {_LAST}, m AS (SELECT sampling_method, avg(frames_selected) AS c FROM RUNS WHERE sampling_method IS NOT NULL AND frames_selected IS NOT NULL GROUP BY 1), u AS (SELECT max(c) FILTER (WHERE sampling_method = 'fps1') AS u FROM m) SELECT sampling_method, round(c, 6) AS mean_calls, round((u - c) / u * 100, 6) AS calls_saved_pct FROM m, u")
def calls_saved(spark, d):
    out = runs.calls_saved(_runs(spark, d))
    return out.select("sampling_method", F.round("mean_calls", 6).alias("mean_calls"), F.round("calls_saved_pct", 6).alias("calls_saved_pct"))


@query("SELECT row_id, video_id, sampling_method, CASE WHEN NOT isnan(cider) THEN cider END AS cider, CASE WHEN NOT isnan(semantic_yield) THEN semantic_yield END AS semantic_yield, benchmark_type FROM (SELECT * FROM results UNION ALL BY NAME SELECT * FROM baseline_results)")
def runs_union(spark, d):
    return runs.union_runs([_read(spark, d, "results"), _read(spark, d, "baseline_results")]).select("row_id", "video_id", "sampling_method", "cider", "semantic_yield", "benchmark_type")


@query("SELECT count(DISTINCT video_id) + coalesce(max(CASE WHEN video_id IS NULL THEN 1 END), 0) AS videos FROM results")
def distinct_videos(spark, d):
    return runs.distinct_videos(_read(spark, d, "results"))


_RECORDS = f"""{_LAST}, rec AS (SELECT RUNS.video_id, sampling_method AS sampler, row_id, CASE WHEN row_id % 3 = 0 THEN NULL ELSE total_frames END AS original_frame_count, frames_selected AS selected_frame_count
FROM RUNS JOIN videos USING (video_id) WHERE sampling_method IS NOT NULL)"""


def _records(spark, d):
    """Selection records of all runs; every third lacks its video's frame count, as records of old runs do."""
    rows = _runs(spark, d).filter("sampling_method is not null").join(_read(spark, d, "videos").select("video_id", "total_frames"), "video_id")
    count = F.when(F.col("row_id") % 3 != 0, F.col("total_frames"))
    return rows.select(F.col("sampling_method").alias("sampler"), "video_id", "row_id", count.alias("original_frame_count"), F.col("frames_selected").alias("selected_frame_count"), F.lit(None).cast("double").alias("reduction_pct"))


_REDUCED = f"""{_RECORDS}, k AS (SELECT video_id, arg_max(original_frame_count, row_id) AS known FROM rec WHERE original_frame_count > 0 GROUP BY video_id),
red AS (SELECT sampler AS method, rec.video_id, round((1 - selected_frame_count / coalesce(CASE WHEN original_frame_count > 0 THEN original_frame_count END, known)) * 100, 2) AS reduction_pct FROM rec LEFT JOIN k USING (video_id))"""


@query(f"WITH {_REDUCED} SELECT * FROM red WHERE reduction_pct IS NOT NULL")
def coalesced_lookup(spark, d):
    return runs.reductions(_records(spark, d), "row_id")


@query(f"WITH {_REDUCED} SELECT method, count(*) AS n, min(reduction_pct) AS min, round(quantile_cont(reduction_pct, 0.25), 6) AS q1, round(quantile_cont(reduction_pct, 0.5), 6) AS median, round(quantile_cont(reduction_pct, 0.75), 6) AS q3, max(reduction_pct) AS max FROM red WHERE reduction_pct IS NOT NULL GROUP BY method")
def boxplot_quartiles(spark, d):
    q = stats.quartiles(runs.reductions(_records(spark, d), "row_id"), "method", "reduction_pct")
    return q.select("method", "n", "min", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")), "max")


@query("SELECT count(DISTINCT video_id) AS videos, round(avg(actual_frames_used), 6) AS mean_frames, bool_or(oom_fallback_triggered) AS any_fallback FROM baseline_results")
def baseline_metadata(spark, d):
    return runs.baseline_metadata(_read(spark, d, "baseline_results")).withColumn("mean_frames", F.round("mean_frames", 6))


@query("SELECT user_id, greatest(0, round(max(value) - arg_min(value, ts), 2)) AS peak_vram_mb, greatest(0, round(max(value) - arg_min(value, ts), 2)) AS peak_ram_delta_mb, greatest(0, round(max(value), 1)) AS gpu_utilization_pct FROM events GROUP BY user_id")
def telemetry_peaks(spark, d):
    samples = _read(spark, d, "events").select("user_id", "ts", *(F.col("value").alias(c) for c in ("vram_mb", "ram_mb", "gpu_util_pct")))
    return runs.telemetry_peaks(samples, ["user_id"])


# --- statistics

_METRICS = [m for m in stats.METRICS]
_KEYS = ", ".join(stats.KEYS)
_VALUES = ", ".join(f"CASE WHEN NOT isnan({m}::DOUBLE) THEN {m}::DOUBLE END AS {m}" for m in _METRICS)
_STATS = f"{_LAST}, v AS (SELECT {_KEYS}, {_VALUES} FROM RUNS WHERE sampling_method IS NOT NULL AND aggregation_method IS NOT NULL AND caption_mode IS NOT NULL)"


def _round(x: str) -> str:
    """Six digits; exact halves, which means of few decimals often are, are moved up alike on both engines."""
    return f"round(({x}) * 1.000000000001, 6)"


_FIVE = ", ".join(f"{_round(f'avg({m})')} AS {m}_mean, {_round(f'median({m})')} AS {m}_median, {_round(f'CASE WHEN count({m}) > 0 THEN coalesce(stddev_samp({m}), 0) END')} AS {m}_std, {_round(f'min({m})')} AS {m}_min, {_round(f'max({m})')} AS {m}_max" for m in _METRICS)


def _rounded(df: DataFrame) -> DataFrame:
    """_round() of all doubles."""
    return df.select(*(F.round(F.col(c) * 1.000000000001, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query(f"WITH {_STATS} SELECT {_KEYS}, count(*) AS count, {_FIVE} FROM v GROUP BY {_KEYS}")
def a1_statistics(spark, d):
    out = stats.grouped_statistics(_runs(spark, d))
    return _rounded(out.drop(*(c for c in out.columns if "_ci95_" in c)))


def _ci_sql(m: str) -> str:
    low, high = (f"a_{m} {sign} t.t * s_{m} / sqrt(n_{m})" for sign in "-+")
    if any(p in m for p in ("bleu", "rouge_l", "meteor")):
        low, high = (f"least(1.0, greatest(0.0, {x}))" for x in (low, high))
    elif m != "semantic_yield":
        low, high = (f"greatest(0.0, {x})" for x in (low, high))
    return f"{_round(f'CASE WHEN n_{m} < 2 OR s_{m} = 0 THEN a_{m} ELSE {low} END')} AS {m}_ci95_lower, {_round(f'CASE WHEN n_{m} < 2 OR s_{m} = 0 THEN a_{m} ELSE {high} END')} AS {m}_ci95_upper"


_CI_METRICS = ["cider", "meteor", "frames_selected", "semantic_yield"]
#: Quantiles of t that the oracle looks up; beyond the table, where they hardly differ, four terms of the series about the normal quantile.
_T = ", ".join(f"({n}, {stats.t_quantile(n)!r})" for n in range(1, 400))
_Z = 1.959963984540054
_SERIES = f"({_Z} + {(_Z**3 + _Z) / 4!r} / f + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / pow(f, 2) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / pow(f, 3))"


@query(
    f"""WITH {_LAST}, w AS (SELECT video_id, sampling_method, {", ".join(f"CASE WHEN NOT isnan({m}::DOUBLE) THEN {m}::DOUBLE END AS {m}" for m in _CI_METRICS)} FROM RUNS WHERE video_id IS NOT NULL AND sampling_method IS NOT NULL),
g AS (SELECT video_id, sampling_method, count(*) AS count, {", ".join(f"count({m}) AS n_{m}, avg({m}) AS a_{m}, coalesce(stddev_samp({m}), 0) AS s_{m}" for m in _CI_METRICS)} FROM w GROUP BY video_id, sampling_method),
t(df, t) AS (VALUES {_T})
SELECT video_id, sampling_method, {", ".join(f"max({m}_ci95_lower) AS {m}_ci95_lower, max({m}_ci95_upper) AS {m}_ci95_upper" for m in _CI_METRICS)} FROM
(SELECT video_id, sampling_method, {", ".join(_ci_sql(m).replace("t.t", f"coalesce((SELECT t.t FROM t WHERE t.df = n_{m} - 1), {_SERIES.replace('f,', f'(n_{m} - 1),').replace('/ f', f'/ (n_{m} - 1)')})") for m in _CI_METRICS)} FROM g) GROUP BY ALL"""
)
def a4_confidence_intervals(spark, d):
    out = stats.grouped_statistics(_runs(spark, d), ["video_id", "sampling_method"], _CI_METRICS, medians=False)
    return _rounded(out.select("video_id", "sampling_method", *(c for c in out.columns if "_ci95_" in c)))


_BEST = f"""{_STATS}, g AS (SELECT {_KEYS}, avg(cider) AS q, avg(processing_time_s) AS p, avg(peak_vram_mb) AS w, avg(peak_ram_delta_mb) AS y FROM v GROUP BY {_KEYS})"""


def _top(role: str, c: str, order: str) -> str:
    return f"SELECT * FROM (SELECT '{role}' AS role, {_KEYS}, {_round(c)} AS value FROM g ORDER BY {c} {order} NULLS LAST, {_KEYS} LIMIT 1)"


@query(f"WITH {_BEST} {_top('best', 'q', 'DESC')} UNION ALL {_top('fastest', 'p', '')} UNION ALL {_top('least_vram', 'w', '')} UNION ALL {_top('least_ram', 'y', '')}")
def rank_best(spark, d):
    return _rounded(stats.highlights(stats.grouped_statistics(_runs(spark, d), medians=False)))


_POINTS = f"{_STATS}, m AS (SELECT {_KEYS}, {_round('avg(processing_time_s)')} AS processing_time_s, {_round('avg(cider)')} AS cider FROM v GROUP BY {_KEYS})"


@query(f"WITH {_POINTS} SELECT * FROM m")
def plot_means(spark, d):
    return _rounded(stats.plot_means(_runs(spark, d)))


@query(f"WITH {_POINTS}, s AS (SELECT *, round_even(processing_time_s, 1) AS slot, row_number() OVER (ORDER BY processing_time_s, cider, {_KEYS}) AS rn FROM m) SELECT {_KEYS}, processing_time_s, cider, slot, (SELECT count(*) FROM s b WHERE b.slot = s.slot AND b.rn < s.rn AND abs(b.cider - s.cider) < 0.02) AS \"offset\" FROM s")
def label_offsets(spark, d):
    return stats.label_offsets(_rounded(stats.plot_means(_runs(spark, d))))


@query(f"WITH {_POINTS} SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.cider >= m.cider AND b.processing_time_s <= m.processing_time_s AND (b.cider > m.cider OR b.processing_time_s < m.processing_time_s))")
def frontier(spark, d):
    return stats.frontier(_rounded(stats.plot_means(_runs(spark, d))))


@query(f"WITH {_STATS} SELECT sampling_method || ' + ' || aggregation_method AS pipeline_config, caption_mode, metric, {_round('avg(x)')} AS mean, count(*) AS n FROM (UNPIVOT v ON {', '.join(stats.BAR_METRICS)} INTO NAME metric VALUE x) GROUP BY ALL")
def bar_means(spark, d):
    return _rounded(stats.bar_means(_runs(spark, d)))


def _steps() -> list[float]:
    """Chances of a Poisson variable of mean 1 to be at most 0, 1, ..., 11."""
    return [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


_DRAWN = f"""{_LAST}, b AS (SELECT {_KEYS}, cider AS x, CAST('0x' || md5(CAST(row_id AS VARCHAR))[1:7] AS BIGINT) % 1024 AS part FROM RUNS WHERE cider IS NOT NULL AND NOT isnan(cider) AND sampling_method IS NOT NULL AND aggregation_method IS NOT NULL AND caption_mode IS NOT NULL),
p AS (SELECT {_KEYS}, part, sum(x) AS s, count(*) AS n FROM b GROUP BY ALL),
u AS (SELECT *, CAST('0x' || md5(concat_ws('|', {_KEYS}, part, draw))[1:7] AS BIGINT) / 268435456.0 AS u FROM p, (SELECT unnest(range(1, 201)) AS draw)),
w AS (SELECT {_KEYS}, draw, s, n, {" + ".join(f"CASE WHEN u > {x!r} THEN 1 ELSE 0 END" for x in _steps())} AS w FROM u),
m AS (SELECT {_KEYS}, draw, sum(w * s) / nullif(sum(w * n), 0) AS mean FROM w GROUP BY ALL)"""


@query(f"WITH {_DRAWN} SELECT {_KEYS}, round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper FROM m GROUP BY ALL")
def bar_intervals(spark, d):
    return _six(stats.bootstrap_means(_runs(spark, d).filter("row_id is not null"), "cider"))


@query("SELECT DISTINCT sampling_method, CASE sampling_method WHEN 'fps1' THEN 0 WHEN 'fps2' THEN 1 WHEN 'random' THEN 2 WHEN 'phash' THEN 3 WHEN 'tass_fixed' THEN 4 WHEN 'tass_adaptive' THEN 5 ELSE 99 END AS place FROM results WHERE sampling_method IS NOT NULL")
def method_order(spark, d):
    return _read(spark, d, "results").filter("sampling_method is not null").select("sampling_method").distinct().withColumn("place", stats.method_place("sampling_method")).orderBy("place", "sampling_method")


# --- entry points

_COMBINED = _STATS.replace(_LAST, "RUNS AS (SELECT * FROM results UNION ALL BY NAME SELECT * FROM baseline_results)")


@query(f"WITH {_COMBINED} SELECT {_KEYS}, count(*) AS count, {_FIVE} FROM v GROUP BY {_KEYS}")
def combined_statistics(spark, d):
    """Statistics of both kinds of saved runs together, deliveries as they come."""
    _, out, _ = benchmark.combine_runs([_read(spark, d, "results"), _read(spark, d, "baseline_results")])
    return _rounded(out.drop(*(c for c in out.columns if "_ci95_" in c)))


def _pictures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as grey frames of 8 x 8 pixels, a video a label, in the order of their ids; and these videos, of 25 frames a second."""
    order = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    pixels = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.round(128 + x * 400).cast("int"))))
    data = F.unhex(F.array_join(F.transform(pixels, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    rows = _read(spark, d, "embeddings").select(F.concat(F.lit("video"), "label").alias("video_id"), order.cast("bigint").alias("frame_idx"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("n_channels"), data.alias("data"))
    return rows, rows.groupBy("video_id").agg(F.lit(25.0).alias("fps"), F.count("*").alias("total_frames"))


def _caption_by_light() -> Callable[[list], list]:
    """A stand-in for a caption model: tells how light a frame is."""
    return lambda frames: [f"a {('dark', 'dim', 'light', 'bright')[min(3, sum(x) // 64 // 64)]} frame with a person in it" for x in frames]


def _answer_in_short() -> Callable[[list], list]:
    return lambda prompts: [" ".join(p.partition("Visual Summary: ")[2].split()[:8]) for p in prompts]


def _told_frames() -> Callable[[list], str]:
    return lambda images: f"a person in {len(images)} frames"


def _own_references(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).filter("video_id is not null and caption is not null").select("video_id", F.col("sen_id").alias("ref_no"), "caption")


@query()
def benchmark_rows(spark, d):
    """run() over frames made of embeddings, with stand-ins for models; without the times, which differ from run to run."""
    frames, videos = _pictures(spark, d)
    models = benchmark.Models(_caption_by_light, _answer_in_short, embed=lambda pool: pool.withColumn("embedding", F.array(F.cos(F.col("frame_idx") / 9), F.sin(F.col("frame_idx") / 9))))
    done = benchmark.run(videos, frames, _own_references(spark, d), models, ["fps1", "fps2", "random", "phash", "tass_fixed", "tass_adaptive"], ["raw", "temporal", "centroid"], ["vlm_only", "vlm_plus_llm"])
    return _six(done.rows.drop("processing_time_s"))


@query()
def baseline_run(spark, d):
    """baseline() over the same frames, with a stand-in for the model."""
    frames, videos = _pictures(spark, d)
    rows, _, _ = benchmark.baseline(videos, frames, _own_references(spark, d), _told_frames)
    return _six(rows.drop("processing_time_s"))


@query()
def frame_measures(spark, d):
    """Grey level, its variance, that of its Laplacian, and the perceptual hash of the same frames."""
    return _six(image.measured_frames(_pictures(spark, d)[0]))


# --- event time, an extension


@query("SELECT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    out = selectors.windowed(_read(spark, d, "events"), "ts", "event_type", "value", "1 day")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
