"""The same results in SQL, where SQL can express the operator. Queries that are iterative, sketched or learned have none."""

from __future__ import annotations

W = r"'[\p{L}\p{Nd}]+'"
_CAPTIONS = f"""s AS (SELECT sen_id, min(caption) AS caption FROM sentences WHERE sen_id IS NOT NULL GROUP BY sen_id),
w AS (SELECT sen_id, regexp_extract_all(lower(caption), {W}) AS ws FROM s WHERE caption IS NOT NULL)"""
_MARK = "CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.09 * (SELECT count(*) FROM s) THEN 'common' ELSE 'kept' END"
_TERMS = f"""WITH {_CAPTIONS},
t AS (SELECT term, count(*) AS cf, count(DISTINCT sen_id) AS df FROM (SELECT sen_id, unnest(ws) AS term FROM w) GROUP BY term)"""
_NGRAMS = f"""WITH {_CAPTIONS},
p AS (SELECT sen_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(ws) >= n),
g AS (SELECT sen_id, n, array_to_string(ws[k : k + n - 1], ' ') AS term FROM p),
t AS (SELECT term, n, count(*) AS cf, count(DISTINCT sen_id) AS df FROM g GROUP BY term, n)"""
_RESULTS = "SELECT row_id, min(sampling_method) AS sampling_method, min(aggregation_method) AS aggregation_method, min(caption_mode) AS caption_mode, min(cider) AS cider, min(bleu4) AS bleu4, min(meteor) AS meteor, min(processing_time_s) AS processing_time_s, min(peak_vram_mb) AS peak_vram_mb FROM results WHERE row_id IS NOT NULL GROUP BY row_id"
_EXACT = f"""WITH r AS ({_RESULTS}),
l AS (SELECT sampling_method, 'processing_time_s' AS metric, processing_time_s AS x FROM r UNION ALL SELECT sampling_method, 'peak_vram_mb', peak_vram_mb FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY sampling_method, metric ORDER BY x) AS rn, count(*) OVER (PARTITION BY sampling_method, metric) AS n FROM l WHERE x IS NOT NULL AND NOT isnan(x)),
q AS (SELECT *, CAST(greatest(1, ceil(p * n - 1e-9)) AS BIGINT) AS first FROM o, (SELECT CAST(p AS DOUBLE) AS p FROM (VALUES (0.5), (0.9), (0.95), (0.99)) v(p)))
SELECT sampling_method, metric, p, n, max(x) FILTER (WHERE rn = first) AS least, max(x) FILTER (WHERE rn = least(n, first + floor(0.001 * n) + 2)) AS most FROM q GROUP BY ALL"""


def _walk(items: str) -> str:
    """The walk over rows (id, s0, s1, s2, s3) of `items`: 40 rounds, by prefix sums over the values of each score."""
    rounds = []
    for k in range(4):
        given = f"sum(CASE WHEN s{k} IS NOT NULL THEN mass / has END) OVER (PARTITION BY s{k})"
        # Rows of a value give its whole sum divided by their number each; ranges end before the value itself.
        rounds.append(f"{given} AS g{k}")
    each = ", ".join(f"coalesce(sum(CASE WHEN s{k} IS NOT NULL AND b{k} > 0 THEN g{k} / c{k} / b{k} END) OVER (ORDER BY s{k} NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS r{k}" for k in range(4))
    loose = " + ".join(f"CASE WHEN s{k} IS NOT NULL AND b{k} = 0 THEN mass / has ELSE 0 END" for k in range(4))
    got = " + ".join(f"CASE WHEN s{k} IS NOT NULL THEN r{k} ELSE 0 END" for k in range(4))
    ranks = ", ".join(f"CASE WHEN s{k} IS NOT NULL THEN count(s{k}) OVER () - count(s{k}) OVER (ORDER BY s{k} NULLS FIRST) END AS b{k}, CASE WHEN s{k} IS NOT NULL THEN count(*) OVER (PARTITION BY s{k}) END AS c{k}" for k in range(4))
    keep = ", ".join(f"s{k}, b{k}, c{k}" for k in range(4))
    return f"""i AS (SELECT *, {" + ".join(f"(s{k} IS NOT NULL)::INT" for k in range(4))} AS has, count(*) OVER () AS n, {ranks} FROM ({items})),
w AS (SELECT 0 AS step, id, {keep}, has, n, 1.0 / n AS mass FROM i
  UNION ALL SELECT step + 1, id, {keep}, has, n, 0.15 / n + 0.85 * loose / n + 0.85 * ({got}) FROM
  (SELECT *, {each} FROM (SELECT *, {", ".join(rounds)}, sum(CASE WHEN has = 0 THEN mass ELSE {loose} END) OVER () AS loose FROM w WHERE step < 40))),
f AS (SELECT id, round(mass * n, 9) AS score FROM w WHERE step = 40)"""


def _signed(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN {'-' if c == 'processing_time_s' else ''}{c} + 0.0 END"


_SCORES = ["cider", "bleu4", "meteor", "processing_time_s"]
_RANKING = f"""WITH RECURSIVE r AS ({_RESULTS}), {_walk("SELECT row_id AS id, " + ", ".join(f"{_signed(c)} AS s{k}" for k, c in enumerate(_SCORES)) + " FROM r")}
SELECT id AS row_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS position FROM f"""
_KEYS = ["sampling_method", "aggregation_method", "caption_mode"]
_CONFIGURATIONS = f"""WITH RECURSIVE r AS ({_RESULTS}), m AS (SELECT {" || ' + ' || ".join(f"coalesce({k}, 'none')" for k in _KEYS)} AS id, {", ".join(f"round(avg({_signed(c)}), 9) AS s{k}" for k, c in enumerate(_SCORES))} FROM r GROUP BY {", ".join(_KEYS)}),
{_walk("SELECT * FROM m")} SELECT id AS configuration, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS position FROM f"""
_RECORDS = f"""WITH j AS (SELECT rec_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM raw_records WHERE rec_id IS NOT NULL),
f AS (SELECT rec_id, json_extract_string(p, '$.video_id') AS v, json_extract_string(p, '$.caption') AS c FROM j WHERE json_type(p, '$.caption') = 'VARCHAR'),
k AS (SELECT rec_id, array_to_string(regexp_extract_all(lower(coalesce(v, '')), {W}), '') || '|' || array_to_string(regexp_extract_all(lower(c), {W}), '') AS canon, regexp_matches(lower(c), {W}) AS told FROM f),
g AS (SELECT rec_id, canon, min(rec_id) OVER (PARTITION BY canon) AS keep_id FROM k WHERE told)"""
_REPEATS = f"""WITH w AS (SELECT row_id, coalesce(regexp_extract_all(lower(generated_caption), {W}), []) AS ws FROM baseline_results),
p AS (SELECT row_id, k, array_to_string(ws[k : k + 3], ' ') AS gram FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 2)) AS k FROM w WHERE len(ws) >= 4)),
a AS (SELECT row_id, k FROM (SELECT row_id, k, row_number() OVER (PARTITION BY row_id, gram ORDER BY k) AS nth FROM p) WHERE nth > 1),
c AS (SELECT row_id, count(DISTINCT k + d) AS repeated FROM a, (VALUES (0), (1), (2), (3)) v(d) GROUP BY row_id)"""
_LONGEST = """e AS (SELECT row_id, i, j, i - row_number() OVER (PARTITION BY row_id, j - i ORDER BY i) AS run FROM
  (SELECT row_id, ws, i, unnest(range(i + 1, len(ws) + 1)) AS j FROM (SELECT row_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)) WHERE ws[i] = ws[j]),
m AS (SELECT row_id, max(n) AS longest FROM (SELECT row_id, count(*) AS n FROM e GROUP BY row_id, j - i, run) GROUP BY row_id)"""
_SPREAD = f"""WITH t AS (SELECT video_id, caption AS text FROM (SELECT sen_id, min(video_id) AS video_id, min(caption) AS caption FROM sentences WHERE sen_id IS NOT NULL GROUP BY sen_id)
  UNION ALL SELECT video_id, generated_caption FROM baseline_results),
n AS (SELECT count(DISTINCT video_id) AS n FROM t),
i AS (SELECT row_number() OVER () AS text_no, video_id, text FROM t WHERE video_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT text_no, video_id, unnest(regexp_extract_all(lower(text), {W})) AS term FROM i),
f AS (SELECT video_id, term, count(*) AS tf, count(DISTINCT text_no) AS texts FROM w GROUP BY video_id, term),
s AS (SELECT term, count(*) AS records, ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf) AS h FROM f GROUP BY term),
j AS (SELECT video_id, term, tf, texts, records, greatest(0.0, 1.0 - h / ln(n)) AS weight FROM f JOIN s USING (term), n)"""
_ITEMS = f"""own AS (SELECT item_id, regexp_extract_all(lower(text), {W}) AS ws FROM eval_items WHERE item_id IS NOT NULL AND len(regexp_extract_all(lower(text), {W})) > 0),
classes AS (SELECT DISTINCT min(item_id) OVER (PARTITION BY ws) AS representative, item_id AS item, ws FROM own)"""
_LENGTHS = f"""WITH {_ITEMS}, ig AS (SELECT item, k, array_to_string(ws[k : k + 9], ' ') AS gram FROM (SELECT item, ws, unnest(range(1, len(ws) - 8)) AS k FROM classes WHERE item = representative AND len(ws) >= 10)),
dg AS (SELECT doc_id, k, array_to_string(ws[k : k + 9], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 8)) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), {W}) AS ws FROM documents WHERE text IS NOT NULL) WHERE len(ws) >= 10)),
met AS (SELECT doc_id, item, dg.k - ig.k AS apart, dg.k - row_number() OVER (PARTITION BY doc_id, item, dg.k - ig.k ORDER BY dg.k) AS run FROM dg JOIN ig USING (gram))
SELECT doc_id, item AS item_id, CAST(count(*) + 9 AS INTEGER) AS n_words FROM met GROUP BY doc_id, item, apart, run"""
_LEAKS = f"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), {W}) AS ws FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(ws[k : k + 9], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS k FROM i WHERE len(ws) >= 10)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), {W}) AS ws FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(ws[k : k + 9], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 8)) AS k FROM d WHERE len(ws) >= 10))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram)"""

SQL = {
    "p1_found": f"{_TERMS} SELECT term, mark FROM (SELECT term, {_MARK} AS mark FROM t) WHERE mark <> 'kept'",
    "p1_terms": f"{_TERMS} SELECT term, cf, df, {_MARK} AS mark FROM t",
    "p1_ngrams": f"{_NGRAMS} SELECT term, CAST(n AS INTEGER) AS n, cf, df, {_MARK} AS mark FROM t",
    "p2_exact": _EXACT,
    "p3_ranking": _RANKING,
    "p3_configurations": _CONFIGURATIONS,
    "p4_found": f"{_RECORDS} SELECT keep_id, rec_id AS copy_id FROM g WHERE rec_id <> keep_id",
    "p4_records": f"{_RECORDS} SELECT keep_id, count(*) AS copies FROM g GROUP BY keep_id",
    "p5_found": f"{_REPEATS} SELECT row_id FROM w JOIN c USING (row_id) WHERE len(ws) >= 12 AND 10 * repeated >= 3 * len(ws)",
    "p5_repetition": f"{_REPEATS}, {_LONGEST} SELECT row_id, len(ws) AS n_words, coalesce(repeated, 0) AS repeated_words, coalesce(repeated, 0) / greatest(1, len(ws)) AS repeated_share, coalesce(longest, 0) AS longest_repeat FROM w LEFT JOIN c USING (row_id) LEFT JOIN m USING (row_id)",
    "p6_found": f"{_SPREAD} SELECT video_id, term FROM j WHERE texts >= 4 AND records BETWEEN 2 AND 6",
    "p6_scores": f"{_SPREAD} SELECT video_id, term, tf, texts, records, round(weight, 6) AS weight, round(ln(1 + tf) * weight, 6) AS score FROM j",
    "p9_found": _LEAKS,
    "p9_classes": f"WITH {_ITEMS} SELECT representative, item FROM classes",
    "p9_lengths": _LENGTHS,
}
