"""Every registered core query against its SQL on the smallest test data; streams against their tables."""

import math
import time
from pathlib import Path

import duckdb
import pytest
from framesieve.operators import select
from framesieve.plans import catalog
from framesieve.streaming import selectors


def cell(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else float(f"{x:.8g}")
    return x


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, data, con, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalog.SQL:
        table = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.SQL[name]})")
        assert got == sorted((tuple(map(cell, r)) for r in table.fetchall()), key=repr)
    else:
        assert got


@pytest.mark.parametrize("name", ["cider_each", "bleu_each", "rouge_l_each", "rouge_meteor", "rouge_meteor_stems", "all_metrics", "refs_semi_join_each"])
def test_every_row_is_scored(spark, data, con, name):
    rows = con.sql("SELECT row_id FROM baseline_results WHERE video_id IN (SELECT min(video_id) FROM sentences WHERE sen_id IS NOT NULL GROUP BY sen_id HAVING trim(min(caption)) <> '')").fetchall()
    assert sorted(r.id for r in catalog.QUERIES[name](spark, data).collect()) == sorted(r for (r,) in rows)


@pytest.mark.parametrize("name", ["cider", "bleu", "rouge_l"])
def test_rows_score_as_their_captions(spark, data, con, name):
    """A video's last row has the score that the SQL gives the video."""
    own = {r.id: r for r in catalog.QUERIES[f"{name}_each"](spark, data).collect()}
    last = dict(con.sql("SELECT video_id, max(row_id) FROM baseline_results WHERE video_id IS NOT NULL AND trim(generated_caption) <> '' GROUP BY video_id").fetchall())
    table = con.sql(catalog.SQL[name])
    for video, *scores in table.fetchall():
        for c, x in zip(table.columns[1:], scores, strict=True):
            assert abs(own[last[video]][c] - x) < 2e-6


def test_changes_of_large_labels(spark, tmp_path):
    """A label keeps all its changes; the cap of a video holds where it is asked for."""
    up = [float(x) for x in range(64)]
    spark.createDataFrame([(k, 7, up if k % 2 else up[::-1]) for k in range(2100)], "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([("video8", 30.0, 90)], "video_id string, fps double, total_frames bigint").write.parquet(str(tmp_path / "videos.parquet"))
    assert sorted(r.vec_id for r in catalog.QUERIES["change_filter_chain"](spark, str(tmp_path)).collect()) == list(range(2100))
    filled = catalog.QUERIES["change_filter_fallback"](spark, str(tmp_path))
    assert filled.filter("not fallback_used").count() == 2100 and filled.filter("fallback_used").count() == 3
    table = spark.range(2100).selectExpr("'v' AS video_id", "id AS frame_idx", "CASE WHEN id % 2 = 0 THEN 0L ELSE -1L END AS hash")
    assert sorted(r.frame_idx for r in select.changes(table).collect()) == list(range(select.CANDIDATES))
    assert select.changes(table, most=None).count() == 2100


@pytest.mark.parametrize(("most", "ttl_ms"), [(None, None), (7, None), (None, 3_600_000)])
def test_streamed_changes(spark, tmp_path, most, ttl_ms):
    """Two batches of a stream keep what one table keeps, a cap on the rows of a key included."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    table = spark.range(200).selectExpr("concat('v', id % 3) as video_id", "id as frame_idx", "xxhash64(id div 5) as hash")
    for k in (0, 1):
        table.filter(f"frame_idx >= {100 * k} and frame_idx < {100 * k + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = selectors.stream_changes(stream, 20, most=most, ttl_ms=ttl_ms)
    writer = kept.writeStream.outputMode("append").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp"))
    want = sorted((r.video_id, r.frame_idx) for r in select.changes(table, 20, most=most).collect())
    q = (writer if ttl_ms else writer.trigger(availableNow=True)).start()
    try:
        if ttl_ms:  # a query with timers goes on without data
            until = time.monotonic() + 60
            while time.monotonic() < until and spark.sql("select * from kept").count() < len(want):
                time.sleep(1)
        else:
            assert q.awaitTermination(120)
    finally:
        q.stop()
    assert sorted((r.video_id, r.frame_idx) for r in spark.sql("select * from kept").collect()) == want and len(want) > 3


def test_streamed_windows(spark, data, tmp_path):
    """Closed windows of a stream are those of the table."""
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = selectors.windowed(stream, "ts", "event_type", "value", "1 day").writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {tuple(r)[:3] for r in spark.sql("select * from days").collect()}
    assert got and got <= {tuple(r)[:3] for r in selectors.windowed(events, "ts", "event_type", "value", "1 day").collect()}
