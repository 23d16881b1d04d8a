"""Experiment rows: the product of configurations, row assembly and derived columns, unions and lookups over saved runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RESULTS, names

SCORES = ["cider", "bleu1", "bleu4", "rouge_l", "meteor"]
#: Fixed labels of rows of the direct model.
BASELINE_LABELS = {"sampling_method": "qwen_vl_3b", "aggregation_method": "native", "caption_mode": "direct"}


def configurations(spark: SparkSession, samplers: list[str], aggregators: list[str], modes: list[str]) -> DataFrame:
    """Every (sampling_method, aggregation_method, caption_mode); three short lists of the configuration."""
    rows = [(s, a, m) for s in samplers for a in aggregators for m in modes]
    return spark.createDataFrame(rows, "sampling_method string, aggregation_method string, caption_mode string")


def planned(videos: DataFrame, configs: DataFrame) -> DataFrame:
    """Every video in every configuration. Configurations are a short list; each video row becomes that many, without a shuffle."""
    return videos.select("video_id").join(F.broadcast(configs))


def kept_and_pending(plan: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What the cache holds of a plan, and what is left to do. Rows of the cache that the plan doesn't ask for are ignored."""
    return plan.join(cache, keys, "inner"), plan.join(cache.select(*keys), keys, "left_anti")


def assembled(predictions: DataFrame, telemetry: DataFrame, metrics: DataFrame, meta: DataFrame, mean_calls: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Result rows of fixed columns, for predictions of (video_id and the three configuration columns).

    telemetry is joined by all four, metrics too; a missing score is 0.0. meta (video_id, sampling_method, candidate_pool_size,
    frames_degenerate_dropped, tass_stopped_early, vlm_calls) may lack rows: their yield and savings are null. Savings are against mean_calls, one row
    with the mean calls of interval sampling; compat takes 1 call instead, unless the sampler is fps1."""
    keys = ["video_id", "sampling_method", "aggregation_method", "caption_mode"]
    rows = predictions.select(*keys).join(telemetry, keys).join(metrics, keys, "left").join(meta, ["video_id", "sampling_method"], "left")
    rows = rows.withColumns({s: F.coalesce(s, F.lit(0.0)) for s in SCORES})
    if mean_calls is None:
        own = telemetry.filter("sampling_method = 'fps1'").agg(F.greatest(F.lit(1), F.coalesce(F.floor(F.avg("frames_selected")), F.lit(1))).alias("usual_calls"))
    else:
        own = mean_calls.select(F.col(mean_calls.columns[0]).alias("usual_calls"))
    rows = rows.join(F.broadcast(own))  # one row
    usual = F.when(F.lit(compat) & (F.col("sampling_method") != "fps1"), F.lit(1)).otherwise(F.col("usual_calls"))
    return with_savings(rows.withColumn("usual", usual)).select(*names(RESULTS))


def with_savings(rows: DataFrame) -> DataFrame:
    """Adds the columns that are derived from the selection's meta data: pool, dropped, calls saved in per cent, and CIDEr for each call."""
    calls = F.col("vlm_calls")
    return rows.withColumns(
        {
            "tass_candidate_pool": F.col("candidate_pool_size"),
            "tass_degenerate_dropped": F.col("frames_degenerate_dropped"),
            "vlm_calls_saved_pct": (F.col("usual") - calls) / F.col("usual") * 100.0,
            "semantic_yield": F.when(calls.isNotNull(), F.col("cider") / F.greatest(F.lit(1), calls)),
        }
    )


def calls_saved(runs: DataFrame) -> DataFrame:
    """(sampling_method, mean_calls, calls_saved_pct) against the mean frames of fps1 over all runs."""
    means = runs.filter("sampling_method is not null and frames_selected is not null").groupBy("sampling_method").agg(F.avg("frames_selected").alias("mean_calls"))
    usual = means.agg(F.max(F.when(F.col("sampling_method") == "fps1", F.col("mean_calls"))).alias("usual"))
    return means.join(F.broadcast(usual)).select("sampling_method", "mean_calls", ((F.col("usual") - F.col("mean_calls")) / F.col("usual") * 100).alias("calls_saved_pct"))  # one row


def union_runs(parts: list[DataFrame]) -> DataFrame:
    """All rows of all runs by column name, null where a run lacks a column; nothing is removed. NaN, which saved runs have for what is missing, is null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes))


def distinct_videos(runs: DataFrame) -> DataFrame:
    """One row: number of distinct video ids, where null counts as one."""
    return runs.agg((F.count_distinct("video_id") + F.coalesce(F.max(F.when(F.col("video_id").isNull(), 1)), F.lit(0))).alias("videos"))


def selection_records(selected: DataFrame, meta: DataFrame, sampler: str, threshold: float | None = None) -> DataFrame:
    """Frame-selection records: sorted indices and reduction in per cent, null where the original count is unknown or 0."""
    listed = selected.groupBy("video_id").agg(F.sort_array(F.collect_list("frame_idx")).alias("frame_indices"))  # selected frames of one video
    rows = meta.join(listed, "video_id", "left").withColumn("frame_indices", F.coalesce("frame_indices", F.array().cast("array<bigint>")))
    count = F.size("frame_indices").cast("bigint")
    reduction = F.when(F.col("frames_original") > 0, F.round((1 - count / F.col("frames_original")) * 100, 2))
    return rows.select(F.lit(sampler).alias("sampler"), "video_id", F.col("frames_original").alias("original_frame_count"), count.alias("selected_frame_count"), "frame_indices", reduction.alias("reduction_pct"), F.lit(threshold).cast("double").alias("threshold_used"), "fallback_used", F.lit(None).cast("double").alias("fps"))


def reductions(records: DataFrame, order: str | None = None) -> DataFrame:
    """(method, video_id, reduction_pct) of frame-selection records; a missing original count is taken from any other record
    of the video, the last by `order`. Records for which it stays unknown are left out."""
    order_by = F.col(order) if order else F.concat_ws("_", "video_id", "sampler")
    known = records.filter("original_frame_count > 0 and video_id is not null").groupBy("video_id").agg(F.max_by("original_frame_count", order_by).alias("known_count"))
    count = F.coalesce(F.when(F.col("original_frame_count") > 0, F.col("original_frame_count")), F.col("known_count"))
    share = F.coalesce(F.col("reduction_pct"), F.when(count > 0, F.round((1 - F.col("selected_frame_count") / count) * 100, 2)))
    return records.join(known, "video_id", "left").select(F.col("sampler").alias("method"), "video_id", share.alias("reduction_pct")).filter("reduction_pct is not null")


def baseline_rows(rows: DataFrame) -> DataFrame:
    """Rows of the direct model: fixed labels, times rounded to 4 digits, memory to 2 and use to 1."""
    out = rows.withColumns({k: F.lit(v) for k, v in BASELINE_LABELS.items()} | {"benchmark_type": F.lit("single_model")})
    return out.withColumns({"processing_time_s": F.round("processing_time_s", 4), "peak_vram_mb": F.round("peak_vram_mb", 2), "peak_ram_delta_mb": F.round("peak_ram_delta_mb", 2), "gpu_utilization_pct": F.round("gpu_utilization_pct", 1)})


def baseline_metadata(rows: DataFrame) -> DataFrame:
    """One row: videos, mean number of frames really used, and whether memory ran out for any."""
    return rows.agg(F.count_distinct("video_id").alias("videos"), F.avg("actual_frames_used").alias("mean_frames"), F.coalesce(F.bool_or("oom_fallback_triggered"), F.lit(False)).alias("any_fallback"))


def available(names_col: str, model: str) -> Column:
    """Whether a listed model is the one asked for: the same name, or either is the other with a tag behind a colon."""
    c = F.col(names_col)
    return (c == model) | c.startswith(f"{model}:") | F.lit(model).startswith(F.concat(c, F.lit(":")))


def telemetry_peaks(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Peaks above the first sample of each key, at least 0: samples have (*keys, ts, vram_mb, ram_mb, gpu_util_pct)."""
    first = {c: F.min_by(c, "ts") for c in ("vram_mb", "ram_mb")}
    peaks = samples.groupBy(*keys).agg(*(first[c].alias(f"{c}_first") for c in first), F.max("vram_mb").alias("vram_most"), F.max("ram_mb").alias("ram_most"), F.max("gpu_util_pct").alias("util_most"))
    zero = F.lit(0.0)
    return peaks.select(*keys, F.round(F.greatest(zero, F.col("vram_most") - F.col("vram_mb_first")), 2).alias("peak_vram_mb"), F.round(F.greatest(zero, F.col("ram_most") - F.col("ram_mb_first")), 2).alias("peak_ram_delta_mb"), F.round(F.greatest(zero, F.col("util_most")), 1).alias("gpu_utilization_pct"))
