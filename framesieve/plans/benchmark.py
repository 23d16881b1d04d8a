"""The whole benchmark as one chain of tables: select, caption, aggregate, score, assemble, summarise.

Where a program would loop over samplers, aggregators, modes and videos, each stage here is one table for all of them.
Captions and scores are written to the shared folder: what costs model calls is made once, and survives lost executors.

run() goes from frames to the report, combine_runs() from saved runs to the report, baseline() asks one model about whole videos."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import image, text
from ..operators import combine, infer, runs, score, select, stats
from ..schema import BASELINE, names
from ..session import stored
from ..sources import sinks

KEYS = ["video_id", "sampling_method", "aggregation_method", "caption_mode"]
#: The columns of resources in result rows, and the modes that need no answer model.
RESOURCES = ["peak_vram_mb", "peak_ram_delta_mb", "gpu_utilization_pct"]
DIRECT_MODE = "vlm_only"


@dataclass
class Models:
    """Loaders, each called once a worker, and the names (with revision) that tell models apart. A missing answer model leaves its modes with placeholders."""

    caption: Callable[[], Callable[[list], list]]
    answer: Callable[[], Callable[[list], list]] | None = None
    batch: int = 4
    embed: Callable[[DataFrame], DataFrame] | None = None
    caption_name: str | None = None
    answer_name: str | None = None


@dataclass
class Outcome:
    """Result rows, statistics, the list of what was skipped, selection records, and the report."""

    rows: DataFrame
    statistics: DataFrame
    skipped: DataFrame
    selections: DataFrame
    report: str


def selected_frames(videos: DataFrame, frames: DataFrame, samplers: list[str], embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected, meta) of all samplers: (video_id, sampling_method, frame_idx) and a row of meta data for each video and sampler that has them.

    videos has fps and total_frames. Unknown samplers are left out. Frames are measured once for all samplers that look at pixels."""
    known = select.samplers(samplers)
    chosen = [s for s in dict.fromkeys(samplers) if s in known]
    looking = [s for s in chosen if s not in ("fps1", "fps2", "random")]
    measured = stored(image.measured_frames(frames), "measured") if looking else None
    there = frames.select("video_id", "frame_idx")
    parts, metas = [], []
    for s in chosen:
        if s in looking:
            found, meta = known[s](measured, videos) if s == "phash" else known[s](measured, videos, embed)
        else:
            found, meta = known[s](videos).join(there, ["video_id", "frame_idx"], "left_semi"), None
            if s == "random":  # the one of these that reports on itself
                counts = found.groupBy("video_id").agg(F.count("*").alias("vlm_calls"))
                meta = videos.select("video_id", F.coalesce("total_frames", F.lit(0)).alias("frames_original")).join(counts, "video_id", "left").fillna(0, ["vlm_calls"]).withColumns({"candidate_pool_size": F.col("vlm_calls"), "frames_degenerate_dropped": F.lit(0).cast("bigint"), "tass_stopped_early": F.lit(False), "fallback_used": F.lit(False)})
        parts.append(found.select("video_id", F.lit(s).alias("sampling_method"), "frame_idx"))
        if meta is not None:
            metas.append(meta.select("video_id", F.lit(s).alias("sampling_method"), "frames_original", "candidate_pool_size", "frames_degenerate_dropped", "tass_stopped_early", "vlm_calls", "fallback_used"))
    if not parts:
        raise ValueError(f"none of {samplers} is a sampler")
    none = "video_id string, sampling_method string, frames_original bigint, candidate_pool_size bigint, frames_degenerate_dropped bigint, tass_stopped_early boolean, vlm_calls bigint, fallback_used boolean"
    return stored(runs.union_runs(parts), "selected"), stored(runs.union_runs(metas) if metas else frames.sparkSession.createDataFrame([], none), "meta")


def frame_captions(selected: DataFrame, frames: DataFrame, models: Models) -> tuple[DataFrame, DataFrame]:
    """(captions, skipped): one caption for each selected frame (video_id, sampling_method, frame_idx); a frame chosen by several samplers is captioned once."""
    wanted = selected.select("video_id", "frame_idx").distinct()
    told = infer.captioned(frames.join(wanted, ["video_id", "frame_idx"]), "data", models.caption, batch=models.batch, model=models.caption_name).select("video_id", "frame_idx", "caption", "error", "seconds")
    good, skipped = infer.succeeded(stored(told, "frame-captions"))  # models are not called again by later stages
    return selected.join(good, ["video_id", "frame_idx"]), skipped


def aggregated(captions: DataFrame, aggregators: list[str]) -> DataFrame:
    """(video_id, sampling_method, aggregation_method, n_captions, caption) by each aggregator; unknown names are left out."""
    keyed = captions.withColumn("unit", F.struct("video_id", "sampling_method"))
    parts = [combine.AGGREGATORS[a](keyed, "unit", "frame_idx", "caption").select("unit.video_id", "unit.sampling_method", F.lit(a).alias("aggregation_method"), "n_captions", "caption") for a in aggregators if a in combine.AGGREGATORS]
    if not parts:
        raise ValueError(f"none of {aggregators} is an aggregator")
    return runs.union_runs(parts)


def finished(combined: DataFrame, modes: list[str], transcripts: DataFrame | None, models: Models) -> DataFrame:
    """Final captions of each mode, with the seconds of the answer; prompts go to the answer model, captions of vlm_only stay as they are."""
    rows = combined.withColumn("caption_mode", F.explode(F.array(*map(F.lit, dict.fromkeys(modes)))))
    rows = rows.join(transcripts.select("video_id", "transcript"), "video_id", "left") if transcripts is not None else rows.withColumn("transcript", F.lit(""))
    rows = rows.withColumn("prompt", text.final_prompt("caption", "n_captions", "transcript", "caption_mode")).drop("caption", "transcript")
    direct, asked = (rows.filter(F.col("caption_mode") == DIRECT_MODE), rows.filter(F.col("caption_mode") != DIRECT_MODE))
    none = {"answer": F.lit(None).cast("string"), "seconds": F.lit(0.0)}
    answers = infer.captioned(asked, "prompt", models.answer, output="answer", placeholder=text.NO_ANSWER, model=models.answer_name).drop("error") if models.answer else asked.withColumns(none)
    both = direct.withColumns(none).unionByName(answers)
    return stored(both.withColumn("caption", text.final_caption("prompt", "answer", "caption_mode")).drop("prompt", "answer"), "final-captions")


def scored(final: DataFrame, references: DataFrame, corpus: DataFrame, stems: bool = True) -> DataFrame:
    """Metrics of each (video_id, sampling_method, aggregation_method, caption_mode), against the references of its video."""
    own = final.select(*KEYS, "caption").withColumn("id", F.concat_ws("\x1f", *KEYS))
    idf = score.document_frequency(corpus, "video_id", "caption")
    refs = references.select(F.col("video_id").alias("id"), "ref_no", "caption")
    found = score.all_metrics(refs, own.select("id", F.col("video_id").alias("of"), "caption"), idf, stems)
    return stored(own.select("id", *KEYS).join(found, "id").drop("id"), "scores")


def telemetry(selected: DataFrame, captions: DataFrame, final: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """(the four keys, frames_selected, processing_time_s, resources): the seconds models took for the frames of a video and sampler, and for the answer.

    resources has (*KEYS, RESOURCES) of a caller that samples them; without it they are 0.0."""
    unit = ["video_id", "sampling_method"]
    counts = selected.groupBy(*unit).agg(F.count("*").alias("frames_selected"))
    spent = captions.groupBy(*unit).agg(F.sum("seconds").alias("spent"))
    rows = final.select(*KEYS, "seconds").join(counts, unit).join(spent, unit, "left").withColumn("processing_time_s", F.coalesce("spent", F.lit(0.0)) + F.coalesce("seconds", F.lit(0.0))).drop("spent", "seconds")
    if resources is not None:
        rows = rows.join(resources.select(*KEYS, *RESOURCES), KEYS, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) if resources is not None else F.lit(0.0) for c in RESOURCES})


def summary(rows: DataFrame) -> DataFrame:
    """Statistics of result rows by configuration."""
    return stats.grouped_statistics(rows)


def _skipped(videos: DataFrame, frames: DataFrame, failed: DataFrame, selected: DataFrame, captions: DataFrame) -> DataFrame:
    """(video_id, sampling_method, reason): videos without frames, whose sampler is null, and videos of which a sampler has no caption."""
    absent = videos.select("video_id").join(frames.select("video_id").distinct(), "video_id", "left_anti").select("video_id", F.lit(None).cast("string").alias("sampling_method"), F.lit("no frames").alias("reason"))
    unit = ["video_id", "sampling_method"]
    bare = selected.select(*unit).distinct().join(captions.select(*unit).distinct(), unit, "left_anti")
    why = failed.groupBy("video_id").agg(F.min("error").alias("error"))
    lost = F.when(F.col("error").startswith(infer.LOST), F.lit("model lost")).otherwise(F.coalesce("error", F.lit("no caption")))
    return absent.unionByName(bare.join(why, "video_id", "left").select(*unit, lost.alias("reason")))


def run(videos: DataFrame, frames: DataFrame, references: DataFrame, models: Models, samplers: list[str], aggregators: list[str], modes: list[str], corpus: DataFrame | None = None, transcripts: DataFrame | None = None, resources: DataFrame | None = None, info: dict[str, Any] | None = None, out: str | None = None) -> Outcome:
    """Frames to report: every sampler, aggregator and mode for every video, in one chain.

    videos (video_id, fps, total_frames), frames (video_id, frame_idx, height, width, n_channels, data), references (video_id, ref_no, caption); corpus is what
    IDF is taken from, the references by default. A model that is lost ends its worker's calls; what was captioned before is scored and reported all the
    same, and the rest is in `skipped`. With `out`, rows, statistics, captions, selections, skipped and the report are written there."""
    selected, meta = selected_frames(videos, frames, samplers, models.embed)
    captions, failed = frame_captions(selected, frames, models)
    captions = stored(captions, "captions")
    final = finished(aggregated(captions, aggregators), modes, transcripts, models)
    scores = scored(final, references, references if corpus is None else corpus)
    rows = stored(runs.assembled(final, telemetry(selected, captions, final, resources), scores, meta), "rows")
    statistics = summary(rows)
    skipped = _skipped(videos, frames, failed, selected, captions)
    # Interval samplers don't say how many frames there were; saved records of a video's other samplers do.
    silent = videos.select("video_id", F.lit(None).cast("bigint").alias("frames_original"), F.lit(False).alias("fallback_used"))
    of = lambda df, s: df.filter(F.col("sampling_method") == s)
    records = runs.union_runs([runs.selection_records(of(selected, s), silent if s in ("fps1", "fps2") else of(meta, s), s) for s in select.samplers(samplers) if s in samplers])
    facts = sinks.metadata("", rows.select("video_id").distinct().count(), "") | (info or {})
    written = sinks.report(statistics, facts) if not rows.isEmpty() else ""
    if out:
        sinks.write_results(rows, f"{out}/csv/results", "csv")
        statistics.write.mode("overwrite").option("header", "true").csv(f"{out}/csv/statistics_summary")
        truth = references.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ref_no", "caption"))), lambda x: x["caption"]).alias("ground_truth"))
        sinks.write_captions(final.join(truth, "video_id", "left").select("video_id", F.col("sampling_method").alias("method"), F.col("aggregation_method").alias("aggregation"), F.col("caption_mode").alias("mode"), F.col("caption").alias("generated_caption"), "ground_truth"), f"{out}/captions")
        sinks.write_selections(records, f"{out}/frame_selection")
        skipped.write.mode("overwrite").json(f"{out}/skipped")
        sinks.write_text(frames.sparkSession, f"{out}/reports/benchmark_summary.md", written)
    return Outcome(rows, statistics, skipped, records, written)


def combine_runs(parts: list[DataFrame], info: dict[str, Any] | None = None, out: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(rows, statistics, report) of saved runs together; no row is removed. The number of videos in the report counts distinct ids, null as one."""
    rows = stored(runs.union_runs(parts), "combined")
    statistics = summary(rows)
    facts = (info or {}) | {"date": COMBINED, "videos": runs.distinct_videos(rows).first().videos}
    written = sinks.report(statistics, facts)
    if out:
        sinks.write_results(rows, f"{out}/csv/combined_results", "csv")
        statistics.write.mode("overwrite").option("header", "true").csv(f"{out}/csv/combined_statistics_summary")
        sinks.write_text(rows.sparkSession, f"{out}/reports/combined_benchmark_summary.md", written)
    return rows, statistics, written


#: Fixed value: the date of a report of combined runs.
COMBINED = "Combined Run (All 5 Samplers)"


def baseline(videos: DataFrame, frames: DataFrame, references: DataFrame, load: Callable[[], Callable[[list], str]], n_frames: int = 16, corpus: DataFrame | None = None, resources: DataFrame | None = None, model: str | None = None, encode: Callable | None = None, out: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, skipped, statistics) of one model that is shown n_frames evenly spaced frames of each video.

    The model takes a list of frames in base64 and gives a sentence. A video without frames, or whose every budget failed, is skipped. With `out`, rows, statistics and
    caption records are written there."""
    places = select.uniform_indices(videos, n_frames)
    wanted = places.select("video_id", "frame_idx").distinct()
    chosen = frames.join(wanted, ["video_id", "frame_idx"], "left_semi")
    images = infer.encoded_frames(chosen, encode) if encode else infer.encoded_frames(chosen)
    told = stored(infer.answered(places.join(images, ["video_id", "frame_idx"], "left"), load, model=model), "answers")
    good = told.filter("error is null").drop("error")
    idf = score.document_frequency(references if corpus is None else corpus, "video_id", "caption")
    scores = score.all_metrics(references.select(F.col("video_id").alias("id"), "ref_no", "caption"), good.select(F.col("video_id").alias("id"), F.col("generated_caption").alias("caption")), idf, stems=True)
    rows = good.join(scores.withColumnRenamed("id", "video_id"), "video_id", "left").fillna(0.0, runs.SCORES)
    rows = rows.join(resources.select("video_id", *RESOURCES), "video_id", "left") if resources is not None else rows
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) if resources is not None else F.lit(0.0) for c in RESOURCES})
    rows = stored(runs.baseline_rows(rows).select(*names(BASELINE)), "baseline")
    absent = videos.select("video_id").join(told.select("video_id"), "video_id", "left_anti").select("video_id", F.lit("no frames").alias("reason"))
    skipped = told.filter("error is not null").select("video_id", F.col("error").alias("reason")).unionByName(absent)
    statistics = summary(rows)
    if out:
        rows.write.mode("overwrite").option("header", "true").csv(f"{out}/csv/results")
        statistics.write.mode("overwrite").option("header", "true").csv(f"{out}/csv/statistics_summary")
        truth = references.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ref_no", "caption"))), lambda x: x["caption"]).alias("reference"))
        sinks.write_baseline_captions(rows.join(truth, "video_id", "left").select("video_id", F.col("sampling_method").alias("method"), F.col("generated_caption").alias("generated"), "reference"), f"{out}/captions")
    return rows, skipped, statistics
