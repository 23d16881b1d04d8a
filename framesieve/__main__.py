"""python -m framesieve run | combine | baseline: the entry points of plans.benchmark for the command line. Models are the caller's: module:function gives them."""

from __future__ import annotations

import argparse
import importlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .plans import benchmark
from .session import DEFAULTS, ship
from .sources import datasets, frames


def _given(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def _inputs(spark: SparkSession, args: argparse.Namespace, config: Config) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(videos, frames, references, corpus) of a dataset file and a folder of raw frames; so many videos as are asked for, in the seeded order."""
    listed, references = datasets.dataset_json(spark, args.data)
    wanted = args.videos or config.experiment.get("videos", 10)
    chosen = datasets.shuffled(listed, wanted, config.experiment.get("seed", 42)).select("video_id")
    pictures = frames.raw_frames(spark, args.frames).join(chosen, "video_id", "left_semi")
    counts = pictures.groupBy("video_id").agg(F.count("*").alias("total_frames"))
    fps = float(config.experiment.get("fps", 30.0))
    videos = chosen.join(counts, "video_id", "left").fillna(0, ["total_frames"]).select("video_id", F.lit(fps).alias("fps"), "total_frames")
    return videos, pictures, references.join(chosen, "video_id", "left_semi"), references


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="framesieve")
    modes = parser.add_subparsers(dest="what", required=True)
    for name in ("run", "baseline"):
        p = modes.add_parser(name)
        p.add_argument("--config", required=True)
        p.add_argument("--data", required=True, help="dataset file with videos and sentences")
        p.add_argument("--frames", required=True, help="folder of raw frames")
        p.add_argument("--models", required=True, help="module:function that gives Models, or the loader of the one model")
        p.add_argument("--videos", type=int)
        p.add_argument("--sampler", nargs="+")
        p.add_argument("--aggregation", nargs="+")
        p.add_argument("--output-dir", required=True)
    p = modes.add_parser("combine")
    p.add_argument("--runs", required=True, help="glob of saved results")
    p.add_argument("--output-dir", required=True)
    args = parser.parse_args(argv)
    spark = ship(SparkSession.builder.config(map=DEFAULTS).getOrCreate())
    date = datetime.now().strftime("%Y%m%d_%H%M%S")
    if args.what == "combine":
        rows, _, report = benchmark.combine_runs([datasets.runs_csv(spark, args.runs)], out=args.output_dir)
        print(report or "No results to combine.")
        return 0 if report else 1
    config = Config.load(args.config)
    videos, pictures, references, corpus = _inputs(spark, args, config)
    if args.what == "baseline":
        rows, skipped, _ = benchmark.baseline(videos, pictures, references, _load_of(args.models), corpus=corpus, model=f"{config.caption_model}@{config.caption_revision}", out=args.output_dir)
        print(f"{rows.count()} videos answered, {skipped.count()} skipped")
        return 0
    info = {"date": date, "dataset": config.experiment.get("dataset", args.data), "vlm": config.caption_model, "llm": (config.models.get("llm") or {}).get("name", "")}
    done = benchmark.run(videos, pictures, references, _given(args.models), args.sampler or config.samplers, args.aggregation or config.aggregators, config.caption_modes, corpus=corpus, info=info, out=args.output_dir)
    print(done.report or "No results generated.")
    return 0 if done.report else 1


def _load_of(name: str):
    """The loader of a model, looked up where it is called: workers import it by its name."""
    return lambda: _given(name)


if __name__ == "__main__":
    raise SystemExit(main())
