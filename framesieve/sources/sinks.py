"""Sinks: result tables, caption and selection records, caches, run metadata and the report."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..schema import RESULTS, names
from ..session import stored


def write_results(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Result rows in the fixed order of columns; columns they lack are null. form is parquet or csv."""
    fixed = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in (part.split() for part in RESULTS.split(", "))))
    fixed.write.mode("overwrite").option("header", "true").format(form).save(path)


def write_captions(rows: DataFrame, path: str) -> None:
    """Raw captions with their references as JSON, a folder a configuration; folders written again replace their old content only."""
    rows.select("video_id", "method", "aggregation", "mode", "generated_caption", "ground_truth").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "aggregation", "mode").json(path)


def write_baseline_captions(rows: DataFrame, path: str) -> None:
    """Captions of the direct model with their references as JSON records of four fields: video_id, method, generated, reference (a list)."""
    rows.select("video_id", "method", "generated", "reference").write.mode("overwrite").json(path)


def write_selections(records: DataFrame, path: str) -> None:
    """Frame-selection records as JSON, a folder a sampler; folders written again replace their old content only."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sampler").json(path)


def append_cache(rows: DataFrame, path: str) -> None:
    """Captions or transcripts that were made, for later runs."""
    rows.write.mode("append").parquet(path)


def cached(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The table at path; built and written first if it isn't there or force is set."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder.suffix("/_SUCCESS"))
    if force or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def metadata(date: str, videos: int, dataset: str, **more: Any) -> dict[str, Any]:
    return {"date": date, "videos": videos, "dataset": dataset} | more


def write_metadata(info: dict[str, Any], path: str | Path) -> None:
    Path(path).write_text(json.dumps(info, indent=2))


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A text file at a path of any file system Spark knows."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there, True)
    stream.write(bytearray(content.encode("utf-8")))
    stream.close()


#: The lines of the report. Each run gives its facts by name; facts it does not name are left empty.
REPORT_HEAD = "# Benchmark Summary\n{warning}Generated on: {date}\n\n"
REPORT_FACTS = "## Run Metadata\n- **Videos**: {videos} · **Dataset**: {dataset}\n- **GPU**: {gpu} · **CPU**: {cpu}\n- **VLM**: {vlm} · **LLM**: {llm}\n\n"
REPORT_WARNING = "> WARNING: CIDEr degenerate. Ranking on `{metric}`.\n\n"
REPORT_LINE = "- **{title}**: {sampling_method} + {aggregation_method} ({caption_mode}) — {value:.2f}{unit}\n"
REPORT_TITLES = {"best": "Best ({metric})", "fastest": "Fastest", "least_vram": "Min VRAM", "least_ram": "Min RAM"}
REPORT_UNITS = {"best": "", "fastest": "s", "least_vram": " MB", "least_ram": " MB"}
#: Configurations that a report, which the driver writes, may have.
REPORT_MOST = 10_000


def report(statistics: DataFrame, info: dict[str, Any]) -> str:
    """Markdown of a run: metadata, highlights, and the table of configurations. Its statistics are computed once; more than REPORT_MOST rows are no report but an error."""
    table = stored(statistics, "statistics")
    if table.count() > REPORT_MOST:
        raise ValueError(f"a report has at most {REPORT_MOST} configurations")
    rows = table.orderBy(*stats.KEYS).toPandas()
    if rows.empty:
        return ""
    metric = stats.ranking_metric(table)
    facts = dict.fromkeys(("date", "videos", "dataset", "gpu", "cpu", "vlm", "llm"), "") | info
    out = REPORT_HEAD.format(warning="" if metric == "cider_mean" else REPORT_WARNING.format(metric=metric), date=facts["date"]) + REPORT_FACTS.format(**facts) + "## Highlights\n"
    for r in stats.highlights(table).collect():  # four rows
        if r.value is not None:
            title = REPORT_TITLES[r.role].format(metric=metric.removesuffix("_mean").upper())
            out += REPORT_LINE.format(title=title, unit=REPORT_UNITS[r.role], **r.asDict())
    lines = ["| | " + " | ".join(rows.columns) + " |", "|---" * (len(rows.columns) + 1) + "|"]
    lines += ["| " + " | ".join(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row) + " |" for row in rows.itertuples()]
    return out + "\n## Full Results\n" + "\n".join(lines) + "\n"


#: The parts of a result row that plots and reports need.
RESULT_COLUMNS = names(RESULTS)
