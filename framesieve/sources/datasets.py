"""Sources: caption datasets, saved runs, frame-selection records and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BASELINE, FRAME_SELECTION, RESULTS

#: Field names by which datasets give video ids and captions.
ID_FIELDS = ("video_id", "id", "vid_id")
CAPTION_FIELDS = ("caption", "text", "description", "sentence")
#: Further names that other datasets use; they count only where none of the above is there.
MORE_ID_FIELDS = ("video", "videoid", "clip_id")
MORE_CAPTION_FIELDS = ("captions",)


def dataset_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(videos, references) of a dataset file with arrays `videos` and `sentences`.

    Ids and captions are trimmed, empty ones are left out. Videos without captions are left out, the first mention of a video
    stands; ref_no is the place of a caption in the file."""
    raw = spark.read.schema("videos array<struct<video_id: string>>, sentences array<struct<video_id: string, caption: string, sen_id: bigint>>").json(path, multiLine=True)
    told = raw.select(F.posexplode("sentences").alias("at", "s")).select(F.trim("s.video_id").alias("video_id"), F.trim("s.caption").alias("caption"), F.col("at").cast("bigint").alias("ref_no")).filter("video_id <> '' and caption <> ''")
    listed = raw.select(F.posexplode("videos").alias("at", "v")).select(F.trim("v.video_id").alias("video_id"), "at").filter("video_id <> ''")
    first = listed.withColumn("nth", F.row_number().over(W.partitionBy("video_id").orderBy("at"))).filter("nth = 1").select("video_id", "at")
    return first.join(told.select("video_id").distinct(), "video_id", "left_semi"), told.select("video_id", "ref_no", "caption")


def shuffled(videos: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n videos in a seeded order, the same on every engine. limit is the feature: so many videos are asked for."""
    return videos.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), "video_id"))).orderBy("place", "video_id").limit(n).drop("place")


def detect_fields(columns: list[str]) -> tuple[str, str]:
    """The id and the caption column: the first in the table's own order that has a known name, else the first with one of the further names."""
    found = []
    for kind, known, more in (("id", ID_FIELDS, MORE_ID_FIELDS), ("caption", CAPTION_FIELDS, MORE_CAPTION_FIELDS)):
        name = next((c for names in (known, more) for c in columns if c.lower() in names), None)
        if name is None:
            raise ValueError(f"no {kind} column among {columns}")
        found.append(name)
    return found[0], found[1]


def reference_captions(splits: list[DataFrame]) -> DataFrame:
    """(video_id, caption) of all splits; a caption column may hold one text or a list. Trimmed, without empty ones."""
    parts = []
    for split in splits:
        id_col, caption_col = detect_fields(split.columns)
        kind = split.schema[caption_col].dataType.typeName()
        captions = F.explode(caption_col) if kind == "array" else F.col(caption_col)
        parts.append(split.select(F.trim(F.col(id_col).cast("string")).alias("video_id"), captions.alias("caption")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("video_id", F.trim("caption").alias("caption")).filter("video_id <> '' and caption <> ''")


def runs_csv(spark: SparkSession, path: str, baseline: bool = False) -> DataFrame:
    """Saved runs by a glob; files whose name has `combined` in it are results of earlier unions and left out. The schema is fixed, not inferred."""
    rows = spark.read.schema(BASELINE if baseline else RESULTS).csv(path, header=True, enforceSchema=False, nanValue="nan")
    return rows.filter(~F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).contains("combined"))


def frame_selections(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable files) of a folder of JSON objects; records have their file's name for an order."""
    rows = spark.read.schema(FRAME_SELECTION + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt").option("mode", "PERMISSIVE").json(folder, multiLine=True)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    # A record without its sampler's name is of no use either; Spark wants another column than the corrupt text to be read.
    bad = F.col("corrupt").isNotNull() | F.col("sampler").isNull()
    return rows.filter(~bad).drop("corrupt"), rows.filter(bad).select("file")


def archive_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(archive, name, data) of the members of zip files with a suffix; folders in names are cut off. A broken archive has one row with no name."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for member in z.namelist():
                            if member.lower().endswith(suffix):
                                yield pd.DataFrame({"archive": [archive], "name": [member.rsplit("/", 1)[-1]], "data": [z.read(member)]})
                except zipfile.BadZipFile:
                    yield pd.DataFrame({"archive": [archive], "name": [None], "data": [None]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, data binary")


def video_files(spark: SparkSession, folder: str, suffix: str = ".mp4") -> DataFrame:
    """(video_id, video_path) of the files of a folder and those below; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("video_id"), F.col("path").alias("video_path"))


def acquired(files: DataFrame, least: int = 10) -> bool:
    """Whether there are files enough that nothing has to be fetched; no more of them are counted than that."""
    return files.limit(least).count() >= least


def with_files(videos: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(videos with their files, videos whose file is missing)."""
    return videos.join(files, "video_id"), videos.join(files.select("video_id"), "video_id", "left_anti")
