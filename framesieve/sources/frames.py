"""A data source for raw frames: `spark.read.format("rawframes").load(folder)`.

Each file <video_id>.npy holds a uint8 array (frames, height, width, channels). The folder may be local or any that pyarrow's file systems
open by URI (hdfs://, s3://, gs://, file://). Large files are several partitions, each a range of frames, read a few frames at a
time. A file that is no array gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import FRAMES

_ARROW = pa.schema([("video_id", pa.string()), ("frame_idx", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("n_channels", pa.int32()), ("data", pa.binary())])
#: Bytes of a file that one task reads.
PART_BYTES = 256 << 20


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder given by URI or as a local path, and the path in it."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class _Range(InputPartition):
    """Part `k` of `parts` of a file."""

    def __init__(self, path: str, k: int, parts: int) -> None:
        self.path, self.k, self.parts = path, k, parts


class RawFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> RawFramesReader:
        return RawFramesReader(self.options)


class RawFramesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.together = int(options.get("framesPerBatch", "16"))
        self.part_bytes = int(options.get("partBytes", str(PART_BYTES)))

    def partitions(self) -> list[InputPartition]:
        files, path = opened(self.folder)
        found = sorted((f for f in files.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".npy")), key=lambda f: f.path)
        return [_Range(f.path, k, parts) for f in found for parts in [max(1, -(-f.size // self.part_bytes))] for k in range(parts)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.folder)
        name = PurePosixPath(partition.path).stem
        with files.open_input_file(partition.path) as f:
            try:
                version = np.lib.format.read_magic(f)
                header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                (n, height, width, channels), by_column, kind = header(f)
            except ValueError:  # no array, or not of four dimensions
                return
            if by_column or kind != np.uint8:
                return
            begin, size = f.tell(), height * width * channels
            first, last = n * partition.k // partition.parts, n * (partition.k + 1) // partition.parts
            f.seek(begin + first * size)
            for start in range(first, last, self.together):
                k = min(self.together, last - start)
                raw = f.read(k * size)
                k = len(raw) // size  # a file that ends early has no further frames
                yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(range(start, start + k), pa.int64()), pa.array([height] * k, pa.int32()), pa.array([width] * k, pa.int32()), pa.array([channels] * k, pa.int32()), pa.array([raw[i * size : (i + 1) * size] for i in range(k)], pa.binary())], schema=_ARROW)


def raw_frames(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(RawFrames)
    return spark.read.format("rawframes").load(folder)
