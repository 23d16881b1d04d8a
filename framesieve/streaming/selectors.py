"""Structured Streaming forms of the stateful selectors, and windowed counts with late data (an extension)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.combine import _jaccard
from ..operators.select import CANDIDATES, interval


class KeepChanged(StatefulProcessor):
    """Keeps rows that differ from the last kept row of their key, `most` of them at most. The state of a key is that value and a number; it is
    dropped when a key has had no row for `ttl_ms`, and such a key begins anew."""

    def __init__(self, key: str, order: str, value: str, kind: str, columns: list[str], differs: Callable, most: int | None, ttl_ms: int | None) -> None:
        self.key, self.order, self.value, self.kind, self.columns, self.differs = key, order, value, kind, columns, differs
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"value {self.kind}, kept bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last, kept = self.last.get() if self.last.exists() else (None, 0)
        keep = []
        for k, x in enumerate(batch[self.value]):
            if (last is not None and not self.differs(last, x)) or (self.most is not None and kept >= self.most):
                continue
            last, kept = x, kept + 1
            keep.append(k)
        if last is not None:
            self.last.update((last, kept))  # also renews the time the state has
        yield batch.iloc[keep][self.columns]

    def close(self) -> None:
        pass


def _changed(stream: DataFrame, key: str, order: str, value: str, differs: Callable, most: int | None, ttl_ms: int | None) -> DataFrame:
    stream = stream.filter(F.col(value).isNotNull())  # never kept, and as NaN it would make floats of whole numbers
    schema = stream.schema
    processor = KeepChanged(key, order, value, schema[value].dataType.simpleString(), stream.columns, differs, most, ttl_ms)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "append", "ProcessingTime" if ttl_ms else "None")


def stream_changes(stream: DataFrame, threshold: int = 1, key: str = "video_id", order: str = "frame_idx", value: str = "hash", most: int | None = CANDIDATES, ttl_ms: int | None = None) -> DataFrame:
    """changes() over a stream whose rows of a key arrive in order of frames from batch to batch. Needs the RocksDB state store."""
    return _changed(stream, key, order, value, lambda a, b: ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() > threshold, most, ttl_ms)


def stream_without_repeats(stream: DataFrame, key: str, order: str, tokens: str, threshold: float = 0.85, ttl_ms: int | None = None) -> DataFrame:
    """without_repeats() over a stream of token arrays; the state holds the tokens joined by a space."""
    joined = stream.withColumn(tokens, F.array_join(tokens, " "))
    return _changed(joined, key, order, tokens, lambda a, b: _jaccard(a.split(), b.split()) <= threshold, None, ttl_ms)


def stream_interval(stream: DataFrame, per_second: float = 1.0) -> DataFrame:
    """interval_sample() over a stream; it has no state."""
    return stream.filter(F.col("frame_idx") % interval("fps", per_second) == 0)


def windowed(events: DataFrame, ts: str, by: str, value: str, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; rows later than `late` are left out of a stream. The same expression serves a table.

    A time without zone is taken as UTC, since watermarks need a zone."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = timed.withWatermark(ts, late) if events.isStreaming else timed
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return marked.groupBy(span, by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of a key: rows less than `gap` apart."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = timed.withWatermark(ts, late) if events.isStreaming else timed
    return marked.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), by, "n")
