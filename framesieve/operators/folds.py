"""Ordered folds: what depends on the last kept row of a key, for keys of any length.

Rows are range-partitioned by key and order, so that a long key is spread over many parts. Each part is folded by itself, as if nothing came
before it; what it ends with is then what the next part begins with, and parts for which that is news are folded again. Two
folds that have kept the same row go on alike, so news rarely gets far, and what is reached when none is left is the fold of
the whole key. A task holds the state of one key and never a group; the driver has one state a part."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

PART = "part of the fold"


def chained(df: DataFrame, keys: list[str], order: list[str], value: str, differs: Callable[[Any, Any], bool], most: int | None = None) -> DataFrame:
    """Rows that differ from the last row kept before them, within equal keys by order; the first is always kept.

    A null value is never kept and never compared with. most ends a key after so many kept rows. Null keys are a key. The columns of df stay."""
    parts = stored(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "parts")
    where = [df.columns.index(k) for k in keys]
    at, part_at = df.columns.index(value), len(df.columns)

    def fold(before: dict[int, tuple], emit: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, first, now, last, kept = None, None, object(), None, 0

            def state() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps((first, (now, last, kept)))], pa.binary())], names=["part", "state"])

            for batch in batches:
                own = zip(batch.column(part_at).to_pylist(), zip(*(batch.column(k).to_pylist() for k in where), strict=True), batch.column(at).to_pylist(), strict=True)
                take = []
                for row, (p, key, x) in enumerate(own):
                    if p != part:
                        if part is not None and not emit:
                            yield state()
                        part, first = p, key
                        now, last, kept = before.get(p, (object(), None, 0))
                    if key != now:
                        now, last, kept = key, None, 0
                    if x is None or (most is not None and kept >= most):
                        continue
                    if last is None or differs(last, x):
                        last, kept = x, kept + 1
                        take.append(row)
                if emit:
                    yield batch.select(range(part_at)).take(pa.array(take, pa.int64()))
            if part is not None and not emit:
                yield state()

        return run

    def sorted_parts(some: list[int] | None = None) -> DataFrame:
        chosen = parts if some is None else parts.filter(F.col(PART).isin(some))
        return chosen.repartition(PART).sortWithinPartitions(PART, *keys, *order)

    begins: dict[int, tuple] = {}
    ends: dict[int, tuple] = {}
    before: dict[int, tuple] = {}
    todo: list[int] | None = None
    while todo is None or todo:
        for row in sorted_parts(todo).mapInArrow(fold(before, False), "part int, state binary").collect():  # a row a part
            begins[row.part], ends[row.part] = pickle.loads(row.state)
        known = sorted(ends)
        now = {b: ends[a] for a, b in zip(known, known[1:]) if ends[a][0] == begins[b]}
        todo = [p for p, s in now.items() if before.get(p) != s]
        before = now
    return sorted_parts().mapInArrow(fold(before, True), df.schema)
