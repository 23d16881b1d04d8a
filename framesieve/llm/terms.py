"""Problem 1: how often every term (word n-gram) occurs, and in how many records.

Suffix-sorted counting: every position of a record gives the suffix that starts there, cut to sigma words. Equal
suffixes of a block of records are merged before the shuffle, suffixes are routed by their first word, sorted in
reverse lexicographic order, and one pass with a stack sums the counts of all their prefixes.

The stack has to count distinct records of a prefix without carrying record sets, which for a common word would be
as large as the collection. A record never spans two blocks, so within a block each occurrence is marked, for each
prefix length, when it is the first of that prefix in its record. Record counts are then sums of marks: they add up
along the suffix order and across blocks, and stay exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_words
from ..session import stored

#: A first word with a larger share of a block's suffixes than this is spread over SALTS tasks by its second word.
HOT_SHARE, SALTS = 1 / 64, 16


def block_suffixes(records: list[list[str]], sigma: int) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes of a block, their counts, marks of new records by prefix length, and the salts."""
    vocabulary: dict[str, int] = {}
    token = np.array([vocabulary.setdefault(w, len(vocabulary)) for r in records for w in r], dtype=np.int64)
    if not len(token):
        return [], np.zeros(0, np.int64), np.zeros((0, sigma), np.int64), np.zeros(0, np.int32)
    lengths = np.array([len(r) for r in records], dtype=np.int64)
    record = np.repeat(np.arange(len(records)), lengths)
    names = np.array(list(vocabulary), dtype=object)
    matrix = np.full((len(token), sigma), -1, dtype=np.int64)
    for k in range(min(sigma, len(token))):
        inside = record[: len(token) - k] == record[k:]
        matrix[: len(token) - k, k][inside] = token[k:][inside]
    prefix = np.zeros(len(token), dtype=np.int64)
    marks = np.zeros((len(token), sigma), dtype=np.int64)
    for k in range(sigma):
        there = matrix[:, k] >= 0
        prefix = np.unique(prefix * (len(names) + 1) + matrix[:, k] + 1, return_inverse=True)[1]
        first = np.unique(prefix * len(records) + record, return_index=True)[1]
        marks[first, k] = 1
        marks[~there, k] = 0
    _, at, group = np.unique(prefix, return_index=True, return_inverse=True)
    count = np.bincount(group, minlength=len(at))
    new = np.stack([np.bincount(group, weights=marks[:, k], minlength=len(at)) for k in range(sigma)], axis=1).astype(np.int64)
    hot = np.bincount(token, minlength=len(names)) > max(1, HOT_SHARE * len(token))
    second = matrix[at, 1] if sigma > 1 else np.full(len(at), -1)
    salt_of = np.array([zlib.crc32(w.encode()) % SALTS for w in names] + [0], dtype=np.int32)
    salt = np.where(hot[matrix[at, 0]], salt_of[second], 0).astype(np.int32)
    suffixes = [[names[x] for x in row if x >= 0] for row in matrix[at]]
    return suffixes, count, new, salt


SUFFIX_SCHEMA = "suffix array<string>, cf bigint, marks array<bigint>, salt int"
_SUFFIX_ARROW = pa.schema([("suffix", pa.list_(pa.string())), ("cf", pa.int64()), ("marks", pa.list_(pa.int64())), ("salt", pa.int32())])


def _map_suffixes(sigma: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            suffixes, count, new, salt = block_suffixes([py_words(t) for t in batch.column(0).to_pylist()], sigma)
            yield pa.RecordBatch.from_arrays([pa.array([[]], pa.list_(pa.string())), pa.array([batch.num_rows]), pa.array([[batch.num_rows]], pa.list_(pa.int64())), pa.array([0], pa.int32())], schema=_SUFFIX_ARROW)
            if suffixes:
                yield pa.RecordBatch.from_arrays([pa.array(suffixes, pa.list_(pa.string())), pa.array(count), pa.array(new.tolist(), pa.list_(pa.int64())), pa.array(salt)], schema=_SUFFIX_ARROW)

    return run


class PrefixStack:
    """Suffixes come in reverse lexicographic order; a prefix is given out when the next suffix no longer has it."""

    def __init__(self) -> None:
        self.path: list[str] = []
        self.counts: list[list[int]] = []

    def push(self, suffix: list[str], cf: int, marks: list[int]) -> Iterator[tuple[list[str], int, int]]:
        if not suffix:  # the empty prefix, which every record has
            yield [], cf, sum(marks)
            return
        shared = 0
        while shared < min(len(suffix), len(self.path)) and suffix[shared] == self.path[shared]:
            shared += 1
        yield from self.pop(shared)
        for k in range(shared, len(suffix)):
            self.path.append(suffix[k])
            self.counts.append([0, 0])
        self.counts[-1][0] += cf
        for k, mark in enumerate(marks[: len(suffix)]):
            self.counts[k][1] += mark

    def pop(self, depth: int = 0) -> Iterator[tuple[list[str], int, int]]:
        while len(self.path) > depth:
            cf, records = self.counts.pop()
            yield list(self.path), cf, records
            self.path.pop()
            if self.counts:
                self.counts[-1][0] += cf


def _stack_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack = PrefixStack()

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([" ".join(r[0]) for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["term", "n", "cf", "df"])

    for batch in batches:
        rows: list = []
        for suffix, cf, marks in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            rows.extend(stack.push(suffix, cf, marks))
        yield out(rows)
    yield out(list(stack.pop()))


def term_counts(df: DataFrame, text_col: str, sigma: int = 1) -> tuple[DataFrame, int]:
    """(counts, number of records): counts of every word n-gram of up to sigma words, (term, n, cf, df), terms joined by single spaces.

    Each row of df is one record: cf counts occurrences, df the records with at least one. Null, empty and wordless
    texts give no terms, but count as records; the one pass over df counts both. Equal records
    count separately. An empty table gives no rows and 0 records. Other columns of df are ignored, whatever their names."""
    if sigma < 1:
        raise ValueError("sigma must be at least 1")
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    suffixes = texts.mapInArrow(_map_suffixes(sigma), SUFFIX_SCHEMA)
    routed = suffixes.withColumn("head", F.xxhash64(F.get("suffix", F.lit(0)), "salt")).repartition("head")
    prefixes = routed.sortWithinPartitions(F.col("suffix").desc()).select("suffix", "cf", "marks").mapInArrow(_stack_prefixes, "term string, n int, cf bigint, df bigint")
    # A first word that was spread, or that was hot in some blocks only, comes from several tasks.
    counts = stored(prefixes.groupBy("term", "n").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")), "terms")
    return counts.filter("n > 0"), counts.filter("n = 0").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]


def marked_terms(counts: DataFrame, n_records: int, rare_df: int = 2, common_share: float = 0.09) -> DataFrame:
    """Adds mark: `rare` in at most rare_df records, `common` in more than common_share of all, else `kept`.

    A term that is both (in very small collections) is `rare`."""
    mark = F.when(F.col("df") <= rare_df, "rare").when(F.col("df") > F.lit(float(common_share)) * F.lit(int(n_records)), "common").otherwise("kept")
    return counts.withColumn("mark", mark)
