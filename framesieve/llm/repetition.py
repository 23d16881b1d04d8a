"""Problem 5: repetition inside a single document.

The words of a batch of documents form one array; its suffix array is built by prefix doubling, where the document
belongs to the first rank, so that suffixes of different documents never compare as equal. Ranks of all rounds give
the longest common prefixes of neighbours. An interval of suffixes whose neighbours share at least `width` words is a
repeated substring; each of its starts but the earliest is a repetition, and the spans of all of them are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_words

#: Words of texts that are put into one suffix array; a longer text has one of its own.
TOGETHER = 1 << 18


def repeated(documents: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, of repeated words, and the longest repeat in words, of each document."""
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    covered, longest = np.zeros(len(documents), np.int64), np.zeros(len(documents), np.int64)
    vocabulary: dict[str, int] = {}
    token = np.array([vocabulary.setdefault(w, len(vocabulary)) for d in documents for w in d], dtype=np.int64)
    size = len(token)
    if not size:
        return lengths, covered, longest
    doc = np.repeat(np.arange(len(documents)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(size)  # words up to the document's end
    ranks = [np.unique(doc * len(vocabulary) + token, return_inverse=True)[1]]
    step = 1
    while step < lengths.max() and ranks[-1].max() + 1 < size:
        ahead = np.zeros(size, dtype=np.int64)
        inside = left > step
        ahead[inside] = ranks[-1][np.flatnonzero(inside) + step] + 1
        ranks.append(np.unique(ranks[-1] * (size + 1) + ahead, return_inverse=True)[1])
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    shared = np.zeros(size - 1, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + shared, b + shared
        ok = (shared < left[a]) & (shared < left[b]) & (doc[a] == doc[b])
        same = ok.copy()
        same[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        shared[same] += 1 << k
    np.maximum.at(longest, doc[b], shared)
    interval = np.concatenate([[0], np.cumsum(shared < width)])
    first = np.full(interval[-1] + 1, size, dtype=np.int64)
    np.minimum.at(first, interval, order)
    again = order[order != first[interval]]
    edge = np.zeros(size + width + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    covered = np.bincount(doc, weights=np.cumsum(edge)[:size] > 0, minlength=len(documents)).astype(np.int64)
    return lengths, covered, longest


def groups(documents: list[list[str]], most: int) -> Iterator[list[list[str]]]:
    """The documents in order, in groups of about `most` words."""
    group, size = [], 0
    for d in documents:
        if group and size + len(d) > most:
            yield group
            group, size = [], 0
        group.append(d)
        size += len(d)
    if group:
        yield group


def repetition(df: DataFrame, id_col: str, text_col: str, width: int = 4) -> DataFrame:
    """(id_col, n_words, repeated_words, repeated_share, longest_repeat) for each row of df, equal rows included.

    A word is repeated if it lies in `width` consecutive words that also start at an earlier place of the same text;
    the first occurrence is not a repetition, overlaps count. longest_repeat is the length in words of the longest
    substring that occurs twice, whatever its length. Null, empty and wordless texts have zeros and a share of 0.0.
    Whole texts are read. Other columns of df are ignored."""
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [repeated(g, width) for g in groups([py_words(t) for t in batch.column(1).to_pylist()], TOGETHER)]
            n, covered, longest = (np.concatenate([np.zeros(0, np.int64), *(e[k] for e in each)]) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(covered), pa.array(covered / np.maximum(n, 1)), pa.array(longest)], names=[id_col, "n_words", "repeated_words", "repeated_share", "longest_repeat"])

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, repeated_words bigint, repeated_share double, longest_repeat bigint")


def looping(report: DataFrame, min_words: int = 12, share: float = 0.3, longest: int = 4) -> DataFrame:
    """Rows of repetition() with at least min_words words of which at least `share` are repeated, and a repeat of at least `longest` words; at the
    width that repetition() counts from, 4, the share includes that."""
    return report.filter((F.col("n_words") >= min_words) & (F.col("longest_repeat") >= longest) & (F.col("repeated_words") >= F.lit(share) * F.col("n_words") - F.lit(1e-9)))
