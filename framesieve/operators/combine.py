"""Aggregation of a key's ordered captions into one: concatenation, chained de-duplication, medoid."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_set
from ..session import stored
from .folds import chained

#: Distinct token sets of one block of the medoid, and of one matrix product; words kept as bits, and words of a set that is compared by products.
BLOCK, CHUNK = 65536, 1024
HOT, LONG = 16, 48


def concatenated(captions: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, n_captions, caption): captions in order, joined by one space. Null captions are left out.

    The result holds the whole text of a key by its nature; only texts and places are gathered."""
    listed = captions.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))).alias("own"))
    return listed.select(key, F.size("own").cast("bigint").alias("n_captions"), F.array_join(F.transform("own", lambda x: x["t"]), " ").alias("caption"))


def _jaccard(a: list[str], b: list[str]) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a or b else 0.0


def without_repeats(captions: DataFrame, key: str, order: str, text: str, threshold: float = 0.85) -> DataFrame:
    """Rows (key, order, text) whose tokens are not nearly those of the last kept caption: its Jaccard similarity is at most threshold."""
    rows = captions.select(key, order, text).withColumn("tokens", token_set(text))
    return chained(rows, [key], [order], "tokens", lambda a, b: _jaccard(a, b) <= threshold).select(key, order, text)


def temporal(captions: DataFrame, key: str, order: str, text: str, threshold: float = 0.85) -> DataFrame:
    """(key, n_captions, caption) of the captions without_repeats() keeps."""
    return concatenated(without_repeats(captions, key, order, text, threshold), key, order, text)


def _dense(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set of a, the sum of its similarities to the sets of b, weighted by n: matrix products of chunks. Sets are numbers of words one
    after the other, and their sizes."""
    a_ends, b_ends = np.concatenate([[0], np.cumsum(a_sizes)]), np.concatenate([[0], np.cumsum(b_sizes)])
    out = np.zeros(len(a_sizes))
    for i in range(0, len(a_sizes), CHUNK):
        for j in range(0, len(b_sizes), CHUNK):
            own, other = a_sizes[i : i + CHUNK], b_sizes[j : j + CHUNK]
            codes = np.concatenate([a[a_ends[i] : a_ends[i + len(own)]], b[b_ends[j] : b_ends[j + len(other)]]])
            words, codes = np.unique(codes, return_inverse=True)
            both = np.zeros((len(own) + len(other), len(words)), dtype=np.float32)
            both[np.repeat(np.arange(len(both)), np.concatenate([own, other])), codes] = 1
            shared = (both[: len(own)] @ both[len(own) :].T).astype(np.float64)
            union = own[:, None] + other[None, :] - shared
            out[i : i + len(own)] += np.divide(shared, union, out=np.zeros_like(shared), where=union > 0) @ n[j : j + len(other)]
    return out


def _sparse(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What _dense() gives, from counts of sets by size and number of shared words. The HOT most frequent words are bits, so sets of equal bits and
    size are counted together; sets that share another word are found in its list, and move from their count to the next."""
    words, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)], codes[len(a) :]
    bit = np.zeros(len(words), dtype=np.int64)
    hot = np.argsort(-np.bincount(b, minlength=len(words)), kind="stable")[:HOT]
    bit[hot] = 1 << np.arange(len(hot))
    row = np.repeat(np.arange(len(b_sizes)), b_sizes)
    a_bits = np.bincount(np.repeat(np.arange(len(a_sizes)), a_sizes), weights=bit[a], minlength=len(a_sizes)).astype(np.int64)
    b_bits = np.bincount(row, weights=bit[b], minlength=len(b_sizes)).astype(np.int64)
    sizes, place = np.unique(b_sizes, return_inverse=True)
    width = len(sizes)
    kinds, kind = np.unique(b_bits * width + place, return_inverse=True)
    kind_bits, kind_place, kind_n = kinds // width, kinds % width, np.bincount(kind, weights=n)
    cold = bit[b] == 0
    order = np.argsort(b[cold], kind="stable")
    listed = row[cold][order]
    starts = np.searchsorted(b[cold][order], np.arange(len(words) + 1)).tolist()
    listed_kind, listed_n = kind[listed], n[listed]
    steps = np.arange(int(min(a_sizes.max(), b_sizes.max())) + 1)
    length = len(steps) * width
    ends = np.concatenate([[0], np.cumsum(a_sizes)]).tolist()
    moved = np.zeros(len(b_sizes), dtype=np.int64)
    tables: dict[int, np.ndarray] = {}
    out, last, at, counted = np.zeros(len(a_sizes)), -1, kind_place, np.zeros(length)
    for k in np.argsort(a_bits, kind="stable").tolist():
        if a_bits[k] != last:
            last = a_bits[k]
            at = np.bitwise_count(kind_bits & last).astype(np.int64) * width + kind_place
            counted = np.bincount(at, weights=kind_n, minlength=length)
        now, touched = counted.copy(), []
        for t in a[ends[k] : ends[k + 1]].tolist():
            if bit[t] or starts[t] == starts[t + 1]:
                continue
            one = slice(starts[t], starts[t + 1])
            found = listed[one]
            c = np.bincount(at[listed_kind[one]] + moved[found], weights=listed_n[one], minlength=length)
            now -= c
            now[width:] += c[:-width]
            moved[found] += width
            touched.append(found)
        for found in touched:
            moved[found] = 0
        size = int(a_sizes[k])
        if size not in tables:
            union = size + sizes[None, :] - steps[:, None]
            tables[size] = np.divide(steps[:, None], union, out=np.zeros(union.shape), where=union > 0).ravel()
        out[k] = now @ tables[size]
    return out


def _sums(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """_dense() where it is the faster: few sets, and sets of many words; else _sparse()."""
    if min(len(a_sizes), len(b_sizes)) <= CHUNK:
        return _dense(a, a_sizes, b, b_sizes, n)

    def part(codes: np.ndarray, sizes: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return codes[np.repeat(kept, sizes)], sizes[kept]

    short_a, short_b = a_sizes <= LONG, b_sizes <= LONG
    out = np.zeros(len(a_sizes))
    if short_a.any() and short_b.any():
        out[short_a] = _sparse(*part(a, a_sizes, short_a), *part(b, b_sizes, short_b), n[short_b])
    out[short_a] += _dense(*part(a, a_sizes, short_a), *part(b, b_sizes, ~short_b), n[~short_b])
    out[~short_a] = _dense(*part(a, a_sizes, ~short_a), b, b_sizes, n)
    return out


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks of a key: the sums of similarities of the sets of one to those of the other, weighted by how often these occur."""
    for batch in batches:
        flat, others = batch.column(1).flatten(), batch.column(2).flatten()
        tokens = [x.field("tokens") for x in (flat, others)]
        codes = pa.concat_arrays([t.flatten() for t in tokens]).dictionary_encode().indices.to_numpy()
        a_sizes, b_sizes = (pc.list_value_length(t).to_numpy().astype(np.int64) for t in tokens)
        a, b = np.split(codes, [int(a_sizes.sum())])
        n = others.field("n").to_numpy().astype(np.float64)
        own, other = (pc.list_value_length(batch.column(k)).to_numpy() for k in (1, 2))
        a_ends, b_ends = np.concatenate([[0], np.cumsum(a_sizes)]), np.concatenate([[0], np.cumsum(b_sizes)])
        sums, i, j = [np.zeros(0)], 0, 0
        for x, y in zip(own.tolist(), other.tolist(), strict=True):
            sums.append(_sums(a[a_ends[i] : a_ends[i + x]], a_sizes[i : i + x], b[b_ends[j] : b_ends[j + y]], b_sizes[j : j + y], n[j : j + y]))
            i, j = i + x, j + y
        key = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), own)))
        yield pa.RecordBatch.from_arrays([key, flat.field("set_no"), flat.field("n"), flat.field("first"), flat.field("text"), pa.array(a_sizes > 0), pa.array(np.concatenate(sums))], names=["key", "set_no", "n", "first", "text", "told", "score"])


def medoid(captions: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, n_captions, caption): the caption whose tokens are on the whole most similar to all others of the key; the first on ties.

    Captions with the same tokens are one set with a count. A key's sets are laid into blocks of about BLOCK, and blocks are compared with blocks,
    so a key of any size is spread over tasks; a key with no more than BLOCK sets is one block. Sums are
    rounded to 9 digits before ties are broken. Null captions are left out."""
    rows = captions.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(text).alias("text")).filter("key is not null and text is not null").withColumn("tokens", F.array_sort(token_set("text")))
    sets = stored(rows.groupBy("key", "tokens").agg(F.count("*").alias("n"), F.min_by("text", "order").alias("text"), F.min("order").alias("first")), "sets")
    # The block of a set is a hash of its tokens; the number of blocks follows the size of the key.
    sizes = sets.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = sets.join(sizes, "key").withColumn("set_no", F.xxhash64("tokens")).withColumn("block", F.pmod("set_no", F.col("blocks")))
    blocks = stored(placed.groupBy("key", "block").agg(F.collect_list(F.struct("set_no", "tokens", "n", "first", "text")).alias("own")), "blocks")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "order")}
    # Pairs are laid out by number, as a key's few large rows would be put together in one task.
    parts = int(captions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1))
    counted = blocks.join(sizes, "key")
    own = counted.withColumn("with", numbers).select("key", "block", "with", "own").repartition(parts, "key", "block", "with")
    slim = F.transform("own", lambda x: F.struct(x["tokens"].alias("tokens"), x["n"].alias("n"))).alias("other")
    other = counted.select("key", F.col("block").alias("with"), "blocks", slim).withColumn("block", numbers).select("key", "block", "with", "other").repartition(parts, "key", "block", "with")
    scored = own.hint("merge").join(other, ["key", "block", "with"]).select("key", "own", "other").mapInArrow(_similarities, f"key {kinds['key']}, set_no bigint, n bigint, first {kinds['order']}, text string, told boolean, score double")
    totals = scored.groupBy("key", "set_no").agg(F.sum("score").alias("score"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("text").alias("text"), F.first("told").alias("told"))
    # A caption is not compared with itself: one similarity of 1, or of 0 for one without tokens.
    place = F.struct(-F.round(F.col("score") - F.when(F.col("told"), 1.0).otherwise(0.0), 9), F.col("first"))
    best = totals.groupBy("key").agg(F.min_by("text", place).alias("caption"), F.sum("n").alias("n_captions"))
    return best.select(F.col("key").alias(key), "n_captions", "caption")


#: Aggregators by name.
AGGREGATORS: dict[str, Callable[..., DataFrame]] = {"raw": concatenated, "temporal": temporal, "centroid": medoid}


def token_pairs(captions: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, similarity) of each caption to the one before it."""
    from pyspark.sql import Window as W

    from ..functions.text import jaccard

    rows = captions.select(key, order, token_set(text).alias("tokens"))
    before = rows.withColumn("before", F.lag("tokens").over(W.partitionBy(key).orderBy(order)))
    return before.filter("before is not null").select(key, order, jaccard("before", "tokens").alias("similarity"))
