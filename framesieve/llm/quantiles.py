"""Problem 2: medians and other percentiles of very large numeric columns, by mergeable q-digests.

A value is quantised to a bounded ordered universe: the leading BITS bits of its order-preserving 64-bit form, which
keeps 12 bits of mantissa, so values differ from their cell's ends by a factor of at most 1 + 2**-12. A digest is a set of nodes of the
dyadic tree over that universe with counts. A node and its sibling are folded into their parent while the three
together hold less than n / k. Digests of parts, files or days are merged by adding the counts of equal nodes and
folding again. The rank of an answer is off by at most BITS * n / k: every ancestor of a cell holds at most n / k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import number

BITS = 24
#: Digests that one task merges at a time, nodes that a task holds while it sketches, and rows that may be broadcast.
FAN_IN, HELD, SMALL = 16, 1 << 20, 10_000


def cells(values: np.ndarray) -> np.ndarray:
    """Cell of each finite or infinite double; order is kept, -0.0 and 0.0 share a cell."""
    raw = (np.asarray(values, dtype=np.float64) + 0.0).view(np.uint64)
    ordered = np.where(raw >> np.uint64(63), ~raw, raw | np.uint64(1 << 63))
    return (ordered >> np.uint64(64 - BITS)).astype(np.int64)


def cell_ends(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest double of each cell."""
    low = np.asarray(cell, dtype=np.int64).astype(np.uint64) << np.uint64(64 - BITS)
    high = low | np.uint64((1 << (64 - BITS)) - 1)

    def back(x: np.ndarray) -> np.ndarray:
        return np.where(x >> np.uint64(63), x & np.uint64((1 << 63) - 1), ~x).view(np.float64)

    with np.errstate(invalid="ignore"):
        lo, hi = back(low), back(high)
    return np.where(np.isnan(lo), np.where(np.asarray(cell) >= 1 << (BITS - 1), np.inf, -np.inf), lo), np.where(np.isnan(hi), np.where(np.asarray(cell) >= 1 << (BITS - 1), np.inf, -np.inf), hi)


def size_for(rank_error: float) -> int:
    """k for which the rank is off by at most rank_error * n."""
    return math.ceil(BITS / rank_error)


def fold(nodes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Add equal nodes (numbered as in a heap, the root is 1), then fold small ones upwards, level by level."""
    nodes, where = np.unique(nodes, return_inverse=True)
    counts = np.bincount(where, weights=counts).astype(np.int64)
    limit = counts.sum() // k
    if not limit:
        return nodes, counts
    kept_nodes, kept_counts = [], []
    for level in range(BITS, 0, -1):
        here = nodes >> level == 1
        own, n = nodes[here], counts[here]
        above, n_above = nodes[~here], counts[~here]
        parents, at = np.unique(own >> 1, return_inverse=True)
        below = np.bincount(at, weights=n, minlength=len(parents)).astype(np.int64)
        place = np.searchsorted(above, parents)
        there = np.zeros(len(parents), dtype=bool)
        if len(above):
            there = (place < len(above)) & (above[np.minimum(place, len(above) - 1)] == parents)
        own_parent = np.where(there, n_above[np.minimum(place, len(above) - 1)] if len(above) else 0, 0)
        up = below + own_parent < limit
        kept_nodes.append(own[~up[at]])
        kept_counts.append(n[~up[at]])
        merged = np.concatenate([above, parents[up]])
        nodes, where = np.unique(merged, return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([n_above, below[up]]), minlength=len(nodes)).astype(np.int64)
    nodes, counts = np.concatenate([*kept_nodes, nodes]), np.concatenate([*kept_counts, counts])
    order = np.argsort(nodes)
    return nodes[order], counts[order]


def answer(nodes: np.ndarray, counts: np.ndarray, shares: list[float]) -> np.ndarray:
    """Cell for each share: nodes are taken by their right end, smaller ones first, until share * n is reached."""
    level = np.frexp(nodes.astype(np.float64))[1] - 1
    right = ((nodes + 1) << (BITS - level)) - 1 - (1 << BITS)
    order = np.lexsort((-level, right))
    total = np.cumsum(counts[order])
    wanted = np.maximum(np.ceil(np.array(shares) * total[-1] - 1e-9), 1)
    return right[order][np.searchsorted(total, wanted)]


def _sketch_part(n_keys: int, metrics: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        part, schema, nodes_held = TaskContext.get().partitionId(), None, 0  # the same when the task is run again

        def together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            return fold(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]), k)

        def out() -> Iterator[pa.RecordBatch]:
            for key, parts in held.items():
                nodes, counts = together(parts)
                arrays = [pa.array([v] * len(nodes), schema.field(i).type) for i, v in enumerate(key[:-1])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([key[-1]] * len(nodes), pa.string()), pa.array([part] * len(nodes), pa.int64()), pa.array(nodes), pa.array(counts)], names=[*schema.names[:n_keys], "metric", "part", "node", "count"])
            held.clear()

        for batch in batches:
            schema = batch.schema
            pdf = batch.to_pandas()
            keys = list(pdf.columns[:n_keys])
            for key, rows in pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]:
                for m, name in enumerate(metrics):
                    values = rows.iloc[:, n_keys + m].to_numpy(dtype=np.float64, na_value=np.nan)
                    values = values[~np.isnan(values)]
                    if len(values):
                        cell, n = np.unique(cells(values), return_counts=True)
                        parts = held.setdefault((*(None if pd.isna(x) else x for x in key), name), [])
                        parts.append((cell + (1 << BITS), n))
                        nodes_held += len(cell)
                        own = sum(len(x) for x, _ in parts)
                        if own > 6 * k:
                            parts[:] = [together(parts)]
                            nodes_held += len(parts[0][0]) - own
            if nodes_held > HELD:  # very many keys: what there is goes out, and a key's later digest is merged with it
                yield from out()
                nodes_held = 0
        yield from out()

    return run


def sketch(df: DataFrame, keys: list[str], metrics: list[str], rank_error: float = 0.001) -> DataFrame:
    """Digests as rows (*keys, metric, part, node, count), one digest for each task and key; with very many keys a task gives several.

    Null and NaN are not values; infinities are. A null key is a key like any other. An empty table gives no rows.
    Other columns of df are ignored; a key may not be called metric, part, node or count."""
    if clash := {"metric", "part", "node", "count"} & set(keys):
        raise ValueError(f"key columns may not be called {sorted(clash)}")
    chosen = df.select(*keys, *(number(m).alias(f"value {i}") for i, m in enumerate(metrics)))
    types = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}{', ' if keys else ''}metric string, part bigint, node bigint, count bigint"
    return chosen.mapInArrow(_sketch_part(len(keys), list(metrics), size_for(rank_error)), schema)


def merge(digests: DataFrame, keys: list[str], rank_error: float = 0.001, n_parts: int = 4096) -> DataFrame:
    """One digest for each key and metric from any number of digests, by node addition.

    Digests of finer keys (such as days) are merged by naming fewer keys. n_parts is about how many parts there are;
    with more than FAN_IN they are merged about FAN_IN at a time, so that a task holds about FAN_IN digests of one key, each of 3 k nodes at most.
    Digests of one part are always merged together; parts of a caller's own, such as days, are told apart by setting `part`."""
    k = size_for(rank_error)
    by = [*keys, "metric"]

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, counts = fold(pdf["node"].to_numpy(), pdf["count"].to_numpy(), k)
        head = pdf.iloc[:1][[*by, "part"]].loc[lambda x: x.index.repeat(len(nodes))].reset_index(drop=True)
        return head.assign(node=nodes, count=counts)

    now = digests.select(*by, "part", "node", "count")
    schema = now.schema
    while True:
        shards = -(-n_parts // FAN_IN)
        now = now.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(shards)).cast("bigint")) if shards > 1 else now.withColumn("part", F.lit(0).cast("bigint"))
        now = now.groupBy(*by, "part", "node").agg(F.sum("count").alias("count")).groupBy(*by, "part").applyInPandas(add, schema)
        if shards == 1:
            return now
        n_parts = shards


def percentiles(digest: DataFrame, keys: list[str], shares: list[float], rank_error: float = 0.001) -> DataFrame:
    """Answers from merged digests: (*keys, metric, p, n, low, value, max_rank_error).

    At least p * n values are at most `value`; fewer than (p + rank_error) * n + 1 are below `low`, the smallest number of
    the same cell. max_rank_error is the guaranteed bound in ranks."""
    by = [*keys, "metric"]
    schema = digest.select(*by)

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = answer(pdf["node"].to_numpy(), pdf["count"].to_numpy(), shares)
        low, high = cell_ends(cell)
        n = int(pdf["count"].sum())
        head = pdf.iloc[:1][by].loc[lambda x: x.index.repeat(len(shares))].reset_index(drop=True)
        return head.assign(p=shares, n=n, low=low, value=high, max_rank_error=math.floor(rank_error * n))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema)
    return digest.groupBy(*by).applyInPandas(ask, f"{types}, p double, n bigint, low double, value double, max_rank_error bigint")


def by_period(df: DataFrame, keys: list[str], period: str, metrics: list[str], shares: list[float], rank_error: float = 0.001, n_parts: int = 4096) -> DataFrame:
    """percentiles() of each period (such as a day) and of all periods together: (level, *keys, period, metric, p, n, low, value, max_rank_error).

    Rows are read once, for the digests of (keys, period); those of all periods are these, merged, with the same bound. level is `period` or
    `all`; period is null in rows of level `all`, and a null period is one like any other."""
    each = stored(merge(sketch(df, [*keys, period], metrics, rank_error), [*keys, period], rank_error, n_parts), "digests")
    periods = each.agg(F.count_distinct(period) + 1).first()[0]
    every = merge(each.withColumn("part", F.xxhash64(period)), keys, rank_error, periods)
    own = percentiles(each, [*keys, period], shares, rank_error).withColumn("level", F.lit("period"))
    total = percentiles(every, keys, shares, rank_error).withColumns({"level": F.lit("all"), period: F.lit(None).cast(each.schema[period].dataType)})
    return own.unionByName(total).select("level", *keys, period, "metric", "p", "n", "low", "value", "max_rank_error")


def rank_check(df: DataFrame, answers: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Exact ranks of answers: (*keys, metric, p, n, within), by one more pass over df.

    The answers, one row a key and metric, are written first and counted: up to SMALL of them are broadcast, more are joined."""
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), number(m).alias("x")) for m in metrics))).alias("v")).select(*keys, "v.*").filter("x is not null")
    asked = stored(answers.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("p", "low", "value", "max_rank_error"))).alias("asked")), "answers")
    same: Column = F.lit(True)
    left, right = long.alias("l"), (F.broadcast(asked) if asked.count() <= SMALL else asked).alias("r")
    for c in [*keys, "metric"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    met = left.join(right, same).select(*(f"l.{c}" for c in [*keys, "metric"]), "x", F.explode("asked").alias("a"))
    ranks = met.groupBy(*keys, "metric", "a.p", "a.max_rank_error").agg(F.count("*").alias("n"), F.count_if(F.col("x") <= F.col("a.value")).alias("most"), F.count_if(F.col("x") < F.col("a.low")).alias("below"))
    wanted = F.col("p") * F.col("n")
    return ranks.select(*keys, "metric", "p", "n", ((F.col("most") >= wanted - 1e-6) & (F.col("below") <= wanted + F.col("max_rank_error") + 1)).alias("within"))
