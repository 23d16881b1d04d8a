"""Problem 3: one ranking from several differently scaled scores, by a walk over ranks.

From an item the walker picks one of the item's scores and jumps to one of the items that are better in it, all alike; with
probability 1 - damping, or if nothing is better, to any item. Items are ordered by how often the walker is there. Only the order of
a score counts, so none rules because its numbers are large or its distribution is wide.

An item receives from each score the sum, over all worse values, of what the items of that value give to each better
one: a prefix sum over the sorted values. The walk thus needs a number for each value of a score and none for an item.
Values share one if the rows above them agree within 1 / FINE: these cells are single values up to FINE rows from the top, and
beyond that at most 2 * FINE for each factor e of the rows, so their number follows the logarithm of the rows, and the driver can hold them
at any size. A value that has a cell of its own is exact; within a cell of several the sum rises in proportion to the value. This
moves a gain by at most what the cell as a whole gives, 1 / FINE of what the items at that rank hold.

Rounds are passes over the items, all of them each time. What is iterated are the prefix sums and the base; steps are combined by
least squares over the last MEMORY of them (Anderson's acceleration of the power iteration), which has the same fixed point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import released, stored
from .common import number

#: Numbers that are added up in one row, the resolution of cells, and how many steps are combined.
CHUNK, FINE, MEMORY = 1 << 16, 1 << 16, 5


def cells(items: DataFrame, n_scores: int, fine: int) -> DataFrame:
    """(score, lowest, highest, n, n_highest, each) of the cells of each score; each is the mean of 1 / (rows above) over the cell's rows, 0 at the top.

    Values are counted, range-partitioned and numbered within parts; parts are shifted by the sizes of those above them."""
    long = items.select(F.explode(F.array(*(F.struct(F.lit(k).alias("score"), F.col(f"s{k}").alias("value")) for k in range(n_scores)))).alias("s")).select("s.*").filter("value is not null")
    counts = long.groupBy("score", "value").agg(F.count("*").alias("n"))
    parts = stored(counts.repartitionByRange("score", "value").withColumn("part", F.spark_partition_id()), "values")
    sizes = parts.groupBy("score", "part").agg(F.sum("n").alias("n"))  # a row a task and score
    higher = F.coalesce(F.sum("n").over(W.partitionBy("score").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n").over(W.partitionBy("score", "part").orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = parts.withColumn("inner", within).join(F.broadcast(sizes.select("score", "part", higher.alias("higher"))), ["score", "part"]).withColumn("above", F.col("inner") + F.col("higher"))
    band = F.when(F.col("above") <= fine, F.col("above")).otherwise(fine + F.floor(F.ln(F.col("above") / fine) * fine).cast("bigint"))
    # A value of many rows, which is the lowest of its band, stands alone, as do infinities, between which nothing can be interpolated.
    alone = (F.col("n") * fine > F.col("above")) | (F.abs("value") == float("inf"))
    each = F.when(F.col("above") > 0, F.col("n") / F.col("above")).otherwise(0.0)
    grouped = ranked.groupBy("score", band.alias("band"), alone.alias("alone"), F.when(alone, F.col("value")).alias("itself"))
    return grouped.agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.sum("n").alias("n"), F.max_by("n", "value").alias("n_highest"), (F.sum(each) / F.sum("n")).alias("each")).drop("band", "alone", "itself")


def _place(known):
    """Cell of each of an item's scores (-1 for a missing one), and how far up in it the value is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ups = [], []
            for k, (lowest, slope) in enumerate(known.value):
                x = batch.column(k + 1).to_numpy(zero_copy_only=False).astype(np.float64)
                at = np.searchsorted(lowest, x, side="right") - 1
                at[np.isnan(x)] = -1
                up = np.zeros(len(x))
                inside = (at >= 0) & (slope[at] > 0) if len(slope) else np.zeros(len(x), dtype=bool)
                up[inside] = (x[inside] - lowest[at[inside]]) * slope[at[inside]]
                places.append(pa.array(at.astype(np.int32)))
                ups.append(pa.array(up.astype(np.float32)))
            k = range(len(places))
            yield pa.RecordBatch.from_arrays([batch.column(0), *places, *ups], names=["id", *(f"r{i}" for i in k), *(f"u{i}" for i in k)])

    return run


def _mass(batch: pa.RecordBatch, first: int, gains: list[np.ndarray], base: float, damping: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mass of the items of a batch, whose places begin at column `first`, and their places."""
    places = [batch.column(first + k).to_numpy() for k in range(len(gains))]
    got = np.zeros(batch.num_rows)
    for k, (at, gain) in enumerate(zip(places, gains, strict=True)):
        there = at >= 0
        up = batch.column(first + len(gains) + k).to_numpy()[there]
        own = at[there]
        got[there] += gain[own] + up * (gain[own + 1] - gain[own])
    return base + damping * got, places


def _round(shared, base: float, damping: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        sums, loose = [np.zeros(len(g) - 1) for g in gains], 0.0
        for batch in batches:
            mass, places = _mass(batch, 0, gains, base, damping)
            has = sum((r >= 0).astype(np.int64) for r in places)
            share = mass / np.maximum(has, 1)
            loose += float(mass[has == 0].sum())
            for r, total in zip(places, sums, strict=True):
                there = r >= 0
                total += np.bincount(r[there], weights=share[there], minlength=len(total))
        out = [(-1, 0, np.array([loose]).tobytes())]
        out += [(k, at, total[at : at + CHUNK].tobytes()) for k, total in enumerate(sums) for at in range(0, len(total), CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["score", "at", "sums"])

    return run


def _add(pdf):
    total = np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0)
    return pdf.iloc[:1].assign(sums=[total.tobytes()])


def combined(steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The next point from the last (point, change) pairs: the combination of them whose change is least."""
    point, change = steps[-1]
    if len(steps) == 1:
        return point + change
    d_change = np.stack([change - c for _, c in steps[:-1]], axis=1)
    d_point = np.stack([point - p for p, _ in steps[:-1]], axis=1)
    part = np.linalg.lstsq(d_change, change, rcond=None)[0]
    return point + change - (d_point + d_change) @ part


def rank_walk(df: DataFrame, id_col: str, scores: dict[str, bool], damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-9, fine: int = FINE) -> DataFrame:
    """(id_col, score, position) for each row of df: position 1 is best, ties in score go by the smaller id.

    scores names the columns and whether more is better. score is the stationary probability times the number of rows, rounded to 9 digits,
    so 1.0 is the average. A null or NaN score of a row is not offered for a jump, and the row is not reached by it; a
    row without any score is reached by chance only. Equal rows count separately. An empty table gives no rows.
    Other columns of df are ignored. Rounds end when no prefix sum, times the number of rows, changes by `tolerance`, which is the digit scores are rounded to."""
    signed = {k: number(c) if more else -number(c) for k, (c, more) in enumerate(scores.items())}
    # Adding zero makes -0.0 and 0.0 one value.
    items = stored(df.select(F.col(id_col).alias("id"), *((c + F.lit(0.0)).alias(f"s{k}") for k, c in signed.items())), "scores")
    n, kind = items.count(), items.schema["id"].dataType.simpleString()
    if not n:
        return items.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("position"))
    table = cells(items, len(signed), fine).toArrow().to_pandas().sort_values(["score", "lowest"])  # a number of rows that follows the logarithm of n
    own = [table[table["score"] == k] for k in signed]
    each = [t["each"].to_numpy() for t in own]

    def slope(t) -> np.ndarray:
        wide = (t["highest"] - t["lowest"]).to_numpy()
        return np.divide((1 - t["n_highest"] / t["n"]).to_numpy(), wide, out=np.zeros(len(t)), where=(wide > 0) & np.isfinite(wide))

    context = items.sparkSession.sparkContext
    known = context.broadcast([(t["lowest"].to_numpy(), slope(t)) for t in own])
    columns = "".join(f", r{k} int" for k in signed) + "".join(f", u{k} float" for k in signed)
    placed = stored(items.mapInArrow(_place(known), f"id {kind}{columns}"), "placed")
    # Partial sums are as long as there are cells, whatever a task reads: a few tasks for each core give as many of them.
    ranks = placed.drop("id").coalesce(2 * context.defaultParallelism)
    ends = np.cumsum([len(e) for e in each])
    x = np.concatenate([np.zeros(ends[-1]), [1.0]])  # what each cell gives to each better item, and the base; times n
    steps: list[tuple[np.ndarray, np.ndarray]] = []

    def unpacked(x: np.ndarray) -> tuple[list[np.ndarray], float]:
        return [np.concatenate([[0.0], np.cumsum(g)]) / n for g in np.split(x[:-1], ends[:-1])], x[-1] / n

    for _ in range(rounds):
        gains, base = unpacked(x)
        shared = context.broadcast(gains)
        parts = ranks.mapInArrow(_round(shared, base, damping), "score int, at bigint, sums binary")
        sums, loose = [np.zeros(len(e)) for e in each], 0.0
        for row in parts.groupBy("score", "at").applyInPandas(_add, "score int, at bigint, sums binary").collect():  # one number a cell
            part = np.frombuffer(row.sums)
            if row.score < 0:
                loose += float(part[0])
            else:
                sums[row.score][row.at : row.at + len(part)] = part
        shared.destroy()
        loose += sum(float(total[e == 0].sum()) for total, e in zip(sums, each, strict=True))
        new = np.concatenate([*(total * e for total, e in zip(sums, each, strict=True)), [(1 - damping) / n + damping * loose / n]]) * n
        steps = [*steps, (x, new - x)][-MEMORY:]
        change = np.abs([*(np.abs(np.cumsum(c)).max() for c in np.split(new[:-1] - x[:-1], ends[:-1]) if len(c)), new[-1] - x[-1]]).max()
        if change < tolerance:
            x = new
            break
        x = combined(steps)
    gains, base = unpacked(x)
    final = context.broadcast(gains)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_mass(batch, 1, final.value, base, damping)[0])], names=["id", "mass"])

    mass = placed.mapInArrow(finish, f"id {kind}, mass double")
    out = positions(mass.select("id", F.round(F.col("mass") * n, 9).alias("score"))).select(F.col("id").alias(id_col), "score", "position")
    for used in (items, placed):
        released(used)
    return out


def positions(df: DataFrame) -> DataFrame:
    """Adds position by score from high to low, then id: range-partitioned, numbered within parts, shifted by the sizes of the parts before."""
    parts = stored(df.repartitionByRange(F.desc("score"), F.asc("id")).withColumn("part", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row a task
    offset = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = parts.withColumn("inner", F.row_number().over(W.partitionBy("part").orderBy(F.desc("score"), F.asc("id"))))
    return numbered.join(F.broadcast(offset), "part").select("id", "score", (F.col("before") + F.col("inner")).alias("position"))
