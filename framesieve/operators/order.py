"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored


def same(a: str, b: str, columns: list[str]) -> Column:
    """Null-safe equality of the columns of two aliased tables."""
    return reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), columns, F.lit(True))


def order_statistics(rows: DataFrame, keys: list[str], x: str, asked: Callable[[Column], Column]) -> DataFrame:
    """(*keys, n, values): n counts the rows of a group whose x is not null, values has the x at each rank of asked(n), an array of ranks from 1 to n.

    Equal values are counted before they are shuffled and range-partitioned by group and value, so a group is spread over as many tasks as it
    needs; the sizes of the parts (a row a task and group) tell in which part a rank lies, and only such parts are numbered. Null keys are keys."""
    counts = rows.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count("*").alias("n"))
    parts = stored(counts.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()), "ordered")
    by = W.partitionBy(*keys)
    sizes = parts.groupBy(*keys, "part").agg(F.sum("n").alias("size"))
    placed = sizes.withColumns({"total": F.sum("size").over(by), "upto": F.sum("size").over(by.orderBy("part").rowsBetween(W.unboundedPreceding, 0))})
    ranks = placed.select(*keys, "part", "total", "size", "upto", F.posexplode(asked(F.col("total"))).alias("at", "rank")).filter("rank <= upto and rank > upto - size")
    wanted = ranks.groupBy(*keys, "part").agg(F.collect_list(F.struct("at", (F.col("rank") - F.col("upto") + F.col("size")).alias("rank"))).alias("wanted"), F.first("total").alias("total"))
    met = parts.alias("p").join(wanted.alias("w"), same("p", "w", [*keys, "part"])).select(*(F.col(f"p.{k}").alias(k) for k in keys), "p.part", "x", "p.n", "wanted", "total")
    within = F.sum("n").over(W.partitionBy(*keys, "part").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    hit = F.filter("wanted", lambda a: (a["rank"] <= F.col("here")) & (a["rank"] > F.col("here") - F.col("n")))
    found = met.withColumn("here", within).select(*keys, "total", "x", F.explode(hit).alias("a"))
    return found.groupBy(*keys).agg(F.first("total").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("a.at", "x"))), lambda v: v["x"]).alias("values"))


def percentiles(rows: DataFrame, keys: list[str], x: str, shares: list[float]) -> DataFrame:
    """(*keys, n, values): exact percentiles, interpolated between the two values next to each share of n - 1."""

    def between(p: float, n: Column) -> Column:
        return F.lit(p) * (n - 1)

    found = order_statistics(rows, keys, x, lambda n: F.array(*(f(between(p, n)).cast("bigint") + 1 for p in shares for f in (F.floor, F.ceil))))

    def value(k: int, p: float) -> Column:
        low, high = F.col("values")[2 * k], F.col("values")[2 * k + 1]
        part = between(p, F.col("n")) - F.floor(between(p, F.col("n")))
        return F.when(low == high, low).otherwise(low + (high - low) * part)

    return found.select(*keys, "n", F.array(*(value(k, p) for k, p in enumerate(shares))).alias("values"))
