"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


#: Keys of a join that have more than HOT_ROWS rows and HOT_SHARE of all; there can be no more than 1 / HOT_SHARE of them.
HOT_ROWS, HOT_SHARE = 1000, 1 / 10_000


def joined_by_key(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows.join(table, key, "left") for a table with one row a key: what it has of the hot keys of rows is broadcast, so that no task gets all rows of
    one; the other keys are joined by shuffle. Both tables are read several times."""
    sizes = stored(rows.groupBy(key).agg(F.count("*").alias("n")), "key-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(sizes.filter(F.col("n") > max(HOT_ROWS, HOT_SHARE * total)).select(key))  # at most 1 / HOT_SHARE rows
    wide = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
    return wide.unionByName(rows.join(hot, key, "left_anti").join(table, key, "left"))


def one_per_id(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """One row (id, *cols) for each id that is not null, however often it was delivered.

    Deliveries of an id should agree; where they don't, the smallest non-null value of each column stands.
    Partial minima are taken before the shuffle, so an id delivered very often costs one row a task."""
    chosen = df.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(cols)))
    kept = chosen.filter("id is not null").groupBy("id").agg(*(F.min(f"c{k}").alias(f"c{k}") for k in range(len(cols))))
    return kept.select(F.col("id").alias(id_col), *(F.col(f"c{k}").alias(c) for k, c in enumerate(cols)))


def number(c: str | Column) -> Column:
    """The column as double, NaN as null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)
