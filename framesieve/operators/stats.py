"""Grouped statistics of runs, confidence intervals, rankings and the data behind plots."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import stored
from . import order

KEYS = ["sampling_method", "aggregation_method", "caption_mode"]
#: The metrics of the statistics, in the order of their columns; parts of names by which a metric is known to lie in [0, 1], or not below 0.
METRICS = ["frames_selected", "semantic_yield", "processing_time_s", "peak_vram_mb", "peak_ram_delta_mb", "gpu_utilization_pct", "cider", "bleu1", "bleu4", "rouge_l", "meteor"]
SHARES_OF_ONE = ("bleu1", "bleu4", "rouge_l", "meteor")
NOT_NEGATIVE = ("cider", "processing_time", "vram", "ram", "util")
#: Metrics that are drawn as bars, and the order of methods in figures.
BAR_METRICS = ["cider", "bleu4", "processing_time_s", "peak_vram_mb", "peak_ram_delta_mb", "frames_selected", "semantic_yield"]
METHOD_ORDER = {"fps1": 0, "fps2": 1, "random": 2, "phash": 3, "tass_fixed": 4, "tass_adaptive": 5}


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 300):
        for k in ((m * (b - m) * x) / ((a + 2 * m - 1) * (a + 2 * m)), (-(a + m) * (a + b + m) * x) / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


@lru_cache(maxsize=100_000)
def t_quantile(df: int, p: float = 0.975) -> float:
    """Quantile of Student's distribution, by bisection; from a million degrees on, two terms of its series about the normal one."""
    if df >= 1_000_000:
        from statistics import NormalDist

        z = NormalDist().inv_cdf(p)
        return z + (z**3 + z) / (4 * df)
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        tail = 0.5 * _beta_tail(df / (df + mid * mid), df / 2, 0.5)
        low, high = (mid, high) if tail > 1 - p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def _t_of(df: pd.Series) -> pd.Series:
    return df.map(lambda x: t_quantile(int(x)) if pd.notna(x) and x >= 1 else None)


def value(c: str) -> Column:
    """The column as double, NaN as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def clamped(metric: str, x: Column) -> Column:
    """Bounds that a mean of this metric can't leave, told by parts of its name; `ram` is part of frames_selected too."""
    if any(part in metric for part in SHARES_OF_ONE):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    if any(part in metric for part in NOT_NEGATIVE):
        return F.greatest(F.lit(0.0), x)
    return x


def grouped_statistics(runs: DataFrame, keys: list[str] | None = None, metrics: list[str] | None = None, medians: bool = True) -> DataFrame:
    """keys, count, and of each metric mean, median, std, min, max and the 95 % interval of the mean.

    Rows with a null key are left out, metrics that runs lacks are skipped, null and NaN are no values. std of a single
    value is 0.0; the interval is then the mean itself, and not clamped. All but the medians come from one aggregation; medians are exact, from
    range-partitioned counts of values, so that no group is held by a task. Without `medians` there is no such column."""
    keys, present = keys or KEYS, [m for m in (metrics or METRICS) if m in runs.columns]
    valued = runs.select(*keys, *(value(m).alias(m) for m in present)).dropna(subset=keys)
    if medians:
        valued = stored(valued, "valued")
    parts = [f(F.col(m)).alias(f"{m}_{name}") for m in present for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    # Groups are few (configurations), so quantiles of t are asked for after the aggregation.
    found = valued.groupBy(*keys).agg(F.count("*").alias("count"), *parts)
    if medians:
        long = valued.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in present))).alias("v")).select(*keys, "v.metric", "v.x")
        middle = order.percentiles(long, [*keys, "metric"], "x", [0.5]).groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == m, F.col("values")[0])).alias(f"{m}_median") for m in present))
        found = found.join(middle, keys, "left")
    out = [*keys, "count"]
    for m in present:
        n, mean, std = F.col(f"{m}_n"), F.col(f"{m}_mean"), F.coalesce(f"{m}_std", F.when(F.col(f"{m}_n") > 0, 0.0))
        half = _t_of(n - 1) * std / F.sqrt(n)
        plain = (n < 2) | (std == 0)
        out += [f"{m}_mean", *([f"{m}_median"] if medians else []), std.alias(f"{m}_std"), f"{m}_min", f"{m}_max"]
        out += [F.when(plain, mean).otherwise(clamped(m, mean - half)).alias(f"{m}_ci95_lower"), F.when(plain, mean).otherwise(clamped(m, mean + half)).alias(f"{m}_ci95_upper")]
    return found.select(*out)


def ranking_metric(statistics: DataFrame) -> str:
    """The first of three means that is above 0 for some configuration."""
    candidates = [c for c in ("cider_mean", "bleu1_mean", "rouge_l_mean") if c in statistics.columns]
    top = statistics.agg(*(F.max(c).alias(c) for c in candidates)).first() if candidates else None
    for c in candidates:
        if top[c] is not None and top[c] > 0:
            return c
    raise RuntimeError("All quality metrics are zero.")


def best_of(statistics: DataFrame, metric: str, largest: bool = True, keys: list[str] | None = None) -> DataFrame:
    """The configuration with the best value; the first by keys on ties."""
    order = F.desc_nulls_last(metric) if largest else F.asc_nulls_last(metric)
    return statistics.orderBy(order, *(keys or KEYS)).limit(1)


def highlights(statistics: DataFrame) -> DataFrame:
    """(role, keys, value): best quality, fastest, least video memory and least memory. The means are stored once, and one aggregation finds all four."""
    means = stored(statistics.select(*KEYS, *(c for c in statistics.columns if c.endswith("_mean"))), "means")
    wanted = [("best", ranking_metric(means), -1), ("fastest", "processing_time_s_mean", 1), ("least_vram", "peak_vram_mb_mean", 1), ("least_ram", "peak_ram_delta_mb_mean", 1)]
    first = [F.min_by(F.struct(F.lit(role).alias("role"), *KEYS, F.col(m).alias("value")), F.struct(F.col(m).isNull(), F.col(m) * sign, *KEYS)).alias(role) for role, m, sign in wanted]
    return means.agg(*first).select(F.explode(F.array(*(role for role, _, _ in wanted))).alias("top")).filter("top is not null").select("top.*")


def plot_means(runs: DataFrame) -> DataFrame:
    """Mean time and quality of each configuration, for the scatter plot."""
    return runs.dropna(subset=KEYS).groupBy(*KEYS).agg(F.avg(value("processing_time_s")).alias("processing_time_s"), F.avg(value("cider")).alias("cider"))


def label_offsets(points: DataFrame) -> DataFrame:
    """Adds slot (time to one decimal) and offset: how many points before it in the slot are nearly as high. Points are configurations, hence few."""
    slots = points.withColumn("slot", F.bround("processing_time_s", 1))
    before = W.partitionBy("slot").orderBy("processing_time_s", "cider", *KEYS).rowsBetween(W.unboundedPreceding, -1)
    earlier = slots.withColumn("earlier", F.collect_list("cider").over(before))
    return earlier.withColumn("offset", F.size(F.filter("earlier", lambda y: F.abs(y - F.col("cider")) < 0.02)).cast("bigint")).drop("earlier")


def frontier(points: DataFrame) -> DataFrame:
    """Configurations that no other beats in both time and quality (an extension). One pass by time, over few points."""
    before = W.orderBy("processing_time_s", F.desc("cider")).rowsBetween(W.unboundedPreceding, -1)
    return points.withColumn("best", F.max("cider").over(before)).filter("best is null or cider > best").drop("best")


def bar_means(runs: DataFrame) -> DataFrame:
    """(pipeline_config, caption_mode, metric, mean, n) of the metrics drawn as bars."""
    named = runs.withColumn("pipeline_config", F.concat("sampling_method", F.lit(" + "), "aggregation_method"))
    metrics = [m for m in BAR_METRICS if m in runs.columns]
    long = named.select("pipeline_config", "caption_mode", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), value(m).alias("x")) for m in metrics))).alias("v")).select("pipeline_config", "caption_mode", "v.*")
    return long.filter("x is not null and pipeline_config is not null and caption_mode is not null").groupBy("pipeline_config", "caption_mode", "metric").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def _uniform(*columns: Column | str) -> Column:
    """A number from 0 to 2**28 - 1 that follows from the columns, whose texts are the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 7), 16, 10).cast("bigint")


def bootstrap_means(runs: DataFrame, metric: str, keys: list[str] | None = None, id_col: str = "row_id", draws: int = 200, parts: int = 1024) -> DataFrame:
    """(*keys, lower, upper): 95 % interval of the mean by a seeded Poisson bootstrap.

    Rows are first summed within at most `parts` parts of a group, chosen by a hash of id_col; parts, not rows, are drawn. A small group
    has about a row a part; a group of any size costs one aggregation of its rows and parts * draws sums."""
    keys = keys or KEYS
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    rows = runs.select(*keys, value(metric).alias("x"), F.pmod(_uniform(F.col(id_col).cast("string")), F.lit(parts)).alias("part")).dropna(subset=[*keys, "x"])
    sums = rows.groupBy(*keys, "part").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    drawn = sums.select(*keys, "part", "s", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = _uniform(*keys, F.col("part").cast("string"), F.col("draw").cast("string")) / float(1 << 28)
    weight = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    means = drawn.withColumn("w", weight).groupBy(*keys, "draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    return means.groupBy(*keys).agg(F.percentile("mean", 0.025).alias("lower"), F.percentile("mean", 0.975).alias("upper"))


def quartiles(df: DataFrame, key: str, x: str) -> DataFrame:
    """(key, n, min, q1, median, q3, max), exact, interpolated."""
    q = order.percentiles(df.select(F.col(key), value(x).alias("x")), [key], "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select(key, "n", *(F.col("values")[k].alias(name) for k, name in enumerate(("min", "q1", "median", "q3", "max"))))


def method_place(c: str) -> Column:
    """Place of a method in figures; unknown ones come last."""
    return F.coalesce(*(F.when(F.col(c) == m, k) for m, k in METHOD_ORDER.items()), F.lit(99))
