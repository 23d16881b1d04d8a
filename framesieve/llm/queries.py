"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order
from . import bpe, distinctive, leaks, quantiles, ranking, records, repetition, stuffing, terms, truncation
from .common import one_per_id

#: Vocabulary of p8_ids; any other file of ranks, and its pattern, can be given to bpe.encode().
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARES = [0.5, 0.9, 0.95, 0.99]
RANK_ERROR = 0.001
TIMES = ["processing_time_s", "peak_vram_mb"]
SCORES = {"cider": True, "bleu4": True, "meteor": True, "processing_time_s": False}


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _marked(spark: SparkSession, d: str, sigma: int) -> DataFrame:
    sentences = one_per_id(_read(spark, d, "sentences"), "sen_id", "caption")
    return terms.marked_terms(*terms.term_counts(sentences, "caption", sigma))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, 1).filter("mark <> 'kept'").select("term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, 1).select("term", "cf", "df", "mark")


def p1_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, 3).select("term", "n", "cf", "df", "mark")


def _times(spark: SparkSession, d: str) -> DataFrame:
    return one_per_id(_read(spark, d, "results"), "row_id", "sampling_method", "finished_at", *TIMES)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Of each method, day by day, and of all its days: the digests of the days, merged."""
    rows = _times(spark, d).withColumn("day", F.to_date("finished_at"))
    return quantiles.by_period(rows, ["sampling_method"], "day", TIMES, SHARES, RANK_ERROR, _parts(spark))


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """Between what the answers of level `all` must lie: least <= value and low <= most, exact order statistics at p and at p + rank error."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), quantiles.number(m).alias("x")) for m in TIMES))).alias("v")
    rows = _times(spark, d).select("sampling_method", each).select("sampling_method", "v.*").filter("x is not null")

    def asked(n):
        first = [F.greatest(F.lit(1), F.ceil(F.lit(p) * n - 1e-9)).cast("bigint") for p in SHARES]
        return F.array(*first, *(F.least(n, r + F.floor(F.lit(RANK_ERROR) * n) + 2) for r in first))

    found = order.order_statistics(rows, ["sampling_method", "metric"], "x", asked)
    k = len(SHARES)
    both = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col("values")[i].alias("least"), F.col("values")[k + i].alias("most")) for i, p in enumerate(SHARES)))).alias("v")
    return found.select("sampling_method", "metric", "n", both).select("sampling_method", "metric", "v.p", "n", "v.least", "v.most")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_id(_read(spark, d, "results"), "row_id", *SCORES)
    return ranking.rank_walk(rows, "row_id", SCORES).withColumn("score", F.round("score", 6))


def p3_configurations(spark: SparkSession, d: str) -> DataFrame:
    keys = ["sampling_method", "aggregation_method", "caption_mode"]
    rows = one_per_id(_read(spark, d, "results"), "row_id", *keys, *SCORES)
    means = rows.groupBy(*keys).agg(*(F.round(F.avg(quantiles.number(c)), 9).alias(c) for c in SCORES))  # the same on every engine
    named = means.withColumn("configuration", F.concat_ws(" + ", *(F.coalesce(c, F.lit("none")) for c in keys)))
    return ranking.rank_walk(named, "configuration", SCORES).withColumn("score", F.round("score", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return records.same_records(_read(spark, d, "raw_records"), "rec_id", "payload")[1]


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    groups, _ = records.same_records(_read(spark, d, "raw_records"), "rec_id", "payload")
    return groups.select("keep_id", "copies")


def p5_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(_read(spark, d, "baseline_results"), "row_id", "generated_caption")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.looping(p5_repetition(spark, d)).select("row_id")


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    # Ids of the two tables may be equal; doubled, and plus one, they differ.
    first = _read(spark, d, "sentences").select("video_id", (F.col("sen_id") * 2).alias("text_id"), F.col("caption").alias("text"))
    second = _read(spark, d, "baseline_results").select("video_id", (F.col("row_id") * 2 + 1).alias("text_id"), F.col("generated_caption").alias("text"))
    texts = first.unionAll(second)
    n = texts.agg(F.count_distinct("video_id")).first()[0]
    return distinctive.log_entropy(distinctive.term_frequencies(texts, "video_id", "text_id", "text"), n).withColumnRenamed("record", "video_id"), n


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)[0].withColumns({"weight": F.round("weight", 6), "score": F.round("score", 6)})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.marking_terms(*_scores(spark, d)).select("video_id", "term")


def _truncation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return truncation.truncation(_read(spark, d, "baseline_results"), "row_id", "generated_caption", "sampling_method")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncation(spark, d)[0].filter("cut").select("row_id")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(_truncation(spark, d)[0]).withColumnRenamed("source", "sampling_method")


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    return _truncation(spark, d)[1].withColumnRenamed("source", "sampling_method")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_read(spark, d, "documents"), "doc_id", "text", VOCABULARY, public_tokenizers.PATTERN)


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """item_id is that of the item's class; p9_classes has its members."""
    return leaks.leaked_passages(_read(spark, d, "documents"), "doc_id", "text", _read(spark, d, "eval_items"), "item_id", "text")


def p9_lengths(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id", "n_words")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return leaks.item_classes(_read(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    met = p9_passages(spark, d).select("doc_id", F.col("item_id").alias("representative")).distinct()
    return met.join(p9_classes(spark, d), "representative").select("doc_id", F.col("item").alias("item_id"))


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.block_report(_read(spark, d, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(p10_report(spark, d)).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_terms, p1_ngrams, p2_percentiles, p2_exact, p3_ranking, p3_configurations, p4_found, p4_records, p5_found, p5_repetition)
    + (p6_found, p6_scores, p7_found, p7_rates, p7_limits, p8_ids, p9_found, p9_passages, p9_lengths, p9_classes, p10_found, p10_report)
}
