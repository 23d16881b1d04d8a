"""Problem 6: how distinctive a term is for a record, by log-entropy weights.

score = ln(1 + tf) * (1 - H / ln N): tf is how often the term occurs in the record, H the entropy of the term's spread
over records, N the number of records. Two aggregations: by (record, term) and by term. A term of one record
has entropy 0 and weight 1, a term spread evenly over all records weight 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import stored


#: Records with more than HOT_TEXTS texts and HOT_SHARE of all are spread over tasks, terms with as large a share of all pairs are told to each
#: task; there can be no more than 1 / HOT_SHARE of either.
HOT_TEXTS, HOT_SHARE = 1000, 1 / 10_000


def _counted(texts: DataFrame) -> DataFrame:
    """(record, term, tf, texts) of rows (record, text_id, text), each text_id once a record."""
    once = texts.groupBy("record", "text_id").agg(F.min("text").alias("text"))
    tokens = once.select("record", words("text").alias("words")).filter("size(words) > 0")
    # A word is counted for its text where it occurs first, so texts need no key of their own.
    placed = tokens.select("record", "words", F.posexplode("words").alias("at", "term"))
    first = (F.array_position("words", F.col("term")) == F.col("at") + 1).cast("bigint")
    marked = placed.select("record", "term", first.alias("first"))
    return marked.groupBy("record", "term").agg(F.count("*").alias("tf"), F.sum("first").alias("texts"))


def term_frequencies(texts: DataFrame, record_col: str, id_col: str, text_col: str) -> DataFrame:
    """(record, term, tf, texts): occurrences, and texts of the record that hold the term.

    texts has a row for each delivery of a text of a record; an id counts once a record, its smallest text stands. Rows
    without record or id, and null, empty or wordless texts, give nothing. Other columns of texts are ignored.

    Texts are routed by record once and counted where they are, so the far more numerous pairs of record and term
    are not shuffled. Records with very many texts are left out of that: their texts are routed by id, counted there, and added up by pair."""
    rows = texts.select(F.col(record_col).alias("record"), F.col(id_col).alias("text_id"), F.col(text_col).cast("string").alias("text")).filter("record is not null and text_id is not null and text is not null")
    sizes = rows.groupBy("record").agg(F.count("*").alias("n"))
    total = rows.count()
    hot = stored(sizes.filter(F.col("n") > max(HOT_TEXTS, HOT_SHARE * total)).select("record"), "hot")
    listed = F.broadcast(hot)  # at most 1 / HOT_SHARE rows
    cold = _counted(rows.join(listed, "record", "left_anti").repartition("record"))
    return stored(cold.unionByName(_counted(rows.join(listed, "record", "left_semi"))), "frequencies")


def log_entropy(frequencies: DataFrame, n_records: int) -> DataFrame:
    """Adds records (that hold the term), weight and score to rows of term_frequencies().

    With fewer than two records every weight is 1. The second aggregation is over terms; its result is joined back on
    the term. Terms that very many records hold are broadcast for that, so that none of them is a hot key; the others are joined by shuffle."""
    spread = frequencies.groupBy("term").agg(F.count("*").alias("records"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.ln("tf")).alias("tlt"))
    entropy = F.ln("gf") - F.col("tlt") / F.col("gf")
    weight = F.greatest(F.lit(0.0), F.lit(1.0) - entropy / F.lit(_ln(n_records))) if n_records > 1 else F.lit(1.0)
    weighted = stored(spread.select("term", "records", weight.alias("weight")), "weights")
    pairs = weighted.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    wide = F.col("records") > max(HOT_TEXTS, HOT_SHARE * pairs)
    few = F.broadcast(weighted.filter(wide))  # at most 1 / HOT_SHARE rows
    rest = frequencies.join(few.select("term"), "term", "left_anti").join(weighted.filter(~wide), "term")
    both = frequencies.join(few, "term").unionByName(rest)
    return both.select("record", "term", "tf", "texts", "records", "weight", (F.ln(F.lit(1.0) + F.col("tf")) * F.col("weight")).alias("score"))


def _ln(n: int) -> float:
    import math

    return math.log(n)


def least_weight(n_records: int, max_records: int) -> float:
    """The least weight of a term that at most max_records of n_records records hold: its entropy is at most ln(max_records)."""
    return 1.0 - _ln(max_records) / _ln(n_records) if n_records > 1 else 1.0


def marking_terms(scored: DataFrame, n_records: int, min_texts: int = 4, min_records: int = 2, max_records: int = 6) -> DataFrame:
    """Scored rows whose weight is high enough for a term of at most max_records records; of these, the rows that at least min_texts texts of
    the record hold, and whose term occurs in min_records to max_records records. Every such term has that weight, so the exact bounds drop only terms that
    pass by being very unevenly spread."""
    marked = scored.filter(F.col("weight") >= least_weight(n_records, max_records) - 1e-9)
    return marked.filter((F.col("texts") >= min_texts) & F.col("records").between(min_records, max_records))
