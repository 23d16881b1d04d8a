"""Scores of captions against reference captions: corpus IDF, CIDEr, BLEU, ROUGE-L and METEOR by words and stems.

Tables: references (id, ref_no, caption), hypotheses (id, caption), or (id, of, caption) if several share the references of one
id: `of` is that id then, and scores are given by the hypothesis's own id. References are never copied for it.

No hypothesis is paired with each reference where that can be avoided. What CIDEr and BLEU need of the references of an id is a short list for
each n-gram: how often a reference holds it, how long that reference is, and the sum of 1 / norm over all such references. Only the
longest common subsequence, and words in order, are compared pair by pair; there, equal texts count once, and blocks of texts meet
blocks, so an id of any size is spread over tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import NO_CAPTION, corpus_tokens, or_placeholder, squeeze
from ..session import stored

#: Fixed values of the published metrics.
ORDERS, SIGMA, ROUGE_BETA = 4, 6.0, 1.2
TINY, SMALL = 1e-15, 1e-9
#: Texts of one block of the pairwise comparison, and n-grams of one batch: a batch is that and the n-grams of one text at most.
BLOCK, BATCH = 256, 1 << 17


def cleaned(references: DataFrame, hypotheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References without null and blank ones, and hypotheses that have a reference; a missing hypothesis gets its placeholder."""
    refs = references.select("id", "ref_no", squeeze("caption").alias("caption")).filter("caption <> '' and id is not null")
    of = "of" if "of" in hypotheses.columns else "id"
    hyps = hypotheses.select(*dict.fromkeys(["id", of]), or_placeholder("caption", NO_CAPTION).alias("caption"))
    return refs, hyps.join(refs.select(F.col("id").alias(of)).distinct(), of, "left_semi")


@dataclass
class Texts:
    """Tokens of both sides, stored: refs (no, of, tokens, m), equal texts of an id once with their number m, and hyps (id, of, tokens)."""

    refs: DataFrame
    hyps: DataFrame


def prepared(references: DataFrame, hypotheses: DataFrame, normalise: bool = False) -> Texts:
    """The texts of cleaned(), as tokens; lower-cased with normalise. References of ids without a hypothesis meet nothing and are left out.
    Each table is read once for all scores."""
    refs = squeeze("caption")
    of = "of" if "of" in hypotheses.columns else "id"
    told = references.select(F.col("id").alias("of"), refs.alias("caption")).filter("caption <> '' and of is not null")
    told = told.join(hypotheses.select(F.col(of).alias("of")).distinct(), "of", "left_semi")
    counted = told.select("of", corpus_tokens("caption", normalise).alias("tokens")).groupBy("of", "tokens").agg(F.count("*").alias("m"))
    known = stored(counted.withColumn("no", F.monotonically_increasing_id()), "references")
    hyps = hypotheses.select("id", F.col(of).alias("of"), corpus_tokens(or_placeholder("caption", NO_CAPTION), normalise).alias("tokens"))
    return Texts(known, stored(hyps.join(known.select("of").distinct(), "of", "left_semi"), "hypotheses"))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text, whose tokens are the last column: its n-grams with their number, beside the other columns. A text's own n-grams
    are counted where the text is, which a grouping of all n-grams of all texts would shuffle."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        kept = batch.select(range(batch.num_columns - 1))
        row: list[int] = []
        words: list[int] = []
        sizes: list[int] = []
        grams: list[str] = []
        times: list[int] = []
        for k, tokens in enumerate(texts):
            for n in range(1, min(ORDERS, len(tokens)) + 1):
                counts = Counter(tokens if n == 1 else [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)])
                row += [k] * len(counts)
                words += [len(tokens)] * len(counts)
                sizes += [n] * len(counts)
                grams += counts
                times += counts.values()
            if len(grams) >= BATCH or k == len(texts) - 1:
                own = kept.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(words, pa.int32()), pa.array(sizes, pa.int32()), pa.array(grams, pa.string()), pa.array(times, pa.int64())], names=[*own.schema.names, "words", "n", "gram", "tf"])
                for filled in (row, words, sizes, grams, times):
                    filled.clear()


def _grams(texts: DataFrame) -> DataFrame:
    """The columns of texts but its last one, tokens, with (words, n, gram, tf)."""
    kept = texts.schema.fields[:-1]
    return texts.mapInArrow(_count_grams, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "words int, n int, gram string, tf bigint")


def _met(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with other by sorting. Spark takes n-grams to be as large as the file of the texts they are cut from, a hundredth of
    what they are, and lists of texts as one text, and would send them to the driver to broadcast them."""
    return rows.hint("merge").join(other, on, how)


def document_frequency(corpus: DataFrame, id_col: str = "id", text_col: str = "caption") -> DataFrame:
    """(n, gram, df, idf): in how many ids an n-gram occurs, and ln((ids + 1) / df). All captions of an id are one document."""
    told = corpus.select(F.col(id_col).alias("id"), corpus_tokens(text_col).alias("tokens")).filter("id is not null and size(tokens) > 0")
    rows = stored(told, "corpus")
    n_ids = rows.agg(F.count_distinct("id")).first()[0]
    counted = _grams(rows).select("id", "n", "gram").distinct().groupBy("n", "gram").agg(F.count("*").alias("df"))
    return counted.select("n", "gram", "df", F.ln((F.lit(n_ids) + 1) / F.col("df")).alias("idf"))


def _norms(texts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """texts (…, tokens) with norms, an array of the norms of the weighted n-grams for each n, before the tokens."""
    weighted = _met(_grams(texts.select(key, "tokens")), idf.select("n", "gram", "idf"), ["n", "gram"])
    square = F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf")
    found = weighted.groupBy(key).agg(F.array(*(F.sqrt(F.sum(F.when(F.col("n") == n, square).otherwise(0.0))) for n in range(1, ORDERS + 1))).alias("norms"))
    return texts.join(found, key, "left").select(*(c for c in texts.columns if c != "tokens"), "norms", "tokens")


def _overlaps(texts: Texts, idf: DataFrame | None) -> DataFrame:
    """(id, total, c1 to c4) of hypotheses that share an n-gram with a reference: the sum of similarities of CIDEr (null without idf), and clipped counts."""
    refs, hyps = texts.refs.select("no", "of", "m", "tokens"), texts.hyps.select("id", "of", "tokens")
    if idf is not None:
        refs, hyps = _norms(refs, "no", idf), _norms(hyps, "id", idf)
    else:
        refs, hyps = (x.select(*x.columns[:-1], F.lit(None).cast("array<double>").alias("norms"), "tokens") for x in (refs, hyps))

    def norm() -> Column:
        return F.get("norms", F.col("n") - 1)

    h = _grams(hyps).withColumn("norm", norm())
    h = _met(h, idf.select("n", "gram", "idf"), ["n", "gram"], "left") if idf is not None else h.withColumn("idf", F.lit(0.0))
    inverse = F.when(norm() > 0, F.col("m") / norm()).otherwise(0.0)
    entries = _grams(refs.drop("no")).repartition("of", "n", "gram").groupBy("of", "n", "gram", "tf", "words").agg(F.sum(inverse).alias("inverse"))
    known = entries.groupBy("of", "n", "gram").agg(F.collect_list(F.struct("tf", "words", "inverse")).alias("entries"), F.max("tf").alias("most"))  # by counts and lengths, not by references
    met = _met(h, known, ["of", "n", "gram"])

    def bigrams(words: Column) -> Column:
        return F.greatest(words - 1, F.lit(0))

    def add(total: Column, e: Column) -> Column:
        apart = (bigrams(F.col("words")) - bigrams(e["words"])).cast("double")
        return total + F.least(F.col("tf"), e["tf"]) * e["tf"] * e["inverse"] * F.exp(-(apart * apart) / (2 * SIGMA * SIGMA))

    similar = F.when(F.col("norm") > 0, F.aggregate("entries", F.lit(0.0), add) * F.col("idf") * F.col("idf") / F.col("norm")) if idf is not None else F.lit(None).cast("double")
    rows = met.select("id", "n", similar.alias("similar"), F.least("tf", "most").alias("clipped"))
    return rows.groupBy("id").agg(F.sum("similar").alias("total"), *(F.sum(F.when(F.col("n") == n, F.col("clipped")).otherwise(0)).alias(f"c{n}") for n in range(1, ORDERS + 1)))


def _gram_scores(texts: Texts, idf: DataFrame | None) -> DataFrame:
    """(id, cider, bleu1 to bleu4) of each hypothesis."""
    lengths = texts.refs.groupBy("of").agg(F.sum("m").alias("n_refs"), F.collect_set(F.size("tokens")).alias("lengths"))  # different lengths only
    t = F.size("tokens")
    closest = F.array_min(F.transform("lengths", lambda n: F.struct(F.abs(n - F.col("t")).alias("d"), n.alias("n"))))["n"]
    base = texts.hyps.select("id", "of", t.alias("t"))
    base = _met(base, lengths, "of").select("id", "t", "n_refs", closest.alias("l"))
    weights = None if idf is None else stored(idf.select("n", "gram", "idf"), "idf")  # three joins read it
    rows = base.join(_overlaps(texts, weights), "id", "left").fillna(0, [f"c{n}" for n in range(1, ORDERS + 1)])
    ratio = (F.col("t") + TINY) / (F.col("l") + SMALL)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    logs = [F.ln((F.col(f"c{n}") + TINY) / (F.greatest(F.col("t") - n + 1, F.lit(0)) + SMALL)) for n in range(1, ORDERS + 1)]
    bleus = [(F.exp(sum(logs[:n], F.lit(0.0)) / n) * penalty).alias(f"bleu{n}") for n in range(1, ORDERS + 1)]
    return rows.select("id", F.coalesce(F.col("total") / ORDERS / F.col("n_refs") * 10, F.lit(0.0)).alias("cider"), *bleus)


def cider(references: DataFrame, hypotheses: DataFrame, idf: DataFrame, normalise: bool = False) -> DataFrame:
    """(id, cider) with corpus IDF: mean over n and references of clipped cosine similarities, times 10, with a penalty for lengths.

    The length of a text is its number of bigrams. An n-gram the corpus lacks weighs 0. Unless normalise, texts are taken as
    they are although the corpus is lower-cased. Ids without reference are left out."""
    return _gram_scores(prepared(references, hypotheses, normalise), idf).select("id", "cider")


def bleu(references: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(id, bleu1, bleu2, bleu3, bleu4) of single texts: clipped precision with tiny constants against zero, and the brevity penalty
    for the closest reference length, the shorter one on ties."""
    return _gram_scores(prepared(references, hypotheses), None).drop("cider")


def places(words: list[str]) -> dict[str, int]:
    """The places of each word, as bits."""
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def lcs_length(a: list[str], b: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of a and a text of `size` words given by its places(): a row of the table is a number, whose
    zero bits are the steps of the row."""
    full = (1 << size) - 1
    row = full
    for w in a:
        if hit := row & b.get(w, 0):
            row = (row + hit | row - hit) & full
    return size - row.bit_count()


def _matches(h: list[str], r: dict[str, int]) -> tuple[int, int]:
    """Words of h found in the text of places() r, each word of it once, and the number of runs in which they lie. A word goes on a run if it can,
    else it takes its first free place."""
    free = dict(r)
    last, runs, found = -2, 0, 0
    for w in h:
        own = free.get(w, 0)
        if not own:
            last = -2
            continue
        at = last + 1 if last >= -1 and own >> last + 1 & 1 else (own & -own).bit_length() - 1
        free[w] = own & ~(1 << at)
        runs += at != last + 1
        last, found = at, found + 1
    return found, runs


def meteor(found: int, runs: int, h: int, r: int) -> float:
    """Harmonic mean of precision and recall, which counts nine times, less up to a half for matches that are scattered."""
    if not found:
        return 0.0
    p, q = found / h, found / r
    return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (runs / found) ** 3)


def _pair_scores(stems: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, best = [], []
            for hyps, refs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [(places(r), len(r)) for r in refs]
                stemmed = [places([stem(w) for w in r]) for r in refs] if stems else [p for p, _ in own]
                seen: dict[tuple, tuple] = {}
                for h in hyps:
                    words = h["tokens"]
                    if (key := tuple(words)) not in seen:
                        short = [stem(w) for w in words] if stems else words
                        common = [(lcs_length(words, p, n), n) for p, n in own]
                        seen[key] = (
                            max(c for c, _ in common) / max(1, len(words)),
                            max(c / max(1, n) for c, n in common),
                            max(meteor(*_matches(short, p), len(words), n) for p, (_, n) in zip(stemmed, own, strict=True)),
                        )
                    ids.append(h["id"])
                    best.append(seen[key])
            columns = list(zip(*best, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type.value_type.field("id").type), *(pa.array(list(c), pa.float64()) for c in columns)], names=["id", "precision", "recall", "meteor"])

    return run


def _blocks(texts: DataFrame, what: Column, name: str) -> DataFrame:
    """(of, name): the texts of each id in lists of about BLOCK."""
    sizes = texts.groupBy("of").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = texts.join(sizes, "of").withColumn("block", F.pmod(F.xxhash64("tokens"), F.col("blocks")))
    return placed.groupBy("of", "block").agg(F.collect_list(what).alias(name)).drop("block")


def _pairs(texts: Texts, stems: bool) -> DataFrame:
    """(id, rouge_l, meteor) of each hypothesis."""
    hyps = _blocks(texts.hyps, F.struct("id", "tokens"), "hyps")
    refs = _blocks(texts.refs, F.col("tokens"), "refs")
    kind = texts.hyps.schema["id"].dataType.simpleString()
    scored = _met(hyps, refs, "of").select("hyps", "refs").mapInArrow(_pair_scores(stems), f"id {kind}, precision double, recall double, meteor double")
    best = scored.groupBy("id").agg(F.max("precision").alias("p"), F.max("recall").alias("r"), F.max("meteor").alias("meteor"))
    b2 = ROUGE_BETA**2
    f = F.when((F.col("p") > 0) & (F.col("r") > 0), (1 + b2) * F.col("p") * F.col("r") / (F.col("r") + b2 * F.col("p"))).otherwise(0.0)
    return best.select("id", f.alias("rouge_l"), "meteor")


def rouge_meteor(references: DataFrame, hypotheses: DataFrame, stems: bool = False) -> DataFrame:
    """(id, rouge_l, meteor): ROUGE-L from the best precision and the best recall over references, and METEOR by equal words, or
    with `stems` by words of equal stem (no synonyms or paraphrases), the best over references."""
    return _pairs(prepared(references, hypotheses), stems)


def all_metrics(references: DataFrame, hypotheses: DataFrame, idf: DataFrame, stems: bool = False) -> DataFrame:
    """(id, cider, bleu1, bleu4, rouge_l, meteor), from one set of prepared texts."""
    texts = prepared(references, hypotheses)
    return _gram_scores(texts, idf).select("id", "cider", "bleu1", "bleu4").join(_pairs(texts, stems), "id")


def input_diagnostics(references: DataFrame, hypotheses: DataFrame, few: int = 50) -> DataFrame:
    """One row: ids, references, blank references and hypotheses, and whether there are too few ids for a corpus score."""
    refs = references.agg(F.count("*").alias("n_references"), F.count_if(F.coalesce(F.trim("caption"), F.lit("")) == "").alias("blank_references"))
    hyps = hypotheses.agg(F.count_distinct("id").alias("n_ids"), F.count_if(F.coalesce(F.trim("caption"), F.lit("")) == "").alias("blank_hypotheses"))
    return refs.join(F.broadcast(hyps)).withColumn("too_few", F.col("n_ids") < few)


def reference_coverage(references: DataFrame) -> DataFrame:
    """One row: videos with references, references, their mean number, and videos with fewer than two."""
    per = references.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_videos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_references"), F.avg("n").alias("mean_references"), F.count_if(F.col("n") < 2).alias("n_sparse"))
