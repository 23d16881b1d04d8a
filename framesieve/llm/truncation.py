"""Problem 7: texts that were cut off, and how often each source cuts.

Lengths: for each source, the hazard of a length is the share of the texts at least that long that end there. By
window functions it is compared with the hazards of neighbouring lengths; lengths whose count is too high for a Poisson
variable of the neighbours' rate, at a false-discovery rate of q within a source, are its limits, in characters or words.

Endings: a text is complete if it ends with sentence punctuation, and cut if it ends with a sign of a cut, with
an open bracket or comma, or without punctuation although its own style, that of its source, has it. What is left, clauses
without a full stop, is judged by how words end and go on in all such clauses: the last word, the last pair, the two words before the
last, and the two before those. A last word hardly seen elsewhere that begins many others was cut inside.

Verdict: at a limit every ending that is not complete is cut, unless the words there say that clauses often end so. Elsewhere, where texts are
cut too, the ending has to tell by itself: a sign of a cut, the style of the source, or words that hardly ever end a clause. The report says which it was.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .common import joined_by_key

TERMINAL = re.compile(r"[.!?。।؟！？][\"'”’»)\]*_]*$")
#: Signs by which a text says itself that it was cut: dots, or a remark in brackets at its end.
SIGN = re.compile(r"(?:\.\.+|…)[\])]*$|\[[^\[\]]{0,20}\]$")
INNER_END = re.compile(r"[.!?。।؟！？][\"'”’»)\]]*\s")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:,。।؟！？]")
ENDS = frozenset(".!?。।؟！？")


def shown(text: str | None) -> str:
    """The text without white space and pictures at its end."""
    end = len(text := text or "")
    while end and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("So", "Sk", "Mn", "Cf") and text[end - 1] != "�"):
        end -= 1
    return text[:end]


def ending(text: str | None) -> str:
    """blank, complete, cut, or open: no punctuation where the words have to tell; `loose` if the style is to tell."""
    text = shown(text)
    if not any(map(str.isalnum, text)):
        return "blank"
    if SIGN.search(text):
        return "cut"
    if TERMINAL.search(text):
        return "complete"
    last = text[-1]
    if last in "\"”»’)]":
        return "complete"
    if not last.isalnum():
        return "cut"
    if INNER_END.search(text):
        return "cut"
    return "open" if clause(text) else "loose"


def clause(text: str) -> bool:
    """A single clause that begins small."""
    return not INNER_END.search(text) and not begins_large(text)


def begins_large(text: str) -> bool:
    return next(x for x in text if x.isalnum()).isupper()


def tokens(text: str) -> list[str]:
    return ["0" if x.isdecimal() else x for x in TOKEN.findall(text.lower())]


def keys_at(words: list[str], k: int) -> tuple[str, str, str, str]:
    """What is counted of the word at k: itself, with the one before, the two before it whatever it is, and the two before the last two."""
    one, two, three = (words[k - n] if k >= n else "^" for n in (1, 2, 3))
    return f"1 {words[k]}", f"2 {one} {words[k]}", f"3 {two} {one}", f"4 {three} {two}"


def evidence(texts: list[str | None]) -> dict[str, list[int]]:
    """For each key how often it occurs, and how often a clause ends there. Texts are distinct: a copy would speak for its own ending.

    How words end and go on is counted in single clauses, apart for those that begin small and those that begin large (keys
    of L): in sentences the same words are followed by more. A last word without a full stop may be cut
    itself; it counts as an end, but not as a word that was seen (key s). Prefixes (key p) count the words seen."""
    seen: dict[str, list[int]] = {}
    pieces: Counter[str] = Counter()
    for text in texts:
        state = ending(text)
        if state == "blank":
            continue
        words = tokens(text := shown(text))
        own_style = state in ("open", "loose", "complete") and not INNER_END.search(text)
        style = "L" if begins_large(text) else ""
        for k, word in enumerate(words):
            if not word[0].isalnum():
                continue
            unsure = k == len(words) - 1 and state != "complete"
            if not unsure:
                pieces[word] += 1
            if own_style:
                final = unsure or k == len(words) - 1 or words[k + 1] in ENDS
                for key in keys_at(words, k):
                    entry = seen.setdefault(style + key, [0, 0])
                    entry[0] += 1
                    entry[1] += final
    for word, n in pieces.items():
        seen[f"s {word}"] = [n, 0]
        for k in range(1, len(word)):
            seen.setdefault(f"p {word[:k]}", [0, 0])[0] += n
    return seen


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = evidence(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["key", "n", "ends"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts as shown, with single spaces, so that copies are equal; blank ones are left out."""
    for batch in batches:
        spelled = (" ".join(shown(t).split()) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([t for t in spelled if t], pa.string())], names=["text"])


def _state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            state = ending(text)
            words = tokens(shown(text)) if state in ("open", "loose") else []
            style = "L" if state == "loose" else ""
            keys = [*(style + key for key in keys_at(words, len(words) - 1)), f"s {words[-1]}", f"p {words[-1]}"] if words else None
            rows.append((state, len(text or ""), len((text or "").split()), keys, state == "complete" and begins_large(text)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_()), strict=True))], names=["id", "source", "state", "chars", "words", "keys", "closed"])


def length_limits(lengths: DataFrame, reach: int = 10, q: float = 0.001, least: int = 20, excess: float = 5.0) -> DataFrame:
    """(source, unit, length, n, hazard, usual_hazard) of the lengths at which a source stops far too often.

    Far too often is significantly and by a factor of at least `excess`: lengths of natural clauses are not spread evenly either.

    lengths has rows (source, unit, length), a row a text. usual_hazard is the rate at the lengths at most `reach` away,
    with one more end among them than there is, so that a lone long text is no finding. The Poisson tail is bounded from
    above by Chernoff's inequality; lengths with fewer than `least` ends are not tested."""
    counts = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    by = W.partitionBy("source", "unit")
    risk = counts.withColumn("at_risk", F.sum("n").over(by.orderBy(F.desc("length"))))
    near = by.orderBy("length").rangeBetween(-reach, reach)
    # Texts at risk next to L are about those at L and those that end there; observed lengths alone would miss the empty ones.
    around = risk.withColumn("ends", F.sum("n").over(near) - F.col("n")).withColumn("usual", (F.col("ends") + 1) / (2 * reach * F.col("at_risk")))
    expected = F.col("usual") * F.col("at_risk")
    tested = around.filter(F.col("n") >= least).withColumn("log_p", F.when(F.col("n") > expected, F.col("n") - expected - F.col("n") * F.ln(F.col("n") / expected)).otherwise(F.lit(0.0)))
    ranked = tested.withColumn("rank", F.row_number().over(by.orderBy("log_p", "length"))).withColumn("tests", F.count("*").over(by))
    passed = ranked.withColumn("last", F.max(F.when(F.col("log_p") <= F.ln(F.lit(q) * F.col("rank") / F.col("tests")), F.col("rank"))).over(by))
    return passed.filter((F.col("rank") <= F.col("last")) & (F.col("n") >= F.lit(excess) * F.col("usual") * F.col("at_risk"))).select("source", "unit", "length", "n", (F.col("n") / F.col("at_risk")).alias("hazard"), F.col("usual").alias("usual_hazard"))


def truncation(df: DataFrame, id_col: str, text_col: str, source_col: str, low: float = 0.1, low_at_limit: float = 0.3, never: float = 0.02, punctuated: float = 0.6, few: int = 20) -> tuple[DataFrame, DataFrame]:
    """(report, limits): report is (id_col, source, chars, words, at_limit, state, end_rate, reason, cut), a row for each row of df.

    state is how the ending looks by itself (see ending()), end_rate the smoothed share of ends in its place where that
    was needed. reason tells why a text is cut: `limit` (an ending that is not complete, at the length of a limit, with an end_rate below low_at_limit),
    and elsewhere `ending` (its state), `style` or `words` (an end_rate below low); null if it is not cut. Null, empty and blank texts are never cut, nor
    are complete ones at a limit. A capitalised clause without a full stop is cut if its source closes `punctuated` of its capitalised texts
    (with `few` texts of the collection's share added); in other sources its words decide. A null source is a source of its own. Other columns of df are ignored."""
    chosen = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    states = stored(chosen.mapInArrow(_state, f"id {kind}, source string, state string, chars bigint, words bigint, keys array<string>, closed boolean").withColumn("row", F.monotonically_increasing_id()), "endings")
    told = states.filter("state <> 'blank'")
    limits = length_limits(told.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("words").alias("unit"), F.col("words").alias("length")))).alias("l")).select("source", "l.*"))

    def at(unit: str) -> DataFrame:
        return limits.filter(F.col("unit") == unit).select(F.col("source").alias(f"{unit}_source"), F.col("length").alias(f"{unit}_length"))

    placed = states
    for unit in ("chars", "words"):
        placed = placed.join(at(unit), F.col("source").eqNullSafe(F.col(f"{unit}_source")) & (F.col(unit) == F.col(f"{unit}_length")), "left")
    at_limit = F.col("chars_length").isNotNull() | F.col("words_length").isNotNull()
    placed = placed.withColumn("at_limit", at_limit)

    # Capital letters at the start: does this source close such texts? Those at its limits tell less of its style, since they may
    # be cut there, and count a tenth. A source with few of them is taken to be as the collection is.
    weight = F.when(F.col("at_limit"), 0.1).otherwise(1.0)
    style = placed.filter("closed or state = 'loose'").groupBy(F.col("source").alias("style_source")).agg(F.sum(F.when(F.col("closed"), weight).otherwise(0.0)).alias("closed"), F.sum(weight).alias("large"))
    total = style.agg((F.sum("closed") / F.sum("large")).alias("usual"))  # one row
    closes = style.join(F.broadcast(total)).select("style_source", ((F.col("closed") + few * F.col("usual")) / (F.col("large") + few) >= punctuated).alias("closes"))
    usual = total.select((F.coalesce("usual", F.lit(1.0)) >= punctuated).alias("usually_closes"))

    # A text delivered again says nothing new: copies of a cut text would vouch for its ending.
    once = chosen.filter("text is not null").select("text").mapInArrow(_spelled, "text string").distinct()
    counts = stored(once.mapInArrow(_count, "key string, n bigint, ends bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "counts")
    asked = states.filter("state in ('open', 'loose')").select("row", F.posexplode("keys").alias("at", "key"))
    met = joined_by_key(asked, counts, "key").groupBy("row").agg(*(F.coalesce(F.sum(F.when(F.col("at") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in range(6) for c in ("n", "ends")))
    smooth = F.lit(4.0)  # pseudo-counts of the wider evidence; the ending that is asked for does not speak for itself

    def share(k: int, wider: Column) -> Column:
        return (F.col(f"ends{k}") - 1 + smooth * wider) / (F.col(f"n{k}") - 1 + smooth)

    word, place = share(0, F.lit(0.5)), share(2, F.lit(0.1))
    # A word that never ends a clause is no end; else one of its neighbourhoods must be one where clauses end.
    around = F.greatest(share(1, F.least(word, place)), share(3, place))
    inside = F.col("n4") * 200 < F.col("n5")  # hardly ever a word, but the beginning of many
    rate = F.when(inside, 0.0).when(word < never, word).otherwise(around)
    rates = met.select("row", rate.alias("end_rate"))

    joined = placed.join(rates, "row", "left").join(closes, F.col("source").eqNullSafe(F.col("style_source")), "left").join(F.broadcast(usual))  # one row
    told_by_words = F.col("state").isin("open", "loose")
    by_limit = F.col("at_limit") & ((F.col("state") == "cut") | told_by_words & (F.col("end_rate") < low_at_limit))
    by_style = (F.col("state") == "loose") & F.coalesce("closes", "usually_closes")
    reason = F.when(by_limit, "limit").when(F.col("state") == "cut", "ending").when(by_style, "style").when(told_by_words & (F.col("end_rate") < low), "words")
    report = joined.select(F.col("id").alias(id_col), "source", "chars", "words", "at_limit", "state", "end_rate", reason.alias("reason"), reason.isNotNull().alias("cut"))
    return report, limits


def cut_rates(report: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, cut_rate, n_at_limit, n_by_limit): texts that are not blank, how many were cut, how many have a limit's length, and how many
    of these were cut there."""
    told = report.filter("state <> 'blank'")
    return told.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_rate"), F.count_if("at_limit").alias("n_at_limit"), F.count_if(F.col("reason") == "limit").alias("n_by_limit"))
