"""Problem 10: pages stuffed with keywords, links or product tags instead of sentences.

A text is divided into segments by lines and sentence ends, and neighbouring segments of one kind, sentences or not,
form a block. Links, hash tags, prices and numbers of a block are put as one sign each, and the deflate ratio of what is
left is divided by the mean ratio of blocks of sentences of the same length and language in the whole collection. A block
is stuffed if it is no block of sentences and its normalised ratio is low, or if it looks like sentences, has hardly any
function words, and its ratio is extremely low.

Compression alone can't decide: lists of products hardly repeat a word, while loops of whole sentences compress
best of all. The sentence density therefore decides before the ratio does, and the signs make lists redundant. A sign at
the end makes no sentence of a list: the words for each comma, bar, link, tag and price count, how long the segment
goes on without a sign, and the share of function words.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Each alternative is linear: it starts only where it could not have started before, and what it repeats it does not give back.
LINK = re.compile(r"<a\s[^<>]*+>[^<]*+</a>|\[[^\[\]\n]*+\]\([^()\s]*+\)|(?:https?://|www\.)\S++|(?<![\w.-])(?P<host>[\w.-]++)/\S*+", re.IGNORECASE)
HOST = re.compile(r"[\w-]++(?:\.[\w-]++)*+")
TAG = re.compile(r"(?<![\w&])#\w+")
PRICE = re.compile(r"[$€£¥]\s?\d[\d.,]*")
NUMBER = re.compile(r"\d+")
WORD = re.compile(r"[^\W_]+")
#: Runs of letters and digits that are no words, such as hashes and encoded data.
BLOB = re.compile(r"[A-Za-z0-9_+/=]{40,}")
#: Signs that end sentences, those of scripts that put no space after them, and what may close a sentence behind its sign.
SIGNS, WIDE_SIGNS, CLOSERS = ".!?。।؟…！？", "。！？", "\"'”’»)]"
END = re.compile(f"[{SIGNS}]++[{re.escape(CLOSERS)}]*+")
LINE = re.compile(r"[^\n\r]++")
BREAK = re.compile(r"[\n\r]++\s*+")
SPACE = re.compile(r"\s*+")
#: Letters of scripts that put no space between words.
WIDE = re.compile("[฀-๿぀-ヿ㐀-鿿]")
#: What parts the items of a list; between letters of WIDE scripts a space does, too.
PART = re.compile(r"[,;|•·、，；｜،؛]")
WIDE_PART = re.compile(rf"{WIDE.pattern}\s+(?={WIDE.pattern})")
#: Letters of the scripts whose function words are known.
JUDGED = re.compile(r"[a-zß-ɏа-ё]")
#: Words that hold sentences together, of languages in Latin and Cyrillic letters.
FUNCTION = frozenset(
    """a an the this that these those and or but if of to in on at by for from with as is are was were be been has have had do does did not it its he she they we you i
    his her their our your my which who what when where while until before after then than there so into over under near about one another it's
    der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war im in am an auf aus bei mit nach von vor zu zum zur er sie es ich wir ihr sich wie als dass auch
    le la les l un une des du de d et ou mais ne pas est sont était dans sur sous avec pour par en au aux il elle ils elles on nous vous je que qui se ce cette son sa ses
    el los las una unos del y o pero no es son era al con por para sobre lo su sus yo él ella que se como más
    il gli e ed di da per non è sono nel della che si um uma os as do da dos das na nos em não é com het een van voor niet zijn w z na nie się i jest to że ve bir bu
    и в во на с со к у о об от до из за по под не что это как а но он она они мы вы я его её их был была быть для при""".split()
)
#: Segments of more words than these are sentences only if function words hold them together.
LONG_SENTENCE = 60
#: Blocks that are not of sentences are stuffed below LOW of the usual ratio, thin blocks of sentences below EXTREME. What is no sentence was judged by its
#: density already; LOW only spares text that is as varied as prose, and lies above the ratios of lists, whose links and prices are signs.
LOW, EXTREME = 0.85, 0.5


def is_host(name: str) -> bool:
    """Labels joined by single dots, the last one of two letters at least."""
    last = name.rpartition(".")[2]
    return len(last) < len(name) and len(last) > 1 and last.isascii() and last.isalpha() and HOST.fullmatch(name) is not None


def without_links(text: str, sign: str) -> str:
    """The text with a sign for each link; a text without any character that links need is not searched."""
    if "/" not in text and "](" not in text and "www." not in text.lower():
        return text
    return LINK.sub(lambda m: sign if m["host"] is None or is_host(m["host"].lstrip(".-")) else m.group(), text)


def segments(text: str) -> list[str]:
    """The text cut behind sentence signs that white space or the end follows; a line without one behind each sign of scripts without spaces; and at line ends.

    White space belongs to the segment before it. The segments together are the text; one pass, whatever the text is."""
    out, at = [], 0
    while at < len(text):
        line = LINE.match(text, at)
        if not line:
            end = BREAK.match(text, at).end()
            out.append(text[at:end])
            at = end
            continue
        stop = line.end()
        for m in END.finditer(text, at, stop):
            if m.end() == len(text) or text[m.end()].isspace():
                end = SPACE.match(text, m.end()).end()
                out.append(text[at:end])
                at = end
        if at >= stop:
            continue
        for k in range(at, stop) if not text.isascii() else ():
            if text[k] in WIDE_SIGNS:
                out.append(text[at : k + 1])
                at = k + 1
        if at < stop:
            tail = BREAK.match(text, stop)
            out.append(text[at : tail.end() if tail else stop])
            at += len(out[-1])
    return out


def ends_well(segment: str) -> bool:
    """Whether a sentence sign, with nothing but closing signs behind it, ends the segment."""
    return segment.rstrip().rstrip(CLOSERS).endswith(tuple(SIGNS))


def function_share(words: list[str]) -> float:
    return sum(w in FUNCTION for w in words) / max(1, len(words))


def has_known_letters(words: list[str]) -> bool:
    """Whether nearly all letters are of scripts whose function words are known."""
    return len(JUDGED.findall(letters := "".join(w for w in words if not w.isdecimal()))) >= 0.9 * len(letters)


def is_sentence(segment: str) -> bool:
    """Ends with sentence punctuation, has, beside links, tags and prices, at least five words (or eight letters of a script
    without spaces), and is no list: under five of them an item or very many in all, and hardly a function word among them.

    One word said over and over is a loop, not a list."""
    if not ends_well(segment):
        return False
    rest = without_links(segment, " \x01 ")
    if "#" in rest:
        rest = TAG.sub(" \x01 ", rest)
    rest, prices = PRICE.subn(" \x01 ", rest)
    words = WORD.findall(rest)
    wide = 0 if rest.isascii() else len(WIDE.findall(rest))
    if len(words) < 5 and wide < 8:
        return False
    parts = len(PART.findall(rest)) + rest.count("\x01")
    if wide >= 8 and 2 * wide > sum(map(len, words)):
        parts += len(WIDE_PART.findall(rest))
        return parts < 4 or wide >= 5 * (parts + 1)
    dense = (parts >= 4 or prices) and len(words) < 5 * (parts + 1)
    if not dense and len(words) <= LONG_SENTENCE:
        return True
    words = [w.lower() for w in words]
    if not has_known_letters(words):
        return not dense
    return parts <= len(words) and function_share(words) >= 0.2 or len(set(words)) == 1


def is_thin(block: str) -> bool:
    """Different words with hardly a function word among them, whatever their punctuation."""
    words = WORD.findall(without_links(block.lower(), " "))
    return len(set(words)) > 1 and function_share(words) < 0.1 and has_known_letters(words)


def deflated(raw: bytes) -> int:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    return len(squeeze.compress(raw)) + len(squeeze.flush())


def blocks(text: str) -> list[tuple[bool, bool, int, int, int]]:
    """(of sentences, of thin ones that compress well, characters, bytes, deflated bytes of the signs) of each block; characters of blobs, and of blocks
    that are mostly neither letters nor links (tables of numbers, code), do not count."""
    out = []
    for sentences, group in itertools.groupby(segments(text), key=is_sentence):
        block = "".join(group)
        unlinked = without_links(block.lower(), "\x01")
        plain = TAG.sub("\x02", unlinked) if "#" in unlinked else unlinked
        signs = BLOB.sub("", plain) if max(map(len, plain.split()), default=0) >= 40 else plain
        chars = len(block) - (len(plain) - len(signs))
        if not sentences:
            letters = len(block) - len(plain) + sum(map(str.isalpha, signs))  # links and tags count as letters
            if letters < 0.4 * len(block):
                chars = 0
        size = max(1, len(block.encode("utf-8", "surrogatepass")))
        squeezed = deflated(NUMBER.sub("0", PRICE.sub("\x03", signs)).encode("utf-8", "surrogatepass"))
        out.append((sentences, sentences and squeezed < EXTREME * size and is_thin(block), chars, size, squeezed))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks(t) for t in batch.column(2).to_pylist()]
        kind = pa.list_(pa.struct([("sentences", pa.bool_()), ("thin", pa.bool_()), ("chars", pa.int64()), ("bytes", pa.int64()), ("deflated", pa.int64())]))
        listed = pa.array([[{"sentences": s, "thin": n, "chars": c, "bytes": b, "deflated": z} for s, n, c, b, z in f] for f in found], kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in batch.column(2).to_pylist()], pa.int64()), listed], names=["id", "lang", "size", "blocks"])


def block_report(df: DataFrame, id_col: str, text_col: str, lang_col: str, low: float = LOW, min_blocks: int = 20) -> DataFrame:
    """(id_col, n_chars, stuffed_chars, stuffed_share, least_ratio) for each row with a text, equal rows included.

    least_ratio is the least normalised ratio of a block that is not of sentences, or of thin ones, null without such a block. Null texts
    take no part; empty texts have zeros. A language with fewer than min_blocks blocks of a length, or a null one,
    is measured against all languages together, a length with fewer
    in all languages against the nearest that has them. Whole texts are read; other columns
    of df are ignored."""
    chosen = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    kind = chosen.schema["id"].dataType.simpleString()
    features = stored(chosen.mapInArrow(_features, f"id {kind}, lang string, size bigint, blocks array<struct<sentences: boolean, thin: boolean, chars: bigint, bytes: bigint, deflated: bigint>>"), "blocks")
    each = features.select("lang", F.explode("blocks").alias("b")).filter("b.sentences and not b.thin")
    band, ratio = F.ceil(F.log2(F.col("b.bytes") + 1)).cast("int"), F.col("b.deflated") / F.col("b.bytes")
    totals = stored(each.groupBy("lang", band.alias("band")).agg(F.count("*").alias("n"), F.sum(ratio).alias("total")), "ratios")
    bands = totals.groupBy("band").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("m")).collect()  # a row a doubling of length
    everywhere = {r.band: r.m for r in bands if r.n >= min_blocks} or {r.band: r.m for r in bands}
    # What is usual in a language goes to its rows by a join: there may be any number of languages, and one of them may have most rows.
    own = totals.filter((F.col("n") >= min_blocks) & F.col("lang").isNotNull()).groupBy("lang").agg(F.collect_list(F.struct("band", (F.col("total") / F.col("n")).alias("mean"))).alias("usual"))
    met = features.join(own, "lang", "left").select("id", "size", "blocks", "usual")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = sorted(everywhere)
        for batch in batches:
            rows = []
            for size, listed, means in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                stuffed, least = 0, None
                for b in listed:
                    if b["sentences"] and not b["thin"]:
                        continue
                    band = b["bytes"].bit_length()
                    usual = next((x["mean"] for x in means or () if x["band"] == band), None) or (everywhere[min(nearest, key=lambda x: abs(x - band))] if nearest else 0.6)
                    ratio = b["deflated"] / b["bytes"] / usual
                    least = ratio if least is None else min(least, ratio)
                    stuffed += b["chars"] if ratio < (EXTREME if b["thin"] else low) else 0
                rows.append((size, stuffed, stuffed / max(1, size), least))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], names=[id_col, "n_chars", "stuffed_chars", "stuffed_share", "least_ratio"])

    return met.mapInArrow(judge, f"`{id_col}` {kind}, n_chars bigint, stuffed_chars bigint, stuffed_share double, least_ratio double")


def stuffed_pages(report: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows of block_report() of which more than `share` of the characters lie in stuffed blocks."""
    return report.filter(F.col("stuffed_share") > share)
