"""Problem 9: evaluation texts that leak into training text.

One Aho-Corasick automaton reads each document once, as a sequence of words numbered by the vocabulary of the items. Its patterns are
the items cut into blocks of half a passage's words: `width` consecutive words always hold a whole block. Where a block
is met, the words before and after it are compared with the item's, so the longest shared run comes out; its place is given in the original text.
The automaton thus has at most a node for each word of the items, and none of them twice, however the passages overlap.

Items with equal words are one class, searched and reported once under its smallest id; item_classes() has the members.

What a worker holds is bounded: items are divided into shards of about SHARD_WORDS words, each with an automaton of its own, built once a
worker, and a pass over the documents. Test material of a few MB is one shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import _WORD_PY, _plain, py_words, words

#: Words of the items of one shard; the tests measure what the automaton of so many takes.
SHARD_WORDS = 2_000_000


class Scanner:
    """The automaton of some items, given as (item, words), for passages of at least `width` words."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int) -> None:
        self.width, self.block = width, (width + 1) // 2
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        blocks: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, own in items:
            if len(own) >= width:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]
                for k in range(0, len(ids) - self.block + 1, self.block):
                    blocks.setdefault(tuple(ids[k : k + self.block]), []).append((len(self.items), k))
                self.items.append((item, ids))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if blocks else None
        for block, places in blocks.items():
            self.automaton.add_word(block, places)
        if blocks:
            self.automaton.make_automaton()

    def runs(self, own: list[str]) -> list[tuple[int, int, int]]:
        """(item, first, last) of each longest run of words, in words of a document, that it shares with an item at one place."""
        if self.automaton is None or len(own) < self.width:
            return []
        known = self.vocabulary.get
        doc = tuple([known(w, 0) for w in own])
        if not any(doc):
            return []
        upto: dict[tuple[int, int], int] = {}
        found = []
        for end, places in self.automaton.iter(doc):
            start = end - self.block + 1
            for k, place in places:
                if upto.get((k, start - place), -1) >= end:
                    continue
                item, ids = self.items[k]
                a, b = start, end + 1
                while a and a - start + place and doc[a - 1] == ids[a - 1 - start + place]:
                    a -= 1
                while b < len(doc) and b - start + place < len(ids) and doc[b] == ids[b - start + place]:
                    b += 1
                upto[k, start - place] = b - 1
                if b - a >= self.width:
                    found.append((item, a, b - 1))
        return found


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of py_words(text), in characters of the original text."""
    lower = text.lower()
    spans = []
    for m in _WORD_PY.finditer(lower):
        if _plain(m.group()):
            spans.append(m.span())
            continue
        start = None
        for k in range(m.start(), m.end() + 1):
            letter = k < m.end() and (lower[k].isalpha() or lower[k].isdecimal())
            if letter and start is None:
                start = k
            elif not letter and start is not None:
                spans.append((start, k))
                start = None
    if len(lower) == len(text):
        return spans
    origin = [k for k, x in enumerate(text) for _ in x.lower()]  # a letter whose lower case has several characters
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


def passages(text: str, scanner: Scanner) -> list[tuple[int, int, int, int]]:
    """(item, words, start, end) of each longest run of words that the text shares with an item at one place."""
    found = scanner.runs(py_words(text))
    if not found:
        return []
    spans = word_spans(text)
    return sorted((item, last - first + 1, spans[first][0], spans[last][1]) for item, first, last in found)


#: The scanner this worker used last, by the search it belongs to.
_BUILT: dict[str, Scanner] = {}


def _scanner(name: str, items, width: int) -> Scanner:
    if name not in _BUILT:
        _BUILT.clear()  # one at a time: what a worker holds stays bounded
        _BUILT[name] = Scanner(items.value, width)
    return _BUILT[name]


def _classes(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    known = items.select(F.col(item_col).cast("bigint").alias("item"), words(F.col(text_col).cast("string")).alias("words"))
    return known.filter("item is not null and size(words) > 0")


def item_classes(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(representative, item) for each item with a word: items with equal words have the smallest of their ids for representative."""
    own = _classes(items, item_col, text_col)
    least = own.groupBy("words").agg(F.min("item").alias("representative"))
    return own.join(least, "words").select("representative", "item").distinct()


def leaked_passages(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, width: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id_col, item_col, n_words, start, end, passage) for each passage of at least `width` consecutive words that a document shares with an item.

    Words are runs of letters and digits of the lower-cased text, so case, punctuation and line ends don't matter.
    start and end count characters of the original text, from 0. Null texts share nothing, items of fewer words than
    `width` cannot be found, equal documents are each reported; of items with equal words the smallest id is. Whole texts are read once a shard."""
    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    known = _classes(items, item_col, item_text_col).groupBy("words").agg(F.min("item").alias("item")).filter(F.size("words") >= width)
    total = known.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = 1 if total <= shard_words else -(-2 * total // shard_words)  # half full on average, as they are not equally large
    schema = f"`{id_col}` {chosen.schema['id'].dataType.simpleString()}, `{item_col}` bigint, n_words int, start int, end int, passage string"

    def scan(shard: int) -> DataFrame:
        rows = known.filter(F.pmod(F.xxhash64("words"), F.lit(shards)) == shard).collect()  # about shard_words words at most
        listed = documents.sparkSession.sparkContext.broadcast([(r.item, r.words) for r in rows])
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(name, listed, width)
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out += [(doc, item, n, a, b, text[a:b]) for item, n, a, b in passages(text, scanner)]
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[id_col, item_col, "n_words", "start", "end", "passage"])

        return chosen.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, (scan(s) for s in range(shards)))
