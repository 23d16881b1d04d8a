"""Problem 8: encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts are divided by the tokenizer's pattern; the distinct pieces of a batch are put into padded matrices, one for
each band of lengths, and encoded together: each round looks up the rank of every adjacent pair in a hash table, every
row merges its leftmost pair of least rank, rows without a pair left are taken out and the rest is packed again.
Pieces longer than LONG bytes, which would make a matrix of few and wide rows, are merged by a heap to the same ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 256
#: Pieces whose ids a worker keeps, and texts encoded together.
KEPT, TOGETHER = 100_000, 2_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of what they merge to."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.uint64)
        values = np.array(list(pairs.values()), dtype=np.int32)
        bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), dtype=np.uint64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        self.probes, at, todo = 0, self.place(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[todo[won]], values[todo[won]]
            left = np.ones(len(todo), dtype=bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & self.mask
            self.probes += 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self.place(keys)
        out = np.full(keys.shape, NONE, dtype=np.int32)
        met = self.keys[at]
        hit = met == keys
        out[hit] = self.values[at[hit]]
        open_ = ~hit & (met != np.uint64(2**64 - 1))
        for _ in range(self.probes - 1):
            if not open_.any():
                break
            where = np.nonzero(open_)
            at[where] = (at[where] + 1) & self.mask
            met = self.keys[at[where]]
            hit = met == keys[where]
            done = tuple(x[hit] for x in where)
            out[done] = self.values[at[done]]
            open_[where] = ~hit & (met != np.uint64(2**64 - 1))
        return out


class Encoder:
    """Ids are ranks; a pair merges if its bytes together are in the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs[a, b] = rank
        self.pairs = pairs
        self.table = PairTable(pairs)
        self.known: dict[str, np.ndarray] = {}

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        width = max(map(len, pieces))
        row_of = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        size = np.array([len(p) for p in pieces])
        column = np.arange(len(row_of)) - np.repeat(np.cumsum(size) - size, size)
        ids = np.full((len(pieces), width), -1, dtype=np.int64)
        ids[row_of, column] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        out: list[np.ndarray | None] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            pair = np.full((len(rows), max(1, ids.shape[1] - 1)), NONE, dtype=np.int32)
            if ids.shape[1] > 1:
                there = np.nonzero(ids[:, 1:] >= 0)
                pair[there] = self.table.get(ids[there], ids[:, 1:][there])
            at = pair.argmin(axis=1)
            least = pair[np.arange(len(rows)), at]
            open_ = least != NONE
            for k in np.flatnonzero(~open_):
                out[rows[k]] = ids[k][ids[k] >= 0].astype(np.int32)
            rows, ids, at, least = rows[open_], ids[open_], at[open_], least[open_]
            if not len(rows):
                break
            columns = np.arange(ids.shape[1] - 1)
            moved = np.where(columns[None, :] <= at[:, None], ids[:, :-1], ids[:, 1:])
            moved[np.arange(len(rows)), at] = least
            ids = moved[:, : max(1, int((moved >= 0).sum(axis=1).max()))]
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        after[-1] = -1
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (rank := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (rank := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of distinct pieces."""
        new = [p for p in pieces if p not in self.known]
        found: dict[str, np.ndarray] = {}
        bands: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                found[p] = self._heap(raw)
            else:
                bands.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for band in bands.values():
            for start in range(0, len(band), 16384):
                part = band[start : start + 16384]
                found.update(zip((p for p, _ in part), self._matrix([raw for _, raw in part]), strict=True))
        out = [found[p] if p in found else self.known[p] for p in pieces]
        if len(self.known) + len(found) > KEPT:
            self.known.clear()
        self.known.update((p, x) for p, x in found.items() if len(p) <= 32)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start (and the last end)."""
        index: dict[str, int] = {}
        of: list[int] = []
        sizes = []
        for text in texts:
            before = len(of)
            of.extend([index.setdefault(p, len(index)) for p in self.pattern.findall(text)] if text else ())
            sizes.append(len(of) - before)
        parts = self.pieces(list(index))
        length = np.array([len(x) for x in parts], dtype=np.int64)
        flat = np.concatenate([*parts, np.zeros(0, np.int32)])
        start = np.cumsum(length) - length
        piece = np.array(of, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(length[piece])])
        take = np.repeat(start[piece] - total[:-1], length[piece]) + np.arange(total[-1])
        return flat[take].astype(np.int32), total[np.concatenate([[0], np.cumsum(sizes)])]


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, pattern)


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str) -> DataFrame:
    """(id_col, ids) for each row of df, without special tokens; texts are taken as they are.

    vocabulary is a file of base64 tokens and their ranks that each worker can read, pattern the tokenizer's division
    of a text. Empty and null texts have the empty list. Equal rows stay. Other columns of df are ignored."""
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                ids, edges = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema['id'].dataType.simpleString()}, ids array<int>")
