"""Problem 4: records that differ only in how they are written, collapsed to one each with their copies counted.

Canonical bytes of a record are the words of its fields, each written together, with a zero byte between. They are
divided by radix: a bucket is a prefix of those bytes; as long as a bucket holds more than fits, it is split by the
next bytes. Each bucket is then counted in a burst trie whose terminal nodes hold counter and smallest id.

Copies within a block are merged before anything is shuffled, so a group with a third of all rows arrives as one row
a block. The trie sees merged rows only and never the ids of the copies; those stay beside their canonical bytes and
get their group's first id by a join that adaptive execution may split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_words
from ..session import stored

#: Bytes of the first digit; the prefix doubles with every further one, so that long common beginnings take few passes.
DIGIT = 8


def canonical(payload: str | None) -> bytes | None:
    """Canonical bytes of a JSON record; None if it is no JSON object or its caption is no text with a word."""
    try:
        record = json.loads(payload)
    except (ValueError, TypeError, RecursionError):
        return None
    if not isinstance(record, dict) or not isinstance(record.get("caption"), str):
        return None
    caption = "".join(py_words(record["caption"]))
    if not caption:
        return None
    video = record.get("video_id")
    key = video if isinstance(video, str) else "" if video is None else json.dumps(video)
    return ("".join(py_words(key)) + "\0" + caption).encode("utf-8", "surrogatepass")


def _merge_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups: dict[bytes, list[int]] = {}
        for rec, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (key := canonical(payload)) is not None:
                groups.setdefault(key, []).append(rec)
        ids = [sorted(x) for x in groups.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x[0] for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["canon", "copies", "first_id", "ids"])


class BurstTrie:
    """A trie over byte strings with terminal counters. A leaf holds the remaining bytes of its strings in a table
    and bursts into children by the next byte when it grows beyond limit."""

    __slots__ = ("children", "leaf", "limit", "terminal")

    def __init__(self, limit: int = 4096) -> None:
        self.children: dict[int, BurstTrie] | None = None
        self.leaf: dict[bytes, list[int]] = {}
        self.terminal: list[int] | None = None
        self.limit = limit

    def add(self, key: bytes, copies: int, first: int) -> None:
        node, at = self, 0
        while node.children is not None and at < len(key):
            node, at = node.children.setdefault(key[at], BurstTrie(self.limit)), at + 1
        if at == len(key):
            node.terminal = [copies, first] if node.terminal is None else [node.terminal[0] + copies, min(node.terminal[1], first)]
            return
        rest = key[at:]
        if old := node.leaf.get(rest):
            old[0] += copies
            old[1] = min(old[1], first)
        else:
            node.leaf[rest] = [copies, first]
            if len(node.leaf) > self.limit:
                leaf, node.leaf, node.children = node.leaf, {}, {}
                for k, (n, f) in leaf.items():
                    node.add(k, n, f)

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        todo = [(self, prefix)]
        while todo:
            node, path = todo.pop()
            if node.terminal is not None:
                yield path, *node.terminal
            for rest, (copies, first) in node.leaf.items():
                yield path + rest, copies, first
            for byte, child in (node.children or {}).items():
                todo.append((child, path + bytes([byte])))


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; each bucket is counted in its own trie."""

    def out(bucket: bytes, trie: BurstTrie) -> pa.RecordBatch:
        rows = list(trie.items(bucket))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["canon", "copies", "keep_id"])

    now, trie = None, BurstTrie()
    for batch in batches:
        for bucket, canon, copies, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if bucket != now:
                if now is not None:
                    yield out(now, trie)
                now, trie = bucket, BurstTrie()
            trie.add(canon[len(bucket) :], copies, first)
    if now is not None:
        yield out(now, trie)


def radix_buckets(blocks: DataFrame, bucket_rows: int, max_splits: int = 65536) -> DataFrame:
    """Adds `bucket`: the shortest prefix of whole digits that at most bucket_rows rows of blocks share.

    One pass per digit, over the rows of oversized buckets only, which are stored for the next pass. The prefixes that were split are joined by
    value, not broadcast by hand; raising bucket_rows with the input keeps them at max_splits a digit. A bucket of equal strings
    is not split: it has one row a block, and its trie one node."""
    done, open_rows, depth = None, blocks, DIGIT
    while True:
        cut = open_rows.withColumn("bucket", F.substring("canon", 1, depth))
        sizes = stored(cut.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.xxhash64("canon")).alias("least"), F.max(F.xxhash64("canon")).alias("most")), "sizes")
        if done is None:
            bucket_rows = max(bucket_rows, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // max_splits))
        large = sizes.filter((F.col("n") > bucket_rows) & (F.col("least") < F.col("most"))).select("bucket")
        if large.isEmpty():
            return cut if done is None else done.unionByName(cut)
        fits = cut.join(large, "bucket", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        open_rows = stored(cut.join(large, "bucket", "left_semi").drop("bucket"), "open")
        depth *= 2


def same_records(df: DataFrame, id_col: str, payload_col: str, bucket_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Groups of equal records: (groups, copies).

    groups(canon, copies, keep_id) has one row a record that occurs, copies(keep_id, copy_id) one row for every id
    but the smallest of its group. Payloads that are no JSON object, and captions that are null, no text or without a
    word, take no part; a missing or null video_id equals only another one or one without words. Rows without id take
    no part. Ids are taken to be unique; rows that share one count as copies. Other columns of df are ignored."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(payload_col).cast("string").alias("payload")).filter("id is not null and payload is not null")
    blocks = stored(rows.mapInArrow(_merge_block, "canon binary, copies bigint, first_id bigint, ids array<bigint>"), "canonical")
    bucketed = radix_buckets(blocks.select("canon", "copies", "first_id"), bucket_rows)
    sorted_rows = bucketed.select("bucket", "canon", "copies", "first_id").repartition("bucket").sortWithinPartitions("bucket")
    groups = sorted_rows.mapInArrow(_count_buckets, "canon binary, copies bigint, keep_id bigint")
    several = groups.filter("copies > 1").select("canon", "keep_id")
    beside = blocks.select("canon", "ids").join(several, "canon")  # by block rows; the ids are laid out after the join
    copies = beside.select("keep_id", F.explode("ids").alias("copy_id")).filter("copy_id <> keep_id")
    return groups, copies
