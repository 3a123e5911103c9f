"""Removal of bytes that lie in strings of a given length found at two places or more, in one text or in two.

Suffixes are taken at anchors only (see ``anchors``): whatever string of 400 bytes
two places share, both have an anchor at the same offset among its first 64 bytes,
and the 337 bytes after it in common.  Blocks of texts sort the keys of such
suffixes and send them to shards by key, which merge the blocks' sorted tables and
answer which keys occur twice.  Three merges narrow the places down:

1. anchors whose next 337 bytes occur twice; texts without such an anchor are done;
2. of those, the anchors whose 63 bytes before and 400 after (or the text's end)
   occur twice too: all strings that begin among these 63 bytes are repeated;
3. every place in question near other anchors, with one copy of what step 2 found,
   by the hash of its own 400 bytes.

A block sends a key once, so no key has more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import map_arrow, ship
from ._common import stage
from .anchors import WINDOW, Hashes, anchors
from .katz import cut
from .packed import pack, unpack
from .tokens import slices

LENGTH = 400
BLOCK_BYTES = 4 << 20
#: Keys that share a shard.
SHARD_KEYS = 1_500_000


class Texts:
    """The texts of a block as one buffer."""

    def __init__(self, data: bytes, sizes: np.ndarray, length: int) -> None:
        self.buffer, self.sizes, self.length = np.frombuffer(data, np.uint8), sizes.astype(np.int64), length
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.hashes = Hashes(self.buffer)

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors that have ``length`` - 63 bytes of their text behind them, their texts, and their keys."""
        at = anchors(self.buffer, self.ends)
        doc = np.searchsorted(self.ends, at, side="right")
        ok = at + self.length - WINDOW + 1 <= self.ends[doc]
        at, doc = at[ok], doc[ok]
        return at, doc, self.hashes.of(at, at + self.length - WINDOW + 1)

    def contexts(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Keys of what stands around anchors: 63 bytes before and ``length`` from it, or as far as the text goes."""
        begin, end = np.maximum(at - WINDOW + 1, self.begins[doc]), np.minimum(at + self.length, self.ends[doc])
        return self.hashes.of(begin, end) + (at - begin).astype(np.uint64)

    def starts(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Mask of the places from 63 before each anchor to itself where a string of ``length`` fits into the text."""
        begin = np.maximum(at - WINDOW + 1, self.begins[doc])
        end = np.minimum(at, self.ends[doc] - self.length) + 1
        ok = end > begin
        return covered(begin[ok], end[ok], len(self.buffer))


def covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, begin, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps)[:-1] > 0


def to_blocks(length: int, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to blocks of those that have ``length`` bytes; the others are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for number, batch in enumerate(slices(batches, "text", block_bytes)):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            yield from finished([(d, t, 0, 0, t) for d, t in zip(ids, texts, strict=True) if len(t) < length])
            some = [(d, t) for d, t in zip(ids, texts, strict=True) if len(t) >= length]
            if some:
                yield block_row(first + number, [d for d, _ in some], [t for _, t in some])

    return run


ROW = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("marks", pa.binary()), ("bytes", pa.int64()), *((k, pa.int64()) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("kept", pa.binary())])
ROW_DDL = "block long, ids binary, sizes binary, data binary, marks binary, bytes long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_ZSTD = pa.Codec("zstd", compression_level=1)


def block_row(block: int, ids: list[int], texts: list[bytes], marks: bytes = b"") -> pa.RecordBatch:
    joined = b"".join(texts)
    values = [block, pack(np.array(ids, np.int64)), pack(np.array([len(t) for t in texts], np.int64)), _ZSTD.compress(joined, asbytes=True), marks, len(joined)]
    return pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(values, ROW, strict=False)), *(pa.nulls(1, f.type) for f in list(ROW)[6:])], schema=ROW)


def finished(rows: list[tuple[int, bytes, int, int, bytes]], texts: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows for documents: doc_id, text, bytes removed, runs removed, what is left."""
    if rows:
        n = len(rows)
        out = [[r[0] for r in rows], [len(r[1]) for r in rows], [r[2] for r in rows], [r[3] for r in rows], [hashlib.sha256(r[4]).hexdigest() for r in rows], [r[4] for r in rows]]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, f.type) for f in list(ROW)[:6]), *(pa.array(v, f.type) for v, f in zip(out, list(ROW)[6:], strict=True))], schema=ROW)


def texts_of(row: dict, length: int) -> Texts:
    return Texts(_ZSTD.decompress(row["data"], decompressed_size=row["bytes"], asbytes=True), unpack(row["sizes"]), length)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}


Keys = Callable[[dict], np.ndarray]


def asked(keys_of: Keys, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys, times = np.unique(keys_of(row), return_counts=True)
            at = cut(keys, shards)
            out = [(s, row["block"], pack(keys[i:j], rising=True), pack((times[i:j] > 1).view(np.uint8))) for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            if out:
                shard, block, packed, twice = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(packed, pa.binary()), pa.array(twice, pa.binary())], names=["shard", "block", "keys", "twice"])

    return run


def merged(group: pd.DataFrame) -> pd.DataFrame:
    """A shard's sorted tables to its answers: 1 if a key occurs twice, and 2 if the block is the first that has it."""
    group = group.sort_values("block")
    keys = [unpack(x, rising=True) for x in group["keys"]]
    _, first, which, blocks = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
    twice = np.bincount(which, np.concatenate([unpack(x) for x in group["twice"]])) + blocks > 1
    flags = twice[which].astype(np.uint8)
    flags[first] |= 2
    ends = np.cumsum([len(k) for k in keys])
    return pd.DataFrame({"shard": group["shard"], "block": group["block"], "flags": [pack(flags[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]})


def met(blocks: DataFrame, keys_of: Keys, shards: int) -> DataFrame:
    """blocks with the answers to their keys."""
    asks = map_arrow(blocks, asked(keys_of, shards), "shard int, block long, keys binary, twice binary")
    answers = asks.groupBy("shard").applyInPandas(merged, "shard int, block long, flags binary")
    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "flags")).alias("answers"))
    return blocks.join(per_block.hint("shuffle_hash"), "block", "left")


def answered(row: dict, keys: np.ndarray) -> np.ndarray:
    """The flags of each key, in the keys' order."""
    _, which = np.unique(keys, return_inverse=True)
    flags = [unpack(a["flags"]) for a in sorted(row["answers"] or [], key=lambda a: a["shard"])]
    return np.concatenate([*flags, np.zeros(0, np.uint8)])[which]


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes left) of every document.

    docs needs doc_id and text; others are ignored.  A byte goes if a string of
    ``length`` bytes covers it that also begins anywhere else, in the same text or
    another; strings overlap, end with their text, and are judged on the input.  A
    null text is empty; texts shorter than ``length`` stay.  Rows that repeat a
    doc_id are texts of their own, so copies of each other.  Rows with a null
    doc_id are left out.  An empty table gives an empty one.
    """
    if length < 2 * WINDOW + 16:
        raise ValueError("length must leave room for anchors")
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    state = ["block", "ids", "sizes", "data", "marks", "bytes"]

    def seed_keys(row: dict) -> np.ndarray:
        return texts_of(row, length).seeds()[2]

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            texts = texts_of(row, length)
            at, doc, keys = texts.seeds()
            shared = (answered(row, keys) & 1).astype(bool)
            kept = np.zeros(len(texts.sizes), bool)
            kept[doc[shared]] = True
            data, ids = texts.buffer.tobytes(), unpack(row["ids"]).tolist()
            each = [data[a:b] for a, b in zip(texts.begins.tolist(), texts.ends.tolist(), strict=True)]
            yield from finished([(d, t, 0, 0, t) for d, t, k in zip(ids, each, kept, strict=True) if not k])
            if kept.any():
                # Of the texts that go on, a mark for each of their anchors: its seed occurs twice.
                yield block_row(row["block"], [d for d, k in zip(ids, kept, strict=True) if k], [t for t, k in zip(each, kept, strict=True) if k], pack(shared[kept[doc]].view(np.uint8)))

    def marked(row: dict, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, doc, _ = texts.seeds()
        marks = unpack(row["marks"])
        return at[marks > 0], doc[marks > 0], marks[marks > 0]

    def context_keys(row: dict) -> np.ndarray:
        texts = texts_of(row, length)
        at, doc, _ = marked(row, texts)
        return texts.contexts(at, doc)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks become 1 for an anchor in question, 3 for one whose surroundings occur twice, 7 if this block holds their first copy."""
        for row in rows_of(batches):
            texts = texts_of(row, length)
            at, doc, _ = marked(row, texts)
            keys = texts.contexts(at, doc)
            flags = answered(row, keys)
            # Of equal surroundings inside the block, one stands for all.
            once = np.zeros(len(keys), bool)
            once[np.unique(keys, return_index=True)[1]] = True
            marks = unpack(row["marks"]).copy()
            marks[marks > 0] = np.where(flags & 1, np.where((flags & 2 > 0) & once, 7, 3), 1)
            yield pa.RecordBatch.from_arrays([pa.array([row[k] if k != "marks" else pack(marks)], ROW.field(k).type) for k in state], names=state)

    def place_keys(row: dict) -> np.ndarray:
        texts = texts_of(row, length)
        at, doc, marks = marked(row, texts)
        asks = (marks & 3) != 3
        p = np.flatnonzero(texts.starts(at[asks | (marks == 7)], doc[asks | (marks == 7)]))
        return texts.hashes.of(p, p + length)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            texts = texts_of(row, length)
            at, doc, marks = marked(row, texts)
            sure = (marks & 3) == 3
            twice = texts.starts(at[sure], doc[sure])
            sent = ~sure | (marks == 7)
            p = np.flatnonzero(texts.starts(at[sent], doc[sent]))
            p = p[(answered(row, texts.hashes.of(p, p + length)) & 1).astype(bool)]
            twice[p] = True
            p = np.flatnonzero(twice)
            gone = covered(p, p + length, len(texts.buffer))
            rows = []
            for d, a, b in zip(unpack(row["ids"]).tolist(), texts.begins.tolist(), texts.ends.tolist(), strict=True):
                cut_out = gone[a:b]
                rows.append((d, texts.buffer[a:b].tobytes(), int(cut_out.sum()), int((np.diff(cut_out.astype(np.int8), prepend=0) == 1).sum()), texts.buffer[a:b][~cut_out].tobytes()))
            yield from finished(rows)

    first = stage(map_arrow(own, to_blocks(length, block_bytes), ROW_DDL))
    blocks = first.where("block is not null").select(state)
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    second = stage(map_arrow(met(blocks, seed_keys, max(2, -(-size // (25 * shard_keys)))), live, ROW_DDL))
    blocks = second.where("block is not null").select(state)
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    third = stage(map_arrow(met(blocks, context_keys, max(2, -(-size // (25 * shard_keys)))), settled, "block long, ids binary, sizes binary, data binary, marks binary, bytes long"))
    last = map_arrow(met(third, place_keys, max(2, -(-size // (2 * shard_keys)))), removed, ROW_DDL)
    done = first.where("block is null").select(result).unionByName(second.where("block is null").select(result))
    return done.unionByName(last.select(result))
