"""Scoring by a Katz backoff bigram model, with counts from all training documents.

Rows that move are blocks, not n-grams.  A block (some MB of text) holds its
distinct words and bigrams once, so the most frequent n-gram costs a block one
entry, and no key is larger than the number of blocks:

1. Blocks send the keys and training counts of their distinct n-grams to shards
   by key; a shard adds them up, stores its table of counts, and answers each
   block in the order that it asked.  For each n-gram one block is its owner.
2. With the answers a block knows every term of its documents but the backoff
   weights.  Per context it sums, over the bigrams it owns, the discounted counts
   and the probabilities of the second word, and lists which document backs off
   from which context how often.
3. Shards of contexts add these sums, which gives each backoff weight exactly
   normalised; the weights are stored in tables by shard, and what the documents'
   backoffs amount to is evaluated from those.

Shuffles have a partition per shard or block, so what a task reads does not grow
with the corpus.

Discounting: Good-Turing for counts up to 5; above, the same amount as at 5 comes
off, so that every context leaves some mass.  The mass that seen words leave is
the probability of the one unknown word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import map_arrow, ship
from ._common import stage
from .packed import pack, pack_words, unpack, unpack_words
from .tokens import batch_words, slices

#: Keys of the end and of the start of a text; words are hashed to 64 bits.
END_KEY, START_KEY = np.uint64(0x5D1E), np.uint64(0x57A2)
GOOD_TURING = 5
BLOCK_BYTES = 6 << 20
#: Tokens whose n-grams share a shard.
SHARD_TOKENS = 1_500_000


def in_training(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 != 2


def discounted(counts: np.ndarray, of_counts: np.ndarray) -> np.ndarray:
    """What a count is worth.  of_counts[r]: how many n-grams have the count r, for r up to 6.

    (r + 1) n(r + 1) / n(r) for r up to 5 where that lies between 5 % of r and r - 0.05,
    else r - 0.5; above 5 as much less as at 5.
    """
    worth = np.zeros(GOOD_TURING + 1)
    for r in range(1, GOOD_TURING + 1):
        star = (r + 1) * of_counts[r + 1] / of_counts[r] if of_counts[r] else 0.0
        worth[r] = star if 0.05 * r <= star <= r - 0.05 else r - 0.5
    counts = np.asarray(counts)
    return np.where(counts <= GOOD_TURING, worth[np.minimum(counts, GOOD_TURING)], counts - (GOOD_TURING - worth[GOOD_TURING]))


def word_keys(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def to_blocks(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to blocks: ids, numbers of words, the distinct words, and the words as indexes, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for number, batch in enumerate(slices(batches, "text", block_bytes)):
            words, index, counts = batch_words(batch.column("text"))
            order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            out = [first + number, pack(batch.column("doc_id").to_numpy()), pack(counts.astype("<u4")), pack_words(words.take(pa.array(order))), pack(rank[index].astype("<u4")), int(counts.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=["block", "ids", "counts", "words", "tokens", "n"])

    return run


class Block:
    """A block's bigrams: first and second (word indexes; after them the end and the start), doc, train; and the distinct ones in key order."""

    def __init__(self, ids: bytes, counts: bytes, words: bytes, tokens: bytes) -> None:
        self.ids = unpack(ids)
        n = unpack(counts).astype(np.int64)
        keys = word_keys(unpack_words(words))
        self.size = len(keys) + 2
        end, start = len(keys), len(keys) + 1
        self.keys = np.concatenate([keys, np.array([END_KEY, START_KEY])])
        ends = np.cumsum(n + 1)
        self.second = np.full(int(ends[-1]), end, np.int64)
        inside = np.ones(len(self.second), bool)
        inside[ends - 1] = False
        self.second[inside] = unpack(tokens)
        self.first = np.concatenate([[start], self.second[:-1]])
        self.first[ends[:-1]] = start
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.n = n + 1
        self.trained = np.array([in_training(d) for d in self.ids.tolist()])
        self.train = self.trained[self.doc]
        codes, self.which = np.unique(self.first * self.size + self.second, return_inverse=True)
        self.a, self.b = codes // self.size, codes % self.size
        self.pairs = pair_keys(self.keys[self.a], self.keys[self.b])

    def sorted(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, which n-gram each is, and its training count.  Words come without the start, which is a context only."""
        if kind == "word":
            keys, count = self.keys[:-1], np.bincount(self.second[self.train], minlength=self.size)[:-1]
        else:
            keys, count = self.pairs, np.bincount(self.which[self.train], minlength=len(self.pairs))
        order = np.argsort(keys)
        return keys[order], order, count[order]


def cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in sorted keys: equal ranges of 64 bits."""
    step = (1 << 64) // shards
    return np.concatenate([[0], np.searchsorted(keys, np.array([i * step for i in range(1, shards)], np.uint64)), [len(keys)]]).astype(np.int64)


BLOCK_COLUMNS = ("ids", "counts", "words", "tokens")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
            yield row, Block(*(row[k] for k in BLOCK_COLUMNS))


def requests(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in blocks_of(batches):
            out = []
            for kind in ("word", "pair"):
                keys, _, count = block.sorted(kind)
                at = cut(keys, shards)
                for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if j > i:
                        out.append((kind, s, row["block"], pack(keys[i:j], rising=True), pack(count[i:j].astype("<u4"))))
            kind, shard, number, keys, count = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(shard, pa.int32()), pa.array(number, pa.int64()), pa.array(keys, pa.binary()), pa.array(count, pa.binary())], names=["kind", "shard", "block", "keys", "counts"])

    return run


ANSWER = "kind string, shard int, block long, counts binary, owned binary, keys binary, n long, v long, of_counts array<long>"


def added(group: pd.DataFrame) -> pd.DataFrame:
    """A shard's requests to its table (block -1) and the answers."""
    group = group.sort_values("block")
    keys = [unpack(x, rising=True) for x in group["keys"]]
    flat = np.concatenate(keys)
    distinct, first, which = np.unique(flat, return_index=True, return_inverse=True)
    sums = np.bincount(which, np.concatenate([unpack(x) for x in group["counts"]]), len(distinct)).astype(np.int64)
    mine = np.zeros(len(flat), bool)
    mine[first] = True
    ends = np.cumsum([len(k) for k in keys])
    counts = sums[which].astype("<u4")
    kind, shard = group["kind"].iloc[0], int(group["shard"].iloc[0])
    out = [(kind, shard, int(b), pack(counts[e - len(k) : e]), pack(mine[e - len(k) : e].view(np.uint8)), None, 0, 0, None) for b, k, e in zip(group["block"], keys, ends, strict=True)]
    seen = sums > 0
    out.append((kind, shard, -1, pack(sums[seen].astype("<u4")), None, pack(distinct[seen], rising=True), int(sums.sum()), int(seen.sum()), np.bincount(np.minimum(sums[seen], 7), minlength=8).astype(np.int64).tolist()))
    return pd.DataFrame(out, columns=["kind", "shard", "block", "counts", "owned", "keys", "n", "v", "of_counts"])


class Totals:
    def __init__(self, rows: list, documents: int) -> None:
        by = {r.kind: r for r in rows}
        get = lambda kind, name, none: getattr(by[kind], name) if kind in by else none
        self.n, self.v, self.documents = int(get("word", "n", 0)), int(get("word", "v", 0)), documents
        self.words, self.pairs = (np.array(get(k, "of_counts", [0] * 8), float) for k in ("word", "pair"))
        # All of the words' worth, from the counts' counts: those above 6 lose as much as at 5 each.
        less = GOOD_TURING - discounted(np.array([GOOD_TURING]), self.words)[0]
        small = np.arange(1, 7)
        lost = float((self.words[1:7] * (small - discounted(small, self.words))).sum() + self.words[7] * less)
        self.unknown = lost / self.n if self.n else 1.0

    def p1(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words with these counts; of the unknown word for 0."""
        return np.where(counts > 0, discounted(counts, self.words) / max(self.n, 1), self.unknown)


PARTS = "kind string, shard int, block long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, part double, keys binary, x binary, y binary, z binary"
PART_SCHEMA = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("part", pa.float64()), *((k, pa.binary()) for k in ("keys", "x", "y", "z"))])


def evaluated(totals: Totals, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def aligned(row: dict, block: Block, kind: str, column: str) -> np.ndarray:
        """The answers put back to the n-grams they are for."""
        answers = sorted((a for a in row["answers"] if a["kind"] == kind), key=lambda a: a["shard"])
        values = np.concatenate([unpack(a[column]) for a in answers])
        _, order, _ = block.sorted(kind)
        out = np.empty_like(values)
        out[order] = values
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in blocks_of(batches):
            c1 = np.append(aligned(row, block, "word", "counts").astype(np.int64), totals.documents)  # the start is a context of that count
            c2 = aligned(row, block, "pair", "counts").astype(np.int64)
            owned = aligned(row, block, "pair", "owned").astype(bool) & (c2 > 0)
            p1 = totals.p1(c1[:-1])
            log1 = np.log10(np.append(p1, 1.0))
            worth = discounted(c2, totals.pairs)
            backs = c2 == 0
            with np.errstate(divide="ignore"):
                log2 = np.where(backs, log1[block.b], np.log10(np.maximum(worth, 1e-300)) - np.log10(np.maximum(c1[block.a], 1)))
            base = np.log10((c1 + 1) / (totals.n + totals.v + 1))
            sums = lambda x: np.bincount(block.doc, x, len(block.ids))
            m = len(block.ids)
            known = sums((c1[block.second] > 0).astype(float)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * m), pa.nulls(m, pa.int32()), pa.array([row["block"]] * m, pa.int64()), pa.array(np.arange(m, dtype=np.int32)), pa.array(block.ids), pa.array(~block.trained), pa.array(block.n), pa.array(known), pa.array(sums(base[block.second])), pa.array(sums(log2[block.which])), *(pa.nulls(m, pa.binary()) for _ in range(4))],
                schema=PART_SCHEMA,
            )
            out = []
            # What the owned bigrams add to their contexts.
            own = np.flatnonzero(owned)
            s1 = np.bincount(block.a[own], worth[own], block.size)
            s2 = np.bincount(block.a[own], p1[block.b[own]], block.size)
            at = np.unique(block.a[own])
            at = at[np.argsort(block.keys[at])]
            keys = block.keys[at]
            bounds = cut(keys, shards)
            for s, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if j > i:
                    some = at[i:j]
                    out.append(("context", s, pack(keys[i:j], rising=True), pack(s1[some]), pack(s2[some]), pack(c1[some])))
            # Which document backs off from which known context how often.
            use = np.flatnonzero(backs[block.which] & (c1[block.first] > 0))
            code, times = np.unique(block.first[use] * m + block.doc[use], return_counts=True)
            context, of = code // m, code % m
            order = np.argsort(block.keys[context], kind="stable")
            keys, of, times = block.keys[context][order], of[order], times[order]
            bounds = cut(keys, shards)
            for s, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if j > i:
                    out.append(("back", s, pack(keys[i:j], rising=True), pack(of[i:j].astype("<u4")), pack(times[i:j].astype("<u4")), b""))
            if out:
                kind, shard, keys, x, y, z = zip(*out, strict=True)
                k = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(shard, pa.int32()), pa.array([row["block"]] * k, pa.int64()), *(pa.nulls(k, PART_SCHEMA.field(i).type) for i in range(3, 10)), *(pa.array(v, pa.binary()) for v in (keys, x, y, z))], schema=PART_SCHEMA)

    return run


def weighed(group: pd.DataFrame) -> pd.DataFrame:
    """A shard's sums to its table of contexts: keys in order and their backoff weights (log10)."""
    keys = np.concatenate([unpack(x, rising=True) for x in group["keys"]])
    distinct, which = np.unique(keys, return_inverse=True)
    total = lambda column: np.bincount(which, np.concatenate([unpack(x) for x in group[column]]), len(distinct))
    first = np.zeros(len(distinct))
    first[which] = np.concatenate([unpack(x) for x in group["z"]])
    left = np.log10(1 - total("x") / np.maximum(first, 1)) - np.log10(1 - total("y"))
    return pd.DataFrame({"shard": [group["shard"].iloc[0]], "keys": [pack(distinct, rising=True)], "weights": [pack(left)]})


def backed_off(group: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
    """What the backoffs that a shard's rows list amount to, by the weights in the shard's table."""
    if not len(group):
        return pd.DataFrame({"block": np.zeros(0, np.int64), "place": np.zeros(0, np.int32), "more": np.zeros(0)})
    keys, weights = (unpack(tables["keys"].iloc[0], rising=True), unpack(tables["weights"].iloc[0]))
    wanted = [unpack(x, rising=True) for x in group["keys"]]
    row = np.repeat(np.arange(len(group)), [len(w) for w in wanted])
    place = np.concatenate([unpack(x) for x in group["x"]]).astype(np.int64)
    times = np.concatenate([unpack(x) for x in group["y"]])
    owner, at = np.unique(row << 32 | place, return_inverse=True)
    more = np.bincount(at, weights[np.searchsorted(keys, np.concatenate(wanted))] * times)
    return pd.DataFrame({"block": group["block"].to_numpy()[owner >> 32], "place": (owner & 0xFFFFFFFF).astype(np.int32), "more": more})


def katz_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document.

    docs needs doc_id and text; others are ignored.  Documents whose crc32(doc_id as
    text) mod 7 is not 2 are counted.  A null or blank text is its end alone.  Rows
    that repeat a doc_id are documents of their own.  Rows with a null doc_id are
    left out.  Without any training document every token is unknown, with
    probability 1.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    blocks = stage(map_arrow(own, to_blocks(block_bytes), "block long, ids binary, counts binary, words binary, tokens binary, n long"))
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("blocks")).first()
    shards, many = max(2, -(-size.tokens // shard_tokens)), max(2, size.blocks)
    asked = map_arrow(blocks, requests(shards), "kind string, shard int, block long, keys binary, counts binary")
    answers = stage(asked.repartition(2 * shards, "kind", "shard").groupBy("kind", "shard").applyInPandas(added, ANSWER))
    tables = answers.where("block = -1")
    sums = tables.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.array(*[F.sum(F.get("of_counts", F.lit(i))) for i in range(8)]).alias("of_counts")).collect()  # two rows
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    totals = Totals(sums, own.where(F.pmod(crc, F.lit(7)) != 2).count())
    per_block = answers.where("block >= 0").repartition(many, "block").groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "counts", "owned")).alias("answers"))
    met = blocks.repartition(many, "block").join(per_block.hint("shuffle_hash"), "block").select("block", *BLOCK_COLUMNS, "answers")
    few = max(2, shards // 8)
    parts = stage(map_arrow(met, evaluated(totals, few), PARTS))
    contexts = parts.where("kind = 'context'").select("shard", "keys", "x", "y", "z")
    weights = stage(contexts.repartition(few, "shard").groupBy("shard").applyInPandas(weighed, "shard int, keys binary, weights binary"))
    backs = parts.where("kind = 'back'").select("shard", "block", "keys", "x", "y").repartition(few, "shard").groupBy("shard")
    found = backs.cogroup(weights.repartition(few, "shard").groupBy("shard")).applyInPandas(backed_off, "block long, place int, more double")
    more = found.groupBy("block", "place").agg(F.sum("more").alias("more"))
    scored = parts.where("kind = 'doc'").select("block", "place", "doc_id", "held_out", "n_tokens", "n_known", "base", "part").join(more, ["block", "place"], "left")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))
