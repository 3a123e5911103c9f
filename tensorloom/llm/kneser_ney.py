"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The model is trained on all that the labels call good, but for a part that is kept
out for thresholds, and its tables are sharded: no task holds more of it than a
shard.  Rows that move are blocks' (some MB of text), not n-grams:

1. Blocks ask shards for ids of their distinct words; words that the training texts
   have get one, by frequency, and all others are the unknown word.
2. Blocks send the counts of their training texts' trigrams to shards by the first
   two words.  From the distinct trigrams shards send on how many words stand
   before each pair, and from the distinct pairs what follows and precedes each word.
3. Blocks ask the shards for their distinct known words, pairs and trigrams, each
   once, in the order of the shards' keys; the answers are counts, and a block sums
   log probabilities per document from them.  That is done in rounds of a part of
   the blocks, so that requests and answers of one part lie on disks at a time.

So the most frequent n-gram costs a block one entry.  Words are named by 64-bit
hashes where they get their ids; from then on keys are exact.  Thresholds are
quantiles per language over all trusted documents that the model was not trained on.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import map_arrow, map_cogroups, map_groups, ship
from ._common import Scratch, stage
from .katz import cut, pair_keys, word_keys
from .packed import pack, pack_words, unpack, unpack_words
from .tokens import batch_words, slices

#: Of the trusted documents, one in this many is kept out of training: thresholds need texts that the model has not seen.
HELD_OUT = 4
QUANTILE, SLACK, LEAST_TRUSTED = 0.99, 0.25, 50
BLOCK_BYTES = 12 << 20
#: Tokens whose n-grams share a shard.
SHARD_TOKENS = 2_000_000
#: Parts in which the blocks ask the model, one after another, and tokens that a part has at least.
ROUNDS, ROUND_TOKENS = 8, 16_000_000


@dataclass
class Model:
    """The model of texts that fit into one task, to compare the sharded one with.

    Interpolated probabilities of the n-grams seen, and weights of the shorter context for the contexts seen.
    Ids: 0 an unknown word, 1 the start, 2 the end, then the words.
    """

    words: pa.Array
    p1: np.ndarray
    g1: np.ndarray
    k2: np.ndarray
    p2: np.ndarray
    g2: np.ndarray
    k3: np.ndarray
    p3: np.ndarray

    @property
    def size(self) -> int:
        return len(self.p1)

    def to_bytes(self) -> bytes:
        """Sorted keys as steps, numbers by the place of their bytes, all compressed."""
        numbers = {k: pack(getattr(self, k), rising=k in ("k2", "k3")) for k in ("p1", "g1", "k2", "p2", "g2", "k3", "p3")}
        return pickle.dumps(numbers | {"words": pack_words(self.words)})

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        parts = pickle.loads(data)
        return cls(pa.array(unpack_words(parts.pop("words")), pa.large_string()), **{k: unpack(v, rising=k in ("k2", "k3")) for k, v in parts.items()})


UNKNOWN, START, END = 0, 1, 2


def discounts(counts: np.ndarray) -> np.ndarray:
    """D(0) = 0, D(1), D(2), D(3 and more), from how many n-grams have the counts 1 to 4; where one is missing: 0.5, 1, 1.5."""
    return discounts_of(np.bincount(np.minimum(counts, 5), minlength=6).astype(float))


def discounts_of(n: np.ndarray) -> np.ndarray:
    """The same, from how many n-grams have each count."""
    if not all(n[1:5]):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0, *np.clip([1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]], [0.05, 0.05, 0.05], [0.95, 1.95, 2.95])])


def discounted(counts: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(count - D) / total of each n-gram, and the mass that each context leaves to the shorter one (1 where it was not seen)."""
    d = discounts(counts)[np.minimum(counts, 3)]
    total = np.bincount(context, counts, contexts)
    left = np.bincount(context, d, contexts)
    return (counts - d) / total[context], np.where(total > 0, left / np.maximum(total, 1), 1.0)


def train(texts: list[str | None]) -> Model:
    """Counts of trigrams; for bigrams and words, how many different words stand before them (after a start: counts)."""
    words, index, counts = batch_words(pa.array(texts, pa.large_string()))
    ends = np.cumsum(counts + 3)
    line = np.full(int(ends[-1]) if len(ends) else 0, START, np.int64)
    inside = np.ones(len(line), bool)
    begin = ends - (counts + 3)
    inside[begin] = inside[begin + 1] = inside[ends - 1] = False
    line[inside] = index + 3
    line[ends - 1] = END
    size = len(words) + 3
    at = np.flatnonzero(line != START)  # each is the last of a trigram of its own document
    a, b, c = line[at - 2], line[at - 1], line[at]
    # Bigrams and trigrams are named by position in sorted tables, so keys are exact.
    k2, pair = np.unique(np.concatenate([b * size + c, a * size + b]), return_inverse=True)
    head = pair[len(at) :]
    k3, n3 = np.unique(head * size + c, return_counts=True)
    p3, g2 = discounted(n3, k3 // size, len(k2))
    before = k2[k3 // size]
    tail = np.searchsorted(k2, (before % size) * size + k3 % size)  # the last two words of each trigram
    starts = before % size == START  # nothing varies before a start: its bigrams keep their counts
    n2 = np.bincount(tail[~starts], minlength=len(k2)) + np.bincount(tail[starts], n3[starts], len(k2)).astype(np.int64)
    seen = n2 > 0  # pairs that end in a start are contexts only
    p2 = np.zeros(len(k2))
    p2[seen], g1 = discounted(n2[seen], k2[seen] // size, size)
    n1 = np.bincount(k2[seen] % size, minlength=size)
    known = np.flatnonzero(n1)
    p1 = np.zeros(size)
    if len(known):
        p1[known], left = discounted(n1[known], np.zeros(len(known), np.int64), 1)
    else:
        left = np.ones(1)
    p1 += left[0] / (size - 1)  # all words, the end, and one unknown share it; a start never comes
    p1[START] = 0
    p2 = np.where(seen, p2 + g1[k2 // size] * p1[k2 % size], 0)
    lower = p2[tail]
    p3 = p3 + g2[k3 // size] * lower
    return Model(words, p1, g1, k2, p2.astype(np.float32), g2.astype(np.float32), k3, p3.astype(np.float32))


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _values(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[..., at], and 0 at -1."""
    return np.concatenate([values, np.zeros((*values.shape[:-1], 1), values.dtype)], axis=-1)[..., at]


def log_probabilities(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each text with its end, and its number of words."""
    words, index, counts = batch_words(texts)
    ids = pc.fill_null(pc.index_in(words, model.words), -1).to_numpy().astype(np.int64)
    ids = np.where(ids >= 0, ids + 3, UNKNOWN)
    ends = np.cumsum(counts + 3)
    line = np.full(int(ends[-1]) if len(ends) else 0, START, np.int64)
    begin = ends - (counts + 3)
    inside = np.ones(len(line), bool)
    inside[begin] = inside[begin + 1] = inside[ends - 1] = False
    line[inside] = ids[index]
    line[ends - 1] = END
    at = np.flatnonzero(line != START)
    a, b, c = line[at - 2], line[at - 1], line[at]
    p = model.p1[c]
    pair = _found(model.k2, b * model.size + c)
    head = np.empty(len(at), np.int64)
    follows = np.concatenate([[False], np.diff(at) == 1])[: len(at)]
    head[follows] = pair[:-1][follows[1:]]  # the pair before is the one that ended a word earlier
    first = ~follows
    head[first] = _found(model.k2, a[first] * model.size + b[first])
    p2 = _values(model.p2, pair)
    p = np.where(p2 > 0, p2, model.g1[b] * p)
    both = np.flatnonzero(head >= 0)
    triple = _found(model.k3, head[both] * model.size + c[both])
    p[both] = np.where(triple >= 0, _values(model.p3, triple), model.g2[head[both]] * p[both])
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    return np.bincount(doc, np.log(p), len(counts)), counts


@dataclass
class Totals:
    """What one word's, context's or corpus's probabilities take beside its own counts: discounts, how many words, and the words' own sum."""

    words: int
    d1: np.ndarray
    d2: np.ndarray
    d3: np.ndarray
    total1: int
    left1: float

    @classmethod
    def of(cls, of_counts: dict[str, list[int]], total1: int) -> Totals:
        """of_counts: of words, pairs and triples, how many have the counts 0 to 4, and 5 or more; total1: the sum of the words' counts."""
        n1, n2, n3 = (np.array(of_counts.get(k) or [0] * 6, float) for k in ("word", "pair", "triple"))
        d1 = discounts_of(n1)
        lost = d1[1] * n1[1] + d1[2] * n1[2] + d1[3] * n1[3:].sum()
        words = max(int(n1.sum()) - 1, 0)  # the end has a count, too
        return cls(words, d1, discounts_of(n2), discounts_of(n3), total1, lost / total1 if total1 else 1.0)

    def p1(self, n1: np.ndarray) -> np.ndarray:
        """All words, the end, and one unknown share what is left."""
        return (n1 - self.d1[np.minimum(n1, 3)]) / max(self.total1, 1) + self.left1 / (self.words + 2)


#: Numbers that words and pairs have: their own count, and as contexts the sum of what follows and how many followers have the counts 1, 2, 3 and more.
STATS = 5


def left(stats: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The mass that contexts leave to the shorter ones; 1 where a context was not seen."""
    return np.where(stats[1] > 0, (stats[2:] * d[1:, None]).sum(axis=0) / np.maximum(stats[1], 1), 1.0)


def context_stats(counts: np.ndarray, of: np.ndarray, contexts: int) -> np.ndarray:
    """The last four of STATS, of contexts, from their followers' counts."""
    out = np.zeros((STATS - 1, contexts), np.int64)
    out[0] = np.bincount(of, counts, contexts)
    for k in (1, 2, 3):
        out[k] = np.bincount(of[np.minimum(counts, 3) == k], minlength=contexts)
    return out


def times(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6).astype(np.int64).tolist()


LOW = 0xFFFFFFFF


def remainder(values: np.ndarray, n: int) -> np.ndarray:
    """values % n for values from 0 on; numpy's division by one number is several times as fast as its remainder."""
    return values - values // values.dtype.type(n) * values.dtype.type(n)


def distinct(codes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes in order, which of them each one is, and how often each comes; codes are from 0 to below ``bound``, and are overwritten.

    Where a code and its place fit into one number these are sorted, which takes a fifth of what sorting places by their codes takes.
    """
    bits = len(codes).bit_length()
    if bound.bit_length() + bits > 63:
        return np.unique(codes, return_inverse=True, return_counts=True)
    codes <<= bits
    codes |= np.arange(len(codes))
    codes.sort()
    place = codes & ((1 << bits) - 1)
    codes >>= bits
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    which = np.empty(len(codes), np.int32)
    which[place] = np.cumsum(new, dtype=np.int32) - 1
    del place
    at = np.flatnonzero(new)
    return codes[at], which, np.diff(at, append=len(codes))


def by_shard(shard: np.ndarray, shards: int) -> np.ndarray:
    """Places in the order of their shards, and in their own order within each; of 16-bit numbers numpy sorts the digits."""
    return np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")


def turned(first: np.ndarray, shards: int) -> np.ndarray:
    return remainder(pair_keys(first.astype(np.uint64), np.uint64(7)) >> np.uint64(32), shards).astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Pairs of ids, (first << 32 | second), are dealt out by the second, each first word beginning at another shard.  A word is a pair without a first."""
    return remainder(turned(keys >> 32, shards) + (keys & LOW), shards)


def pack_keys(keys: np.ndarray, shards: int) -> bytes:
    """Keys of one shard in order, without what the shard says of the second id, so that more shards don't make steps larger."""
    return pack(keys >> 32 << 32 | (keys & LOW) // shards, rising=True)


def unpack_keys(data: bytes, shard: int, shards: int) -> np.ndarray:
    keys = unpack(data, rising=True)
    first = keys >> 32
    return first << 32 | (keys & LOW) * shards + remainder(shard + shards - turned(first, shards), shards)


def pack_thirds(thirds: np.ndarray, lens: np.ndarray) -> bytes:
    """Third words by pair, rising in each, as steps."""
    steps = np.diff(thirds, prepend=0)
    starts = (np.cumsum(lens) - lens)[lens > 0]
    steps[starts] = thirds[starts]
    return pack(steps.astype("<u4"))


def unpack_thirds(data: bytes, lens: np.ndarray) -> np.ndarray:
    steps, some = unpack(data).astype(np.int64), lens[lens > 0].astype(np.int64)
    sums = np.cumsum(steps)
    starts = np.cumsum(some) - some
    return sums - np.repeat((sums - steps)[starts], some)


class Grams:
    """The trigrams of some texts, as word ids: b, c of each place, and what of them a model is asked for.

    Asked are pairs of known words, by shard and id (``pairs``, and ``bounds`` of
    the shards), and for each of them the known third words (``lens`` of the pairs,
    ``thirds``).  ``head``, ``tail`` and ``triple`` name what each place asked, or are -1.
    Words may be given, and ``b`` and ``c`` are then, as positions in ``places``, the
    unknown word and what ``asked_words`` gives: these are small, and in the ids' order.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, shards: int, places: np.ndarray | None = None) -> None:
        ends = np.cumsum(counts + 3)
        line = np.full(int(ends[-1]) if len(ends) else 0, START, np.int32)
        begin = ends - (counts + 3)
        inside = np.ones(len(line), bool)
        inside[begin] = inside[begin + 1] = inside[ends - 1] = False
        line[inside] = ids
        line[ends - 1] = END
        at = np.flatnonzero(line != START).astype(np.int32)
        self.b, self.c = line[at - 1], line[at]
        # Each place's pair with the one before it, once: it is the tail of one trigram and the head of the next.
        known = line != UNKNOWN
        known[1:] &= known[:-1].copy()
        known[begin] = False
        ends_pair = np.flatnonzero(known).astype(np.int32)
        del inside, known
        top = int(line.max(initial=END)) + 1
        pairs, which, _ = distinct(line[ends_pair - 1].astype(np.int64) * top + line[ends_pair], top * top)
        first = pairs // top
        second = pairs - first * top
        pairs = first << 32 | second if places is None else places[first] << 32 | places[second]
        shard = shard_of(pairs, shards)
        order = by_shard(shard, shards)
        self.pairs = pairs[order]
        self.bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        pair_at = np.full(len(line), -1, np.int32)
        pair_at[ends_pair] = place[which]
        del line, ends_pair, pairs, first, second, which, shard, order, place
        self.head, self.tail = pair_at[at - 1], pair_at[at]
        del pair_at, at
        self.triple = np.full(len(self.c), -1, np.int32)
        abc = np.flatnonzero((self.head >= 0) & (self.tail >= 0)).astype(np.int32)
        codes, which, self.times = distinct(self.head[abc].astype(np.int64) * top + self.c[abc], max(len(self.pairs), 1) * top)
        self.triple[abc] = which
        del abc, which
        self.of_third = (codes // top).astype(np.int32)
        thirds = codes - self.of_third * np.int64(top)
        self.lens, self.thirds = np.bincount(self.of_third, minlength=len(self.pairs)), thirds if places is None else places[thirds]
        self.third_bounds = np.concatenate([[0], np.cumsum(self.lens)])[self.bounds]

    def shards(self) -> Iterator[tuple[int, slice, slice]]:
        """Each shard that is asked, its pairs and its thirds."""
        for s, (i, j, k, m) in enumerate(zip(self.bounds[:-1], self.bounds[1:], self.third_bounds[:-1], self.third_bounds[1:], strict=True)):
            if j > i:
                yield s, slice(i, j), slice(k, m)


def to_blocks(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to blocks: ids, languages, numbers of words, the distinct words, and the words as indexes, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for number, batch in enumerate(slices(batches, "text", block_bytes)):
            words, index, counts = batch_words(batch.column("text"))
            order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            out = [first + number, pack(batch.column("doc_id").to_numpy()), batch.column("lang").to_pylist(), pack(counts.astype("<u4")), pack_words(words.take(pa.array(order))), pack(rank[index].astype("<u4")), int(counts.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, BLOCK, strict=True)], schema=BLOCK)

    return run


BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("langs", pa.list_(pa.string())), ("counts", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary()), ("n", pa.int64())])
BLOCK_DDL = "block long, ids binary, langs array<string>, counts binary, words binary, tokens binary, n long"


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}


def table_of(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each document stands: doc_id, block, place."""
    for row in rows_of(batches):
        ids = unpack(row["ids"])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids), dtype=np.int32))], names=["doc_id", "block", "place"])


def in_training(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Masks of a block's trusted documents, and of those of them that the model is trained on."""
    ids = unpack(row["ids"])
    trusted = np.zeros(len(ids), bool)
    trusted[np.array(row["trusted"] or [], np.int64)] = True
    return trusted, trusted & np.array([zlib.crc32(str(d).encode()) % HELD_OUT != 0 for d in ids.tolist()], bool)


def hashed(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a block's words in order, and which of them each word has."""
    return np.unique(word_keys(unpack_words(words)), return_inverse=True)


ASK = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("lens", pa.binary()), ("thirds", pa.binary()), ("counts", pa.binary())])
ASK_DDL = "kind string, shard int, block long, keys binary, lens binary, thirds binary, counts binary"


def ask_words(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks' distinct words, and how often the training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys, which = hashed(row["words"])
            _, used = in_training(row)
            tokens = unpack(row["tokens"])[np.repeat(used, unpack(row["counts"]).astype(np.int64))]
            counts = np.bincount(which[tokens], minlength=len(keys))
            at = cut(keys, shards)
            yield from table_of([("word", s, row["block"], pack(keys[i:j], rising=True), None, None, pack(counts[i:j].astype("<u4"))) for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i], ASK)

    return run


def named(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A shard gives ids to the words that the training texts have, small ones to the frequent, and answers each block with them; others are unknown."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        keys = [unpack(x, rising=True) for x in group["keys"]]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(which, np.concatenate([unpack(x) for x in group["counts"]]), len(distinct))
        order = np.argsort(-sums, kind="stable")[: int((sums > 0).sum())]
        ids = np.full(len(distinct), UNKNOWN, np.int64)
        ids[order] = 3 + np.arange(len(order)) * shards + int(group["shard"].iloc[0])
        if len(ids) and ids.max() >= 1 << 31:
            raise ValueError("more than 2**31 distinct words in the training texts")
        ends = np.cumsum([len(k) for k in keys])
        out = [(int(s), int(b), pack(ids[which[e - len(k) : e]].astype("<u4"))) for s, b, k, e in zip(group["shard"], group["block"], keys, ends, strict=True)]
        return pd.DataFrame(out, columns=["shard", "block", "ids"])

    return run


def name_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a block's words, in the words' order."""
    for row in rows_of(batches):
        _, which = hashed(row["words"])
        ids = np.concatenate([*(unpack(a["ids"]) for a in sorted(row["answers"] or [], key=lambda a: a["shard"])), np.zeros(0, "<u4")])
        yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([pack(ids[which].astype("<u4"))], pa.binary()), pa.array([row["trusted"]], pa.list_(pa.int32()))], names=["block", "names", "trusted"])


def train_grams(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trigrams of the training texts and their counts, by shard of their first two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, used = in_training(row)
            counts = unpack(row["counts"]).astype(np.int64)
            if used.any():
                places, at = ranked(unpack(row["names"]))
                g = Grams(at[unpack(row["tokens"])[np.repeat(used, counts)]], counts[used], shards, places)
                yield from table_of([("triple", s, row["block"], pack_keys(g.pairs[p], shards), pack(g.lens[p].astype("<u4")), pack_thirds(g.thirds[t], g.lens[p]), pack(g.times[t].astype("<u4"))) for s, p, t in g.shards()], ASK)

    return run


#: A shard's table, a row each, and what it sends to other shards of the next table.
TABLE_DDL = "shard int, keys binary, lens binary, thirds binary, counts binary, of_counts array<long>, total long, onward array<struct<shard: int, keys: binary, counts: binary>>"


def _table(group: pd.DataFrame, keys: bytes, lens: bytes | None, thirds: bytes | None, counts: bytes, of_counts: list[int], total: int, onward: list[dict]) -> pd.DataFrame:
    row = (int(group["shard"].iloc[0]), keys, lens, thirds, counts, of_counts, total, onward)
    return pd.DataFrame([row], columns=["shard", "keys", "lens", "thirds", "counts", "of_counts", "total", "onward"])


def _keys(rows: pd.DataFrame, shards: int) -> list[np.ndarray]:
    return [unpack_keys(k, s, shards) for k, s in zip(rows["keys"], rows["shard"], strict=True)]


def _thirds(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many third words each pair has that rows list, and these."""
    lens = [unpack(x) for x in rows["lens"]]
    return np.concatenate(lens), np.concatenate([unpack_thirds(x, n) for x, n in zip(rows["thirds"], lens, strict=True)])


def _dealt(keys: np.ndarray, shards: int, counts: np.ndarray | None = None) -> list[dict]:
    """Keys (in order) and their counts (a row each) by shard."""
    shard = shard_of(keys, shards)
    order = by_shard(shard, shards)
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return [{"shard": int(shard[some[0]]), "keys": pack_keys(keys[some], shards), "counts": None if counts is None else pack(np.ascontiguousarray(counts[..., some]).ravel())} for some in np.split(order, at[1:]) if len(some)]


def count_triples(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A shard's table of trigrams, and for each pair how many different words stand before it there (after a start: counts)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lens, thirds = _thirds(group)
        heads, which = np.unique(np.repeat(np.concatenate(_keys(group, shards)), lens), return_inverse=True)
        codes, at = np.unique(which << 32 | thirds, return_inverse=True)
        n3 = np.bincount(at, np.concatenate([unpack(x) for x in group["counts"]]), len(codes)).astype(np.int64)
        head, third = codes >> 32, codes & LOW
        second = heads[head] & LOW
        tails, tail = np.unique(second << 32 | third, return_inverse=True)
        n2 = np.bincount(tail, np.where(second == START, n3, 1), len(tails)).astype(np.int64)
        lens = np.bincount(head, minlength=len(heads))
        return _table(group, pack_keys(heads, shards), pack(lens.astype("<u4")), pack_thirds(third, lens), pack(n3.astype("<u4")), times(n3), 0, _dealt(tails, shards, n2))

    return run


def _added(group: pd.DataFrame, columns: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the rows, and the sums of their counts."""
    distinct, which = np.unique(np.concatenate(_keys(group, shards)), return_inverse=True)
    counts = np.concatenate([unpack(x).reshape(columns, -1) for x in group["counts"]], axis=1)
    return distinct, np.array([np.bincount(which, c, len(distinct)) for c in counts]).astype(np.int64)


def count_pairs(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A shard's table of pairs, and what it adds to the words: how many pairs end in each, and what follows each."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pairs, (n2,) = _added(group, 1, shards)
        words, which = np.unique(np.concatenate([pairs >> 32, pairs & LOW]), return_inverse=True)
        first, second = which[: len(pairs)], which[len(pairs) :]
        stats = np.vstack([np.bincount(second, minlength=len(words)), context_stats(n2, first, len(words))])
        return _table(group, pack_keys(pairs, shards), None, None, pack(n2), times(n2), 0, _dealt(words, shards, stats))

    return run


def count_words(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A shard's table of words."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        words, stats = _added(group, STATS, shards)
        return _table(group, pack_keys(words, shards), None, None, pack(stats.ravel()), times(stats[0][stats[0] > 0]), int(stats[0].sum()), [])

    return run


def ask_model(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All that a block's texts need of the model: its known words, pairs and trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            places, at = ranked(unpack(row["names"]))
            g = Grams(at[unpack(row["tokens"])], unpack(row["counts"]).astype(np.int64), shards, places)
            out = [("pair", s, row["block"], pack_keys(g.pairs[p], shards), pack(g.lens[p].astype("<u4")), pack_thirds(g.thirds[t], g.lens[p]), None) for s, p, t in g.shards()]
            yield from table_of([*out, *(("word", x["shard"], row["block"], x["keys"], None, None, None) for x in _dealt(places[1:], shards))], ASK)

    return run


def asked_words(names: np.ndarray) -> np.ndarray:
    """A block's known words, with the start and the end."""
    known = np.sort(np.concatenate([names.astype(np.int64), [START, END]]))
    return known[(known != UNKNOWN) & (np.diff(known, prepend=UNKNOWN) != 0)]


def ranked(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unknown word and a block's known words in order, and where in these each of its names is."""
    places = np.append(UNKNOWN, asked_words(names))
    return places, np.searchsorted(places, names.astype(np.int64)).astype(np.int32)


ANSWER_DDL = "kind string, shard int, block long, stats binary, n3 binary"


def answer(shards: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a shard's tables, a row with nulls for those it has not, know of the words, pairs and trigrams that blocks ask for."""

    def of_kind(kind: str, asks: pd.DataFrame, model: dict) -> list[tuple]:
        shard = int(asks["shard"].iloc[0])
        keys = _keys(asks, shards)
        wanted = np.concatenate(keys)
        stats, n3 = np.zeros((STATS, len(wanted)), np.int64), None
        if kind == "word":
            if model["word_keys"] is not None:
                at = _found(unpack_keys(model["word_keys"], shard, shards), wanted)
                stats = _values(unpack(model["word_counts"]).reshape(STATS, -1), at)
        else:
            asked_lens, thirds = _thirds(asks)
            n3 = np.zeros(len(thirds), np.int64)
            if model["pair_keys"] is not None:
                stats[0] = _values(unpack(model["pair_counts"]), _found(unpack_keys(model["pair_keys"], shard, shards), wanted))
            if model["triple_keys"] is not None:
                heads, lens = unpack_keys(model["triple_keys"], shard, shards), unpack(model["triple_lens"])
                known = unpack_thirds(model["triple_thirds"], lens)
                counts, of_head = unpack(model["triple_counts"]).astype(np.int64), np.repeat(np.arange(len(lens)), lens)
                at = _found(heads, wanted)
                stats[1:] = _values(context_stats(counts, of_head, len(heads)), at)
                head = np.repeat(at, asked_lens)
                some = np.flatnonzero(head >= 0)
                n3[some] = _values(counts, _found(of_head << 32 | known, head[some] << 32 | thirds[some]))
            third_ends = np.concatenate([[0], np.cumsum(asked_lens, dtype=np.int64)])
        out, before = [], 0
        for block, k in zip(asks["block"], keys, strict=True):
            end = before + len(k)
            out.append((kind, shard, int(block), pack(np.ascontiguousarray(stats[:, before:end]).ravel()), None if n3 is None else pack(n3[third_ends[before] : third_ends[end]].astype("<u4"))))
            before = end
        return out

    def run(asks: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = [x for kind, rows in asks.groupby("kind") for x in of_kind(kind, rows.sort_values("block"), model.iloc[0].to_dict())]
        return pd.DataFrame(out, columns=["kind", "shard", "block", "stats", "n3"])

    return run


SCORE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("log_probability", pa.float64()), ("held", pa.bool_())])
SCORE_DDL = "doc_id long, lang string, n_tokens long, log_probability double, held boolean"
#: Places of a block that are evaluated at once.
PLACES = 1 << 18


def evaluated(totals: Totals, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stats_of(row: dict, kind: str) -> tuple[np.ndarray, list[dict]]:
        answers = sorted((a for a in row["answers"] or [] if a["kind"] == kind), key=lambda a: a["shard"])
        return np.concatenate([np.zeros((STATS, 0), np.int64), *(unpack(a["stats"]).reshape(STATS, -1) for a in answers)], axis=1), answers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            counts = unpack(row["counts"]).astype(np.int64)
            places, at = ranked(unpack(row["names"]))
            g = Grams(at[unpack(row["tokens"])], counts, shards, places)
            words = places[1:]
            word_stats = np.zeros((STATS, len(words)), np.int64)
            word_stats[:, by_shard(shard_of(words, shards), shards)] = stats_of(row, "word")[0]
            # An unknown word stands in front of the known: nothing is counted of it.
            p1 = np.append(totals.p1(np.zeros(1, np.int64)), totals.p1(word_stats[0]))
            g1 = np.append(1.0, left(word_stats, totals.d2))
            pair_stats, answers = stats_of(row, "pair")
            n2, n3 = pair_stats[0], np.concatenate([*(unpack(a["n3"]) for a in answers), np.zeros(0, np.uint32)])
            g2 = np.append(left(pair_stats, totals.d3), 1.0)
            del g.lens, g.thirds, g.times  # only what asks needs them
            # What each pair and trigram has of its own, once; nothing where it was not asked.
            own2 = np.append((n2 - totals.d2[np.minimum(n2, 3)]) / np.maximum(word_stats[1][np.searchsorted(words, g.pairs >> 32)], 1), 0.0)
            own3 = np.append((n3 - totals.d3[np.minimum(n3, 3)]) / np.maximum(pair_stats[1], 1)[g.of_third], 0.0)
            del pair_stats, answers
            log_p = np.empty(len(g.c))
            for i in range(0, len(log_p), PLACES):
                at = slice(i, i + PLACES)
                b, c = g.b[at], g.c[at]
                log_p[at] = np.log(g2[g.head[at]] * (g1[b] * p1[c] + own2[g.tail[at]]) + own3[g.triple[at]])
            trusted, used = in_training(row)
            out = [unpack(row["ids"]), row["langs"], counts + 1, np.bincount(np.repeat(np.arange(len(counts)), counts + 1), log_p, len(counts)), trusted & ~used]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, SCORE, strict=True)], schema=SCORE)

    return run


def scored(docs: DataFrame, trusted: DataFrame, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS, round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """doc_id, lang, n_tokens (words and the end), log_probability (natural), held (trusted, and not trained on) of each document.

    The model is trained on all documents whose ids ``trusted`` has (each once),
    but for one in HELD_OUT of them by crc32 of the id.  The result is staged; all
    else that was staged or shuffled for it is gone when this returns.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    many = max(2, own.rdd.getNumPartitions())
    with Scratch(spark) as scratch:
        blocks = scratch.stage_by(map_arrow(own, to_blocks(block_bytes), BLOCK_DDL), "block", many)
        tokens = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        shards = max(2, -(-tokens // shard_tokens))
        ids = map_arrow(blocks.select("block", "ids"), placed, "doc_id long, block long, place int")
        good = scratch.stage(ids.join(trusted.select("doc_id"), "doc_id", "left_semi").groupBy("block").agg(F.collect_list("place").alias("trusted")))

        def grouped(df: DataFrame):
            return df.repartition(shards, "shard").groupBy("shard")

        # Words get ids.
        asks = map_arrow(blocks.join(good, "block", "left"), ask_words(shards), ASK_DDL)
        names = map_groups(grouped(asks.select("shard", "block", "keys", "counts")), named(shards), "shard int, block long, ids binary")
        answers = names.repartition(many, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "ids")).alias("answers"))
        met = blocks.select("block", "words").join(answers.hint("shuffle_hash"), "block", "left").join(good, "block", "left")
        ided = scratch.stage_by(map_arrow(met, name_words, "block long, names binary, trusted array<int>"), "block", many)
        texts = blocks.select("block", "ids", "langs", "counts", "tokens").join(ided.hint("shuffle_hash"), "block")
        # The model: trigrams, pairs by what stands before them, words by what pairs end in them.
        triples = scratch.stage_by(map_groups(grouped(map_arrow(texts, train_grams(shards), ASK_DDL)), count_triples(shards), TABLE_DDL), "shard", shards)
        pairs = scratch.stage_by(map_groups(grouped(triples.select(F.inline("onward"))), count_pairs(shards), TABLE_DDL), "shard", shards)
        words = scratch.stage_by(map_groups(grouped(pairs.select(F.inline("onward"))), count_words(shards), TABLE_DDL), "shard", shards)
        tables = {"triple": triples, "pair": pairs, "word": words}
        sums = {}
        for kind, table in tables.items():
            sums[kind] = table.agg(F.array(*[F.sum(F.get("of_counts", F.lit(i))) for i in range(6)]).alias("of_counts"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
        totals = Totals.of({kind: [x or 0 for x in r.of_counts] for kind, r in sums.items()}, sums["word"].total)
        # A row for each shard; the tables lie in buckets by shard and are not moved.
        model = spark.range(shards).select(F.col("id").cast("int").alias("shard")).repartition(shards, "shard")
        for kind, table in tables.items():
            used = ["keys", "lens", "thirds", "counts"] if kind == "triple" else ["keys", "counts"]
            model = model.join(table.select("shard", *[F.col(c).alias(f"{kind}_{c}") for c in used]).hint("shuffle_hash"), "shard", "left")
        # The blocks ask for what they have, a part of them at a time: what a part moves is gone before the next.
        rounds = max(1, min(ROUNDS, tokens // round_tokens))
        dealt = F.shiftright("block", 24) + F.col("block").bitwiseAND((1 << 24) - 1)  # partition and number: parts are alike
        parts = []
        for k in range(rounds):
            some = texts.where(F.pmod(dealt, F.lit(rounds)) == k)
            asks = map_arrow(some, ask_model(shards), ASK_DDL)
            told = map_cogroups(grouped(asks.drop("counts")), model.groupBy("shard"), answer(shards), ANSWER_DDL)
            answers = told.repartition(many, "block").groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "stats", "n3")).alias("answers"))
            parts.append(stage(map_arrow(some.join(answers.hint("shuffle_hash"), "block"), evaluated(totals, shards), SCORE_DDL)))
    return reduce(DataFrame.unionByName, parts)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold, kept for each document.

    docs needs doc_id, text, lang; labels doc_id, quality, toxic.  Trusted is what
    the labels call good and not toxic (a null label is not).  The model is trained
    on all trusted documents but for one in HELD_OUT by crc32 of the id.  The
    threshold of a language is exp(q + slack + 3 / sqrt(n)), q being the given
    quantile, to a thousandth, of log perplexity over its trusted documents that the
    model was not trained on, or over those of all languages where it has fewer than
    50, and n the document's tokens, as the mean of few wanders more; without any
    such document all documents with words are kept.  A null language is a language.
    Documents without words (null, empty, blank) are not kept.  Rows with a null
    doc_id are left out; repeated labels count once; an empty table gives an empty one.
    """
    own = docs.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull())
    trusted = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    scores = scored(own, trusted, block_bytes, shard_tokens)
    scores = scores.withColumn("level", -F.col("log_probability") / F.col("n_tokens"))
    held = scores.where("held and n_tokens > 1")
    # A histogram in steps of a thousandth: as many rows as levels, whatever the input, and the same in every run.
    steps = held.groupBy("lang", F.ceil(F.col("level") * 1000).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    every = steps.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "step", "n", F.lit(True).alias("all"))
    groups = steps.select("lang", "step", "n", F.lit(False).alias("all")).unionByName(every)
    by = Window.partitionBy("lang", "all")
    upto = F.sum("n").over(by.orderBy("step"))
    limits = groups.withColumn("upto", upto).withColumn("total", F.sum("n").over(by)).where(F.col("upto") >= quantile * F.col("total")).groupBy("lang", "all").agg(F.min("step").alias("step"), F.first("total").alias("total"))
    overall = limits.where("all").agg(F.max("step").alias("any_step"))
    own_limit = limits.where(~F.col("all") & (F.col("total") >= LEAST_TRUSTED)).select(F.col("lang").alias("of"), F.col("step").alias("own_step"))
    # A row for each language with enough trusted documents, and one for all.
    with_limit = scores.join(F.broadcast(own_limit), F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(overall))
    threshold = F.exp(F.coalesce("own_step", "any_step") / 1000 + slack + 3 / F.sqrt("n_tokens"))
    perplexity = F.exp("level")
    return with_limit.select("doc_id", "lang", "n_tokens", perplexity.alias("perplexity"), threshold.alias("threshold"), ((F.col("n_tokens") > 1) & F.coalesce(perplexity <= threshold, F.lit(True))).alias("kept"))
