"""Tile statistics on row arrays: a tile never leaves its row, and a batch of rows is worked out at once.

Rows are (name, cls, r, w array<int>).  Every function here returns what one Arrow
pass over the rows gives, so the only shuffles are those of the few sums after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship

#: Tensors whose tables of 256 ranks are broadcast, 1 kB each at most.
MOST_TENSORS = 50_000


class Rows:
    """A batch's words one after another, with the row, the place and the exponent of each."""

    def __init__(self, batch: pa.RecordBatch, order: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        self.batch, column = batch, batch.column("w")
        self.sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
        self.words = column.flatten().to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(batch.num_rows), self.sizes)
        begins = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.words)) - begins[self.row]
        if order is not None:
            r = batch.column("r").to_numpy()
            self.words = self.words[np.lexsort((self.place, order(r[self.row], self.place), self.row))]
        self.exponents = (self.words >> 7) & 255

    def tiles(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where tiles begin, the tile of each word, and how many words each has."""
        begins = np.flatnonzero(self.place % t == 0)
        tile = np.cumsum(self.place % t == 0) - 1
        return begins, tile, np.diff(np.append(begins, len(self.words)))

    def named(self, begins: np.ndarray, t: int, **columns: np.ndarray) -> pa.RecordBatch:
        """A row for each tile: name, cls, r, t and the columns."""
        at = pa.array(self.row[begins])
        keys = [self.batch.column(k).take(at) for k in ("name", "cls", "r")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(self.place[begins] // t), *(pa.array(x.astype(np.int64)) for x in columns.values())], names=["name", "cls", "r", "t", *columns])


def in_hash_order(seed: int = 1) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Sort keys that lay each row out in the order of an integer hash of (row, place), which SQL can compute too."""

    def keys(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (r * 7919 + c * 104_729 + seed) % 2_147_483_647 * 48_271 % 2_147_483_647

    return keys


def mapped(rows: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(batch.column("w").flatten()):
                yield one(batch)

    return rows.mapInArrow(run, schema)


def counts(rows: DataFrame) -> DataFrame:
    """name, ex, n: exponents counted inside each batch, then per tensor."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = Rows(batch)
        names = batch.column("name").dictionary_encode()
        codes, n = np.unique(names.indices.to_numpy().astype(np.int64)[of.row] * 256 + of.exponents, return_counts=True)
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(codes // 256)), pa.array((codes % 256).astype(np.int32)), pa.array(n.astype(np.int64))], names=["name", "ex", "n"])

    return mapped(rows.select("name", "w"), one, "name string, ex int, n long").groupBy("name", "ex").agg(F.sum("n").alias("n"))


def with_ranks(rows: DataFrame, hist: DataFrame) -> DataFrame:
    """rows with ranks: the 256 ranks of their tensor's exponents, by count, ties by exponent."""
    by_name = hist.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("ex", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda e: F.struct((-F.coalesce(F.element_at("m", e), F.lit(0))).alias("n"), e.alias("ex")))
    order = F.transform(F.array_sort(dense), lambda x: x["ex"])
    place = F.transform(F.array_sort(F.transform("order", lambda ex, i: F.struct(ex.alias("ex"), i.alias("rk")))), lambda x: x["rk"])
    ranks = by_name.select("name", order.alias("order")).select("name", place.alias("ranks"))
    few = hist.select("name").distinct().limit(MOST_TENSORS + 1).count() <= MOST_TENSORS
    return rows.join(F.broadcast(ranks) if few else ranks, "name")


def palette_tiles(rows: DataFrame, t: int, order: Callable | None = None) -> DataFrame:
    """Per tile: k distinct exponents, n words, s1 to s4 (sums of the 1, 3, 7, 15 largest counts), u (unary code by count)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = Rows(batch, order)
        begins, tile, n = of.tiles(t)
        codes, cnt = np.unique(tile * 256 + of.exponents, return_counts=True)
        owner = codes // 256
        by = np.lexsort((codes, -cnt, owner))
        owner, cnt = owner[by], cnt[by]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        k = np.diff(np.append(first, len(owner)))
        j = np.arange(len(owner)) - np.repeat(first, k)
        sums = {f"s{b}": np.add.reduceat(np.where(j < (1 << b) - 1, cnt, 0), first) for b in (1, 2, 3, 4)}
        u = np.add.reduceat(cnt * (j + 1), first) - np.minimum.reduceat(cnt, first)
        return of.named(begins, t, k=k, n=n, **sums, u=u)

    return mapped(rows.select("name", "cls", "r", "w"), one, "name string, cls string, r long, t long, k long, n long, s1 long, s2 long, s3 long, s4 long, u long")


def rank_tiles(rows: DataFrame, t: int, order: Callable | None = None) -> DataFrame:
    """Per tile: n words, the largest rank, ranks beyond escape codes (e1 to e4), Golomb-Rice sums (q0 to q3); rows as with_ranks gives them."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = Rows(batch, order)
        begins, tile, n = of.tiles(t)
        rank = batch.column("ranks").flatten().to_numpy().astype(np.int64)[of.row * 256 + of.exponents]
        most = np.maximum.reduceat(rank, begins)
        over = {f"e{b}": np.add.reduceat((rank >= (1 << b) - 1).astype(np.int64), begins) for b in (1, 2, 3, 4)}
        rice = {}
        for k in range(4):
            q = rank >> k
            rice[f"q{k}"] = np.add.reduceat(q + 1 - (q == (most >> k)[tile]), begins)
        return of.named(begins, t, n=n, rmax=most, **over, **rice)

    return mapped(rows.select("name", "cls", "r", "w", "ranks"), one, "name string, cls string, r long, t long, n long, rmax long, e1 long, e2 long, e3 long, e4 long, q0 long, q1 long, q2 long, q3 long")


def row_entropies(rows: DataFrame) -> DataFrame:
    """name, n, h: the sum over rows of n times the entropy of their exponents (Miller-Madow), and of n."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = Rows(batch)
        codes, cnt = np.unique(of.row * 256 + of.exponents, return_counts=True)
        owner = codes // 256
        n = np.bincount(owner, cnt, batch.num_rows)
        some = n > 0
        logs = np.bincount(owner, cnt * np.log2(cnt), batch.num_rows)
        h = np.zeros(batch.num_rows)
        h[some] = n[some] * np.log2(n[some]) - logs[some] + (np.bincount(owner, minlength=batch.num_rows)[some] - 1) / (2 * np.log(2))
        return pa.RecordBatch.from_arrays([batch.column("name"), pa.array(n.astype(np.int64)), pa.array(h)], names=["name", "n", "h"])

    return mapped(rows.select("name", "w"), one, "name string, n long, h double").groupBy("name").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))


def rounded(words: np.ndarray, m: int) -> np.ndarray:
    """Words to m mantissa bits, half to even, their exponent kept; exponent 255 stays."""
    s = 7 - m
    mantissa = words & 0x7F
    q = np.minimum((mantissa + (1 << (s - 1)) - 1 + ((mantissa >> s) & 1)) >> s, (1 << m) - 1)
    return np.where((words >> 7) & 255 == 255, words, (words & 0xFF80) | (q << s))


def lossy_bins(rows: DataFrame, t: int, widths: tuple[int, ...], bins: int) -> DataFrame:
    """m, cls, bin, n, max_rel: tiles by their relative error when rounded to m bits, and the largest relative error of a word among them.

    Words of exponent 255 count as nothing, tiles of nothing but zeros are left out.
    """
    value = lambda w: (w.astype(np.uint32) << 16).view(np.float32).astype(np.float64)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = Rows(batch)
        begins, tile, _ = of.tiles(t)
        cls = batch.column("cls").dictionary_encode()
        owner = cls.indices.to_numpy().astype(np.int64)[of.row[begins]]
        special = of.exponents == 255
        exact = np.where(special, 0, value(np.where(special, 0, of.words)))
        size = np.add.reduceat(exact * exact, begins)
        out: list[tuple] = []
        for m in widths:
            apart = np.abs(exact - np.where(special, 0, value(np.where(special, 0, rounded(of.words, m)))))
            with np.errstate(divide="ignore", invalid="ignore"):
                error = np.sqrt(np.add.reduceat(apart * apart, begins) / size)
                most = np.maximum.reduceat(np.where(exact != 0, apart / np.abs(exact), 0), begins)
                at = np.where(error <= 0, 0, np.clip(np.floor((np.log10(error) + 8) * 200), 0, bins - 1))
            real = size > 0
            codes, which, n = np.unique(owner[real] * bins + at[real].astype(np.int64), return_inverse=True, return_counts=True)
            top = np.zeros(len(codes))
            np.maximum.at(top, which, most[real])
            out.append((np.full(len(codes), m), codes // bins, codes % bins, n, top))
        m, owner, at, n, top = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), cls.dictionary.take(pa.array(owner)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(top)], names=["m", "cls", "bin", "n", "max_rel"])

    return mapped(rows.select("cls", "w"), one, "m int, cls string, bin int, n long, max_rel double").groupBy("m", "cls", "bin").agg(F.sum("n").alias("n"), F.max("max_rel").alias("max_rel"))
