"""SimHash near-duplicates: pigeonhole blocks, Hamming distance, components.

Fingerprints are cut into blocks such that two close ones share a block (or a
combination of blocks).  Rows meet by block; a task walks its buckets in key
order, compares fingerprints by xor and bit count, and emits links that span a
bucket's groups, not all its pairs.  Buckets above a bound are cut into parts,
and each two parts meet in a task of their own, so no bucket is too large for a
task and no pair is missed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import map_arrow, ship
from ._common import stage
from .components import components
from .tokens import slices

SEED = 42
#: Members of a bucket above which it is dealt out by pairs of parts.
HOT = 16_384
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n successive words of the lower-cased text, space-joined; fewer words: of all of them; none: empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts = raw.lower().split()  # bytes: A-Z, and the six ASCII white space characters
    if not parts:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(parts))
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = min(n, len(parts))
    digest = xxhash.xxh64_intdigest
    a, b = starts[: len(parts) - n + 1].tolist(), ends[n - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """(len, words) uint64: the hash itself, then hashes of it."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for j in range(1, words):
        x = hashes + np.uint64((j * GOLDEN) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, j] = x ^ (x >> np.uint64(31))
    return out


def majority(hashes: list[np.ndarray], words: int, rows: int = 8192) -> np.ndarray:
    """(documents, words) uint64: a bit is 1 if over half of the document's hashes have it.

    Bits are laid out as bytes and eight bytes summed at once, over at most 255
    rows before they are widened.
    """
    size = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), words * 64), np.int64)
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    ends = np.cumsum(size)
    for i in range(0, len(flat), rows):
        part = spread(flat[i : i + rows], words)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1)
        doc = np.searchsorted(ends, np.arange(i, i + len(part)), side="right")
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        begin = np.unique(np.concatenate([first, *[np.arange(a, b, 255) for a, b in zip(first, [*first[1:], len(part)], strict=True) if b - a > 255]]))
        sums = np.add.reduceat(bits.view(np.uint64), begin, axis=0).view(np.uint8)
        np.add.at(counts, doc[begin], sums)
    packed = np.packbits(counts * 2 > size[:, None], axis=1)
    return packed.reshape(len(hashes), words, 8).view(">u8")[:, :, 0].astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, distinct: bool = False, batch_chars: int = 4 << 20) -> DataFrame:
    """doc_id, f0, f1, ... (bigint, the bits of unsigned words).

    docs needs doc_id and text; others are ignored.  Shingles count as often as
    they occur, or once with ``distinct``.  Null and blank texts have fingerprint 0.
    Rows with a null doc_id are left out.
    """
    fields = [f"f{j}" for j in range(words)]
    schema = pa.schema([("doc_id", pa.int64()), *((f, pa.int64()) for f in fields)])

    def made(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, shingle) for t in texts]
        out = majority([np.unique(h) for h in hashes] if distinct else hashes, words)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(out[:, j].view(np.int64)) for j in range(words))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", batch_chars):
            yield made(batch.column("doc_id"), batch.column("text").to_pylist())

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return map_arrow(own, run, "doc_id long, " + ", ".join(f"{f} long" for f in fields))


def pigeonholes(bits: int = 64, most: int = 3, blocks: int = 5) -> list[list[tuple[int, int]]]:
    """Combinations of blocks, as (shift, width): whoever differs in at most ``most`` bits agrees in all of one of them."""
    width = [bits // blocks + (i < bits % blocks) for i in range(blocks)]
    at = [(sum(width[:i]), width[i]) for i in range(blocks)]
    return [list(x) for x in itertools.combinations(at, blocks - most)]


def block_key(column: Column, which: int, parts: list[tuple[int, int]]) -> Column:
    key = F.lit(0).cast("long")
    for shift, width in parts:
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return key.bitwiseOR(F.lit(which << 48))


def linked(most: int | None, words: int, small: int = 16, similarity: float = 0.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in bucket order (bucket, one, node, c0, ...) to links a, b of at most ``most`` differing bits that span each bucket's groups.

    With a null ``one`` all members compare; in buckets that were dealt out, ``one``
    tells the part, and both parts compare.  Without ``most`` the last word is the
    size of a set and the others are its parity bits (see ``set_prints``): links are
    those that may have the similarity.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if most is None:
            m, n = x[..., -1].astype(np.int64), y[..., -1].astype(np.int64)
            apart = np.bitwise_count(x[..., :-1] ^ y[..., :-1]).sum(axis=-1, dtype=np.int64)
            return (apart <= apart_at_most(m + n, similarity)) & (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-9)
        return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= most

    def spanned(node: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Breadth first over what has not been reached: a member is compared with the rest once."""
        rest, a, b = np.arange(len(node)), [], []
        queue: list[int] = []
        while len(rest):
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
            i = queue.pop()
            hit = near(c[i], c[rest])
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                a.append(np.full(len(found), node[i]))
                b.append(node[found])
                queue += found.tolist()
        return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])

    def links(bucket: np.ndarray, node: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begin = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1) != 0)
        size = np.diff(np.append(begin, len(bucket)))
        for i in np.flatnonzero(size > small):
            yield spanned(node[begin[i] : begin[i] + size[i]], c[begin[i] : begin[i] + size[i]])
        short = np.repeat(size <= small, size)
        bucket, node, c = bucket[short], node[short], c[short]
        for d in range(1, small):
            at = np.flatnonzero(bucket[d:] == bucket[:-d])
            if not len(at):
                break
            at = at[near(c[at], c[at + d])]
            yield node[at], node[at + d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append(batch)
                rows += batch.num_rows
                if rows < 65_536:
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            bucket = table["bucket"].to_numpy()
            cut = len(bucket) if batch is None else int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            held, rows = ([table.slice(cut).to_batches()[0]], len(bucket) - cut) if cut < len(bucket) else ([], 0)
            if cut:
                done = table.slice(0, cut)
                c = np.stack([done[f"c{j}"].to_numpy() for j in range(words)], axis=1).view(np.uint64)
                for a, b in links(bucket[:cut], done["node"].to_numpy(), c):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def dealt(rows: DataFrame, hot: int) -> DataFrame:
    """rows with ``bucket`` replaced where over ``hot`` members share it: each two of its parts get a bucket of their own."""
    large = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > hot)
    parts = F.ceil(F.col("members") / (hot / 2)).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    pairs = F.when(F.col("members").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.least(i, mine).cast("long") * (1 << 20) + F.greatest(i, mine).cast("long") + 1)
    )
    joined = rows.join(large.select(F.col("bucket").alias("large"), "members"), F.col("bucket") == F.col("large"), "left")
    spread_out = joined.withColumn("pair", F.explode(pairs))
    return spread_out.withColumn("bucket", F.when(F.col("pair") == 0, F.col("bucket")).otherwise(F.xxhash64("bucket", "pair"))).drop("pair", "large", "members")


def near_links(nodes: DataFrame, keys: list[Column], checks: list[str], most: int, hot: int = HOT) -> DataFrame:
    """a, b: links between nodes that share one of the keys and differ in at most ``most`` bits of the ``checks`` columns together."""
    return matched(nodes.select("node", *[F.col(x).alias(f"c{j}") for j, x in enumerate(checks)], F.explode(F.array(*keys)).alias("bucket")), len(checks), most, hot)


def matched(rows: DataFrame, words: int, most: int | None, hot: int, similarity: float = 0.0) -> DataFrame:
    """a, b from rows of bucket, node, c0, ...: links of at most ``most`` differing bits (without: see ``linked``) inside buckets."""
    met = dealt(rows, hot).repartition("bucket").sortWithinPartitions("bucket")
    return map_arrow(met, linked(most, words, similarity=similarity), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, most: int = 3, blocks: int = 5, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (bigint, unsigned bits), component_id: the smallest doc_id reachable over links of at most ``most`` bits.

    Works on distinct fingerprints, so copies cost a row each and no link.  A null
    or blank text has fingerprint 0 and is linked like any other.  doc_id must be
    unique; rows without one are left out.  An empty table gives an empty one.
    """
    prints = stage(fingerprints(docs, shingle).withColumnRenamed("f0", "node"))
    nodes = stage(prints.groupBy("node").agg(F.min("doc_id").alias("first")))
    keys = [block_key(F.col("node"), i, parts) for i, parts in enumerate(pigeonholes(64, most, blocks))]
    reach = components(near_links(nodes, keys, ["node"], most, hot)).withColumnRenamed("node", "of")
    named = nodes.join(reach.hint("merge"), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.select("node", "root").join(least, "root").drop("root"), "node").select("doc_id", F.col("node").alias("fingerprint"), "component_id")


# Near copies by Jaccard similarity: wide fingerprints find the candidates, and the shingles decide.

CHECKS = 2
#: Sets of up to so many shingles are found without chance.
SMALL = 256
#: Words of parity bits.
PARITY = 4


def wide_blocks(similarity: float, miss: float = 0.001, width: int = 16) -> tuple[int, int]:
    """Bits of a block and number of blocks, whatever the table.

    Large sets of Jaccard similarity s differ in a share p = acos(2s / (1 + s)) / pi
    of their bits, so share a block of w bits with probability (1 - p)**w; there are
    as many blocks as make the chance to share none ``miss``.  Small sets may differ
    in more bits; these meet by their prefixes.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return width, math.ceil(math.log(miss) / math.log1p(-((1 - p) ** width)))


def apart_at_most(sizes: np.ndarray | int, similarity: float) -> np.ndarray:
    """How many elements may be in one of two sets only, for the sum of their sizes: (m + n)(1 - s) / (1 + s)."""
    return np.floor(np.asarray(sizes) * ((1 - similarity) / (1 + similarity)) + 1e-9).astype(np.int64)


def set_prints(docs: DataFrame, shingle: int, words: int, similarity: float, small: int, batch_chars: int = 4 << 20) -> DataFrame:
    """doc_id, the fingerprint of the distinct shingles (f0, f1, ...), their number (size), parity bits (p0, ...) and prefix.

    Of two sets of similarity s, each has a hash that both share among its
    n - ceil(s n) + 1 smallest: its prefix.  Sets of up to ``small`` / s hashes have
    one, so that each of up to ``small`` meets all that it may be similar to; others
    have none.  Each hash flips one parity bit: sets differ in at least as many
    hashes as in bits.
    """
    bits = 64 * PARITY
    fields = [*(f"f{j}" for j in range(words)), "size", *(f"p{j}" for j in range(PARITY))]
    schema = pa.schema([("doc_id", pa.int64()), *((f, pa.int64()) for f in fields), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", batch_chars):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
            prints = majority(sets, words)
            parity = np.zeros((len(sets), PARITY), np.int64)
            prefix: list = [[]] * len(sets)
            for i, h in enumerate(sets):
                if len(h) and len(h) * similarity <= small + 1e-9:
                    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                    parity[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    prefix[i] = h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64)
            size = np.array([len(h) for h in sets], np.int64)
            longs = [*(prints[:, j].view(np.int64) for j in range(words)), size, *(np.ascontiguousarray(parity[:, j]) for j in range(PARITY))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, longs), pa.array(prefix, pa.list_(pa.int64()))], schema=schema)

    return map_arrow(docs, run, "doc_id long, " + ", ".join(f"{f} long" for f in fields) + ", prefix array<long>")


def block_bits(first: int, end: int, width: int, blocks: int) -> np.ndarray:
    """(blocks, width) numbers of bits, from successive shuffles of first..end-1."""
    rng = np.random.default_rng(SEED)
    drawn = np.concatenate([rng.permutation(np.arange(first, end)) for _ in range(-(-width * blocks // (end - first)))])
    return drawn[: width * blocks].reshape(blocks, width)


def wide_rows(words: int, blocks: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes with f0, f1, ... to a row for each block: node, c0, c1 (their first words) and bucket."""
    weight = np.int64(1) << np.arange(blocks.shape[1], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                n = batch.num_rows
                f = np.stack([batch.column(f"f{j}").to_numpy() for j in range(words)], axis=1).astype(">i8")
                bits = np.unpackbits(f.view(np.uint8).reshape(n, -1), axis=1)
                key = np.stack([bits[:, some] @ weight for some in blocks], axis=1) | (np.arange(len(blocks), dtype=np.int64) << 48)
                again = np.repeat(np.arange(n), len(blocks))
                same = [batch.column(x).to_numpy()[again] for x in ("node", "f0", "f1")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(key.ravel())], names=["node", "c0", "c1", "bucket"])

    return run


def jaccard_links(similarity: float, columns: int = 65_536) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """node and hashes (sorted, distinct) of a group to links a, b that span its parts of at least that similarity."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node = group["node"].to_numpy()
        sets = group["hashes"].tolist()
        n = len(node)
        size = np.array([len(s) for s in sets], np.float32)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size.astype(np.int64))
        both = np.zeros((n, n), np.float32)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        # A hash that one document has alone meets nobody: only shared ones become columns.
        shared = np.repeat(np.bincount(code) > 1, np.bincount(code))
        code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
        width = max(1, min(columns, (64 << 20) // (4 * n)))
        for c in range(0, int(code.max(initial=-1)) + 1, width):
            at = slice(*np.searchsorted(code, [c, c + width]))
            has = np.zeros((n, width), np.float32)
            has[owner[at], code[at] - c] = 1
            both += has @ has.T
        union = size[:, None] + size[None, :] - both
        near = both >= np.float32(similarity) * union
        a, b, rest, queue = [], [], np.arange(n), []
        while len(rest):
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
            i = queue.pop()
            hit = near[i, rest]
            a += [node[i]] * int(hit.sum())
            b += node[rest[hit]].tolist()
            queue += rest[hit].tolist()
            rest = rest[~hit]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def set_hashes(docs: DataFrame, shingle: int) -> DataFrame:
    """node and hashes (sorted, distinct) of the shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return map_arrow(docs, run, "node long, hashes array<long>")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, members: int = 1024, hot: int = HOT) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable) over pairs whose sets of shingles have at least that Jaccard similarity.

    Pairs of which one has at most SMALL shingles are found for certain: they share a
    hash of their prefixes, and their sizes and parity bits allow the similarity.
    Larger ones go by fingerprints of 1024 bits over distinct shingles: pairs that
    share a block and differ in at most a quarter of 128 bits are candidates (sets of
    similarity 0.8 differ in 15 %, unrelated ones in half).  Blocks don't depend on
    the table, so neither does what is found.  Only the documents of candidate
    groups have their shingles compared, in parts of at most ``members``, each two
    parts in a group of their own.  Copies (equal fingerprints, sizes, parity
    bits and prefixes) cost a row each.  Documents without words are copies of each other.  doc_id must be unique;
    rows without one are left out; other columns are ignored.  An empty table gives
    an empty one.
    """
    words = 16
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    fields = [*(f"f{j}" for j in range(words)), "size"]
    parity = [f"p{j}" for j in range(PARITY)]
    prints = stage(set_prints(own, shingle, words, similarity, SMALL).withColumn("print", F.xxhash64(*fields, *parity, "prefix")))
    # A node is a distinct set, as far as its prints tell, named by its smallest document.
    nodes = stage(prints.groupBy("print").agg(F.min("doc_id").alias("node"), *[F.first(f).alias(f) for f in fields]))
    small = prints.where(F.size("prefix") > 0).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sketch = [F.col(x).alias(f"c{j}") for j, x in enumerate([*parity, "size"])]
    exact = matched(small.select(F.col("doc_id").alias("node"), *sketch, F.explode("prefix").alias("bucket")), PARITY + 1, None, hot, similarity)
    width, blocks = wide_blocks(similarity)
    large = nodes.where(F.col("size") > SMALL).select("node", *fields[:-1])
    rows = map_arrow(large, wide_rows(words, block_bits(64 * CHECKS, 64 * words, width, blocks)), "node long, c0 long, c1 long, bucket long")
    families = components(matched(rows, CHECKS, 64 * CHECKS // 4, hot).union(exact))
    families = stage(families)
    sizes = families.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / members).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.least(i, mine).alias("i"), F.greatest(i, mine).alias("j")))
    placed = families.join(sizes, "root").select("node", "root", F.explode(pairs).alias("pair"))
    texts = own.join(families.select(F.col("node").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("node"), "text")
    sets = stage(set_hashes(texts, shingle))
    ship(docs.sparkSession)
    edges = placed.join(sets, "node").groupBy("root", "pair").applyInPandas(jaccard_links(similarity), "a long, b long")
    reach = components(edges).withColumnRenamed("node", "of")
    named = nodes.select("print", "node").join(reach.hint("merge"), F.col("node") == F.col("of"), "left").select("print", F.coalesce("root", "node").alias("component_id"))
    return prints.select("doc_id", "print").join(named, "print").select("doc_id", "component_id")
