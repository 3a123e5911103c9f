"""Token ids in a content-addressed store.

Texts become ids; a rolling hash over the ids cuts each document's stream into
chunks; each distinct chunk is stored once; a recipe per document lists its
chunks, and a Merkle root over them lets a reader verify what it puts together.

Files below the store's folder (Parquet, so any reader of the cluster's file
system opens them):

* ``rows/kind=chunk``  digest binary(16), n int, ids binary: the ids as little-endian
  unsigned integers of ``width`` bytes.  Each digest once.
* ``recipes``  doc_id, copy, n_tokens, root binary(32), chunks binary (the digests
  one after another), in ascending doc_id order: part files cover ranges of doc_id
  that do not overlap, and rows ascend inside each.
* ``manifest`` one row: documents, tokens, width, root (Merkle root over the recipe
  files' roots, each a hash tree over the file's recipes in order).

Tokenizing happens once.  One shuffle by digest carries chunks (each at most once
per task) and recipes together; only recipes, some 3 % of the ids, move again for
their order.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import map_arrow
from .tokens import slices

END_ID = 2
#: Ids that the rolling hash sees, the mean chunk, and the largest.
SPAN, MEAN, MOST = 16, 512, 4096
DIGEST = 16
#: Children of a node in the hash tree over a part file's recipes, and levels above the leaves: FAN**LEVELS recipes a part.
FAN, LEVELS = 1024, 3
#: Characters that a regular expression's \s may take for white space.
BLANK = r"[\x00-\x20\x85\xa0\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """How many bytes each id stands for: a byte-level vocabulary writes one character for each."""
    vocab = load_tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    out[list(vocab.values())] = [len(token) for token in vocab]
    return out


def laid_out(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of large strings without nulls, one after another, and their bounds."""
    bounds = np.frombuffer(values.buffers()[1] or bytes(8), np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] numbers), and so on for the others."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(n.sum())


def _bytes(*spans: tuple[str, str]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[ord(a) : ord(b) + 1] = True
    return out


LETTER, MARK, PRINTED = _bytes(("A", "Z"), ("a", "z")), _bytes(("!", "/"), (":", "@"), ("[", "`"), ("{", "~")), _bytes(("!", "~"))


def parted(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts of large strings without nulls, one string's after another's, and how many each has.

    Cuts stand where the tokenizer's expression ends a match whatever stands around:
    between a letter and an ASCII mark or line end after it, and between such a mark
    (not ', which may begin a contraction) or a line end without white space before
    it and a letter.  Letters are those up to U+024F, which no version of Unicode
    sees otherwise; others stay with what stands beside them.
    """
    data, bounds = laid_out(values)
    plain, mark, line = LETTER[data], MARK[data], data == 10
    lead, trail = data[:-1], data[1:]
    wide = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((trail == 0x97) | (trail == 0xB7))) & ~((lead == 0xC9) & (trail > 0x8F))  # but the signs for times and divided
    begins, ends = plain.copy(), plain.copy()
    begins[:-1] |= wide
    ends[1:] |= wide
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[1:-1] = ends[:-1] & (mark | line)[1:] | (mark & (data != 39))[:-1] & begins[1:]
        cut[2:-1] |= PRINTED[data[:-2]] & line[1:-1] & begins[2:]
    cut[bounds] = True
    at = np.flatnonzero(cut)
    counts = np.searchsorted(at, bounds[1:]) - np.searchsorted(at, bounds[:-1])
    if not counts.all():  # an empty string is one part
        at = np.sort(np.concatenate([at, bounds[1:][counts == 0]]))
        counts = np.maximum(counts, 1)
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]), counts


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer that splits before each single space.

    Such a tokenizer never joins what stands before ' x' with it (x and the
    character before the space not being white space), so a text is the sequence
    of its pieces, and a piece has the same ids wherever it stands; so have its
    parts, the word and the marks beside it.  The distinct parts that are not
    known yet are encoded together, as one long text, and told apart by the bytes
    of their ids.  Texts where white space meets a space are encoded whole.
    """

    def __init__(self, path: str, most: int = 3 << 18, together: int = 1024) -> None:
        """most: parts kept with their ids from batch to batch, some 200 bytes each; then those are forgotten that few batches had."""
        self.tokenizer, self.bytes, self.most, self.together = load_tokenizer(path), token_bytes(path), most, together
        self.known: dict[str, int] = {}
        self.pool, self.begin, self.n, self.hits = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def forget(self) -> None:
        """Keeps the half of the allowed parts that most batches had, of those that two had at least."""
        kept = np.sort(np.argsort(-self.hits, kind="stable")[: self.most // 2])
        kept = kept[self.hits[kept] > 1]
        n = self.n[kept]
        self.pool = self.pool[ranges(self.begin[kept], n)]
        names = np.array(list(self.known), object)[kept].tolist()
        self.known, self.begin, self.n, self.hits = dict(zip(names, range(len(names)), strict=True)), np.cumsum(n) - n, n, self.hits[kept] // 2

    def each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for i in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]

    def pieces(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each of these pieces begins and how many it has."""
        parts, counts = parted(values)
        coded = parts.dictionary_encode()
        at = self.parts(coded.dictionary)[coded.indices.to_numpy()]
        each, upto = self.n[at], np.cumsum(counts)
        ends = np.concatenate([[0], np.cumsum(each)])
        begin = ends[upto - counts]
        return self.pool[ranges(self.begin[at], each)], begin, ends[upto] - begin

    def parts(self, values: pa.Array) -> np.ndarray:
        """Where among the known parts each of these distinct ones stands; new ones are encoded and added."""
        if len(self.known) + len(values) > self.most:
            self.forget()
        names = values.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            pool, begin, n = self.encoded(values.take(pa.array(new)))
            self.begin = np.concatenate([self.begin, begin + len(self.pool)])
            self.pool, self.n, self.hits = np.concatenate([self.pool, pool]), np.concatenate([self.n, n]), np.concatenate([self.hits, np.zeros(len(new), np.int32)])
            self.known.update(zip(names[new].tolist(), at[new].tolist(), strict=True))
        self.hits[at] += 1
        return at

    def encoded(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each distinct part begins and how many it has."""
        alone = pc.or_(pc.invert(pc.starts_with(values, " ")), pc.match_substring_regex(values, f"{BLANK}$")).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(values).to_numpy().astype(np.int64)
        joined, single = np.flatnonzero(~alone), np.flatnonzero(alone)
        groups = [joined[i : i + self.together] for i in range(0, len(joined), self.together)]
        data, bounds = laid_out(values.take(pa.array(joined)))
        long = [data[bounds[i] : bounds[min(i + self.together, len(joined))]].tobytes().decode() for i in range(0, len(joined), self.together)]
        found = self.each(long) + self.each(values.take(pa.array(single)).to_pylist())
        n = np.zeros(len(values), np.int64)
        for at, ids in zip(groups, found, strict=False):
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes[at])) + 1
            n[at] = np.diff(np.concatenate([[0], ends]))
        n[single] = [len(x) for x in found[len(groups) :]]
        order = np.concatenate([joined, single])
        begin = np.zeros(len(values), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), begin, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each has."""
        distinct = pc.fill_null(texts.cast(pa.large_string()), "").dictionary_encode()
        whole = distinct.dictionary
        odd = pc.match_substring_regex(whole, rf"(^|{BLANK}) | ({BLANK}|$)").to_numpy(zero_copy_only=False)
        each: list[np.ndarray] = [None] * len(whole)
        at = np.flatnonzero(odd)
        for i, e in zip(at, self.each([whole[i].as_py() for i in at]), strict=True):
            each[i] = e
        plain = np.flatnonzero(~odd)
        if len(plain):
            parts = pc.split_pattern(whole.take(pa.array(plain)), " ")
            lengths = np.diff(parts.offsets.to_numpy())
            flat = parts.flatten()
            first = np.zeros(len(flat), dtype=bool)
            first[np.cumsum(lengths) - lengths] = True
            coded = pc.binary_join_element_wise(pc.if_else(pa.array(first), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), flat, pa.scalar("", pa.large_string())).dictionary_encode()
            index = coded.indices.to_numpy()
            pool, begin, n = self.pieces(coded.dictionary)
            out = pool[ranges(begin[index], n[index])]
            bounds = np.concatenate([[0], np.cumsum(n[index])])[np.concatenate([[0], np.cumsum(lengths)])]
            for k, i in enumerate(plain):
                each[i] = out[bounds[k] : bounds[k + 1]]
        chosen = [each[i] for i in distinct.indices.to_numpy()]
        return np.concatenate([*chosen, np.zeros(0, np.uint32)]), np.array([len(x) for x in chosen], dtype=np.int64)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker, whose known parts serve task after task."""
    return Encoder(path)


def cuts(ids: np.ndarray, ends: np.ndarray, span: int = SPAN, mean: int = MEAN, most: int = MOST) -> np.ndarray:
    """Ends of chunks (exclusive positions), every one of ``ends`` (ends of documents) among them.

    A chunk ends where the hash of the last ``span`` ids is divisible by ``mean``,
    so equal passages are cut alike wherever they stand, and after ``most`` ids.
    """
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    hashed = np.zeros(len(ids), np.uint64)
    if len(ids) >= span:
        rolled = (total[span:] - total[:-span]) * MIX
        hashed[span - 1 :] = rolled >> np.uint64(33)
    marks = np.flatnonzero(hashed % np.uint64(mean) == 1) + 1
    starts = ends - np.diff(np.concatenate([[0], ends]))
    doc = np.searchsorted(ends, marks - 1, side="right")
    marks = marks[marks - starts[doc] >= span]  # the hash looked at this document's ids only
    bounds = np.union1d(marks, ends[np.diff(np.concatenate([[0], ends])) > 0])
    gaps = np.diff(np.concatenate([[0], bounds]))
    if len(gaps) and gaps.max() > most:
        more = [np.arange(b - g + most, b, most) for b, g in zip(bounds, gaps, strict=True) if g > most]
        bounds = np.union1d(bounds, np.concatenate(more))
    return bounds


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves: an odd one moves up; no leaf: 32 zero bytes."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=32).digest() for x in leaves]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=32).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0] if level else bytes(32)


ROW = pa.schema([("kind", pa.string()), ("digest", pa.binary()), ("n", pa.int32()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])
ROW_DDL = "kind string, digest binary, n int, ids binary, doc_id long, n_tokens long, root binary"


def chunked(path: str, end_id: int, width: int, batch_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text) to rows of chunks (each digest once per task) and recipes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(path), set()
        for batch in slices(batches, "text", batch_bytes):
            yield from encoded(encoder, seen, batch)

    def encoded(encoder: Encoder, seen: set, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, counts = encoder.encode(batch.column("text"))
        ends = np.cumsum(counts + 1)
        ids = np.full(int(ends[-1]), end_id, dtype=np.uint32)
        keep = np.ones(len(ids), bool)
        keep[ends - 1] = False
        ids[keep] = raw
        if int(ids.max()) >> (8 * width):
            raise ValueError(f"id {int(ids.max())} does not fit into {width} bytes")
        data = ids.astype(f"<u{width}").tobytes()
        bounds = cuts(ids, ends)
        digests, fresh = [], {k: [] for k in ("kind", "digest", "n", "ids")}
        begin = 0
        for end in bounds.tolist():
            chunk = data[begin * width : end * width]
            digests.append(digest(chunk))
            if digests[-1] not in seen:
                seen.add(digests[-1])
                for k, v in zip(fresh, ("chunk", digests[-1], end - begin, chunk), strict=True):
                    fresh[k].append(v)
            begin = end
        n = len(fresh["kind"])
        yield pa.RecordBatch.from_arrays([pa.array(fresh["kind"], pa.string()), pa.array(fresh["digest"], pa.binary()), pa.array(fresh["n"], pa.int32()), pa.array(fresh["ids"], pa.binary()), *(pa.nulls(n, ROW.field(k).type) for k in ("doc_id", "n_tokens", "root"))], schema=ROW)
        upto = np.searchsorted(bounds, ends, side="right")
        lists = [digests[a:b] for a, b in zip(np.concatenate([[0], upto[:-1]]).tolist(), upto.tolist(), strict=True)]
        n = len(lists)
        yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * n), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array([b"".join(x) for x in lists], pa.binary()), batch.column("doc_id"), pa.array(counts + 1), pa.array([merkle(x) for x in lists], pa.binary())], schema=ROW)

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, width: int = 2, batch_bytes: int = 4 << 20) -> None:
    """Writes the store of docs (doc_id, text; other columns are ignored) into ``folder``.

    A null or empty text is the end id alone.  ``width`` bytes hold an id (2 for
    vocabularies up to 65,536, else 4).  Rows with a null doc_id are left out; rows
    that repeat a doc_id are documents of their own, numbered by ``copy`` from 1.
    An empty table gives a store without documents.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    rows = map_arrow(own, chunked(tokenizer, end_id, width, batch_bytes), ROW_DDL)
    key = F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("doc_id"))  # a hash of null is a number, not null
    parts = rows.repartition(F.pmod(key, F.lit(1 << 30)))
    copy = F.row_number().over(Window.partitionBy(F.pmod(key, F.lit(1 << 30)), "digest", "doc_id").orderBy("root"))
    once = parts.withColumn("copy", copy).where("copy = 1 or kind = 'recipe'")
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/rows")
    saved = spark.read.schema(f"{ROW_DDL}, copy int").parquet(f"{folder}/rows")
    recipes = saved.where("kind = 'recipe'").select("doc_id", "copy", "n_tokens", "root", F.col("ids").alias("chunks")).repartitionByRange("doc_id", "copy").sortWithinPartitions("doc_id", "copy")
    recipes = recipes.withColumn("part", F.spark_partition_id())
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    documents, tokens, root = manifest_of(recipe_parts(spark, folder))
    spark.createDataFrame([(documents, tokens, width, root)], "documents long, tokens long, width int, root binary").coalesce(1).write.parquet(f"{folder}/manifest")


def recipe_parts(spark: SparkSession, folder: str) -> DataFrame:
    """part, documents, tokens, before (tokens of the parts before it), root: the part's hash tree over its recipes in doc_id order.

    A leaf is a recipe's doc_id, copy, n_tokens and root; up to FAN nodes of a level
    that stand together make one of the next, so no task gathers a whole part.
    """
    rows = spark.read.parquet(f"{folder}/recipes")
    leaf = F.sha2(F.concat_ws("|", F.lit("leaf"), "doc_id", "copy", "n_tokens", F.hex("root")), 256)
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "copy")) - 1
    level = rows.select("part", place.cast("long").alias("place"), leaf.alias("hash"), F.lit(1).cast("long").alias("documents"), "n_tokens")
    for depth in range(LEVELS):
        above = F.lit(0).cast("long") if depth == LEVELS - 1 else F.floor(F.col("place") / FAN)
        nodes = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
        level = (
            level.groupBy("part", above.alias("place"))
            .agg(F.sha2(F.concat_ws("|", F.lit(f"level {depth}"), nodes), 256).alias("hash"), F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens"))
        )
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return level.select("part", "documents", F.col("n_tokens").alias("tokens"), F.unhex("hash").alias("root"), before.alias("before")).orderBy("part")


def manifest_of(parts: DataFrame) -> tuple[int, int, bytes]:
    """Documents, tokens and the Merkle root over the roots of the part files, of which each is a row here."""
    rows = parts.collect()
    return sum(r.documents for r in rows), sum(r.tokens for r in rows), merkle([bytes(r.root) for r in rows])


def check_manifest(spark: SparkSession, folder: str, width: int) -> None:
    """Raises unless the recipes as stored give the manifest's documents, tokens and root."""
    said = spark.read.parquet(f"{folder}/manifest").first()
    if (said.documents, said.tokens, bytes(said.root)) != manifest_of(recipe_parts(spark, folder)) or said.width != width:
        raise ValueError("the recipes do not match the manifest")


def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes as they are, each root held against the digests listed."""
    for batch in batches:
        for root, chunks in zip(batch.column("root").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
            if merkle([chunks[i : i + DIGEST] for i in range(0, len(chunks), DIGEST)]) != root:
                raise ValueError("a recipe does not match its Merkle root")
        yield batch


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, copy, start (ids of all documents before it), n_tokens, root, chunks (digests one after another)."""
    before = recipe_parts(spark, folder).select("part", "before")
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spark.read.parquet(f"{folder}/recipes").withColumn("inside", inside).join(before, "part").select("doc_id", "copy", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "root", "chunks")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROW_DDL).parquet(f"{folder}/rows").where("kind = 'chunk'").select("digest", "n", "ids")


def _crc_tables() -> np.ndarray:
    """Matrix k (as 32 columns) carries a crc32 over 2**k zero bytes."""
    out = np.zeros((48, 32), np.uint32)
    row = np.array([0xEDB88320] + [1 << i for i in range(31)], np.uint32)
    times = lambda m, v: np.bitwise_xor.reduce(np.where((v[:, None] >> np.arange(32, dtype=np.uint32)) & 1, m, 0).astype(np.uint32), axis=1)
    for _ in range(3):  # one bit to eight
        row = times(row, row)
    for k in range(48):
        out[k] = row
        row = times(row, row)
    return out


CRC = _crc_tables()


def crc_shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each crc32 carried over as many zero bytes as ``lengths`` says: what a later part's crc is xor-ed with."""
    out = crcs.astype(np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> k) & 1)
        bits = (out[at, None] >> np.arange(32, dtype=np.uint32)) & 1
        out[at] = np.bitwise_xor.reduce(np.where(bits, CRC[k], 0).astype(np.uint32), axis=1)
    return out


def digests_of(width: int):
    """Chunks as stored to their digest anew, size, and crc32 as 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"digest": [], "n": [], "crc": []}
            for d, n, data in zip(batch.column("digest").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if digest(data) != d or len(data) != n * width:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
                ids = np.frombuffer(data, f"<u{width}")
                out["digest"].append(d)
                out["n"].append(n)
                out["crc"].append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("digest", pa.binary()), ("n", pa.int32()), ("crc", pa.int64())]))

    return run


def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, crc, after (bytes that follow): the chunk's share of its document's crc32."""
    for batch in batches:
        crc, after = batch.column("crc").to_numpy(), batch.column("after").to_numpy()
        share = np.concatenate([crc_shift(crc[i : i + 65_536], after[i : i + 65_536]) for i in range(0, len(crc), 65_536)]) if len(crc) else crc
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(share.astype(np.int64)), batch.column("n"), batch.column("copy")], names=["doc_id", "share", "n", "copy"])


def _chunk_refs(recipes: DataFrame) -> DataFrame:
    """doc_id, seq, digest for each chunk of each recipe."""
    count = (F.length("chunks") / DIGEST).cast("int")
    one: Callable[[Column], Column] = lambda i: F.substring(F.col("chunks"), i * DIGEST + 1, F.lit(DIGEST))
    listed = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one))
    return recipes.select("doc_id", "copy", F.posexplode(listed).alias("seq", "digest"))


def verify(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32, copy.

    ids_crc32 is the unsigned crc32 of the document's ids as little-endian 32-bit
    integers.  Each stored chunk is read once, held against its digest, and its
    crc32 taken; a document's crc32 is the sum (xor) of its chunks' crc32, each
    carried over the bytes behind it, so no ids move.  What raises: a chunk that does
    not match its digest, a missing chunk, a count that differs from the recipe, a
    recipe whose digests do not give its Merkle root, and recipes that do not give
    the manifest.
    """
    check_manifest(spark, folder, width)
    recipes = read_recipes(spark, folder)
    known_roots = map_arrow(recipes.select("doc_id", "copy", "root", "chunks"), rooted, "doc_id long, copy int, root binary, chunks binary")
    known = map_arrow(read_chunks(spark, folder), digests_of(width), "digest binary, n int, crc long")
    refs = _chunk_refs(known_roots).join(known, "digest", "left")
    behind = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id", "copy").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 4
    shares = refs.select("doc_id", F.coalesce("crc", F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("crc"), "n", behind.cast("long").alias("after"), "copy")
    summed = map_arrow(shares, shifted, "doc_id long, share long, n int, copy int").groupBy("doc_id", "copy").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("n").alias("found"))
    checked = F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document's chunks do not add up")).cast("long"))
    return recipes.select("doc_id", "copy", "start", "n_tokens").join(summed, ["doc_id", "copy"], "left").select("doc_id", "start", "n_tokens", checked.alias("ids_crc32"), "copy")


def read_ids(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """doc_id and ids (array<int>): documents put together from their chunks, Merkle roots and manifest verified."""
    check_manifest(spark, folder, width)
    recipes = read_recipes(spark, folder)
    refs = _chunk_refs(recipes).join(read_chunks(spark, folder), "digest", "left")
    whole = refs.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "ids"))).alias("parts"))
    joined = recipes.join(whole, ["doc_id", "copy"]).select("doc_id", "root", "n_tokens", F.col("parts.digest").alias("digests"), F.col("parts.ids").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root, n, digests, data in zip(*(batch.column(k).to_pylist() for k in ("root", "n_tokens", "digests", "data")), strict=True):
                if merkle(digests) != root or any(digest(x) != d for x, d in zip(data, digests, strict=True)):
                    raise ValueError("a document does not match its Merkle root")
                out.append(np.frombuffer(b"".join(data), f"<u{width}").astype(np.int32))
                if len(out[-1]) != n:
                    raise ValueError("a document's ids do not add up")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(joined, run, "doc_id long, ids array<int>")
