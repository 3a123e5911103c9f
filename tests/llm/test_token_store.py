"""Token store: encoder against the library, chunks, round trip, damage."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tensorloom.llm import token_store as ts
from tensorloom.llm._common import shared_dir

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", " lead", "trail ", "tab\t x", "x \n y", "it's we'll", "nbsp  x", "é ​ x", "<|endoftext|> as text", "end\n", "日本 語", "\x00 \x01", None, "", " ", "x" * 5000, "w " * 9000]


def want(t):
    return [*ts.load_tokenizer(PATH).encode(t or "", add_special_tokens=False).ids, ts.END_ID]


def test_encoder(documents):
    texts = [r.text for r in documents.collect()] + ODD + ODD
    for most in (1 << 18, 50):
        ids, n = ts.Encoder(PATH, most=most, together=7).encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(n)[:-1])
        assert all([*p.tolist(), ts.END_ID] == want(t) for p, t in zip(parts, texts, strict=True))


def test_parts():
    """Words, line ends, contractions, digits and characters that may or may not be letters, in any order."""
    rng = np.random.default_rng(2)
    some = [*"aZéÀɏŉ×÷ªɐ7٣'’.,-_~|!<$", "'s", "'re", "\n", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", " ", "\u0301", "\u200b", "本", "🙂", "\x00"]
    texts = ["".join(rng.choice(some, rng.integers(0, 12))) for _ in range(3000)]
    values = pa.array(texts, pa.large_string())
    parts, counts = ts.parted(values.slice(7))
    assert ["".join(p) for p in np.split(np.array(parts.to_pylist(), object), np.cumsum(counts)[:-1])] == texts[7:]
    assert ts.parted(pa.array([" day.\nDon't", "", " x1,!Ü", "\n\nA"], pa.large_string()))[0].to_pylist() == [" day", ".\n", "Don", "'t", "", " x1,!", "Ü", "\n\nA"]
    for most in (1 << 18, 90):
        ids, n = ts.Encoder(PATH, most=most, together=7).encode(values)
        assert all([*p.tolist(), ts.END_ID] == want(t) for p, t in zip(np.split(ids, np.cumsum(n)[:-1]), texts, strict=True))


def test_words_once():
    """A word is encoded once, whatever marks stand beside it."""
    encoder, given = ts.Encoder(PATH), []
    each = encoder.each
    encoder.each = lambda texts: given.extend(texts) or each(texts)
    words = ["w" + "".join(c) for c in np.random.default_rng(3).choice(list("abcdeé"), (200, 9))]
    for marks in (".", ",", "!!", ".\nOnce", " --"):
        text = "".join(f" {w}{marks}" for w in words)[1:]
        ids, _ = encoder.encode(pa.array([text]))
        assert [*ids.tolist(), ts.END_ID] == want(text)
    assert sum(map(len, given)) < 1.1 * sum(len(w) + 1 for w in words)


def test_cuts():
    rng = np.random.default_rng(0)
    same = rng.integers(0, 50_000, 6000)
    streams = [np.concatenate([rng.integers(0, 50_000, k), same, rng.integers(0, 50_000, 50)]).astype(np.uint32) for k in (0, 10, 777)]
    chunks = []
    for s in streams:
        bounds = ts.cuts(s, np.array([len(s)]))
        assert bounds[-1] == len(s) and np.diff(np.concatenate([[0], bounds])).max() <= ts.MOST
        chunks.append({s[a:b].tobytes() for a, b in zip([0, *bounds], bounds, strict=False)})
    assert len(chunks[0] & chunks[1] & chunks[2]) >= 5


def test_crc():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (3, 0, 1000, 77)]
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(4)])
    assert np.bitwise_xor.reduce(ts.crc_shift(np.array([zlib.crc32(p) for p in parts]), after)) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("which", ["documents", "nasty"])
def test_round_trip(spark, which, request):
    df = request.getfixturevalue(which)
    if which == "nasty":
        df = df.unionByName(df.where("doc_id in (3, 45)"))
        df = df.unionByName(spark.createDataFrame(list(enumerate(ODD, 1000)), "doc_id long, text string"), allowMissingColumns=True)
    folder = shared_dir(spark)
    ts.write_store(df, folder, PATH, batch_bytes=30_000)
    rows = sorted(ts.verify(spark, folder).collect(), key=lambda r: (r.doc_id, r["copy"]))
    start = 0
    docs = sorted(((r.doc_id, r.text) for r in df.collect() if r.doc_id is not None), key=lambda r: r[0])
    for (d, t), r in zip(docs, rows, strict=True):
        ids = want(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    back = {r.doc_id: r.ids for r in ts.read_ids(spark, folder).collect()}
    assert all(back[d] == want(t) for d, t in docs)
    chunks = ts.read_chunks(spark, folder)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert spark.read.parquet(f"{folder}/manifest").first().documents == len(docs)


def test_damage(spark, documents):
    folder = shared_dir(spark)
    ts.write_store(documents.limit(20), folder, PATH)
    kept = ts.read_chunks(spark, folder).collect()
    lost = spark.createDataFrame([(bytes(c.digest), c.n, bytes(c.ids)) for c in kept[1:]], "digest binary, n int, ids binary")
    lost.selectExpr("digest", "n", "ids", "cast(null as long) doc_id", "cast(null as long) n_tokens", "cast(null as binary) root", "1 copy").write.mode("overwrite").parquet(f"{folder}/rows/kind=chunk")
    with pytest.raises(Exception, match="missing"):
        ts.verify(spark, folder).collect()


def rewritten(spark, folder, table, change):
    """The store's table with its rows changed, in the same files' place."""
    kept = spark.read.parquet(f"{folder}/{table}")
    rows, schema = [r.asDict() for r in kept.collect()], kept.schema
    change(rows)
    spark.createDataFrame([tuple(r[f] for f in schema.names) for r in rows], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}")


def swapped(rows):
    row = max(rows, key=lambda r: len(r["chunks"]))
    c, n = bytes(row["chunks"]), ts.DIGEST
    assert len(c) >= 2 * n and c[:n] != c[n : 2 * n]
    row["chunks"] = bytearray(c[n : 2 * n] + c[:n] + c[2 * n :])


def new_root(rows):
    rows[0]["root"] = bytearray(32)


def exchanged(rows):
    """Two documents take each other's text: every recipe is sound by itself."""
    a, b = rows[:2]
    for k in ("root", "chunks", "n_tokens"):
        a[k], b[k] = b[k], a[k]


@pytest.mark.parametrize(("table", "change", "says"), [("recipes", swapped, "Merkle root"), ("recipes", new_root, "manifest"), ("recipes", exchanged, "manifest"), ("manifest", new_root, "manifest")])
def test_tampered(spark, documents, table, change, says):
    folder = shared_dir(spark)
    ts.write_store(documents.limit(20), folder, PATH)
    rewritten(spark, folder, table, change)
    for read in (ts.verify, ts.read_ids):
        with pytest.raises(Exception, match=says):
            read(spark, folder).collect()


def test_narrow_ids(spark):
    df = spark.createDataFrame([(1, "a text with many different words")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        ts.write_store(df, shared_dir(spark), PATH, width=1)


def test_empty(spark, nothing):
    folder = shared_dir(spark)
    ts.write_store(nothing, folder, PATH)
    assert ts.verify(spark, folder).count() == 0
