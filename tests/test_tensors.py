"""Functions over all words, statistics against figures that are known, and DuckDB's answers to the registered queries."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tensorloom.functions import bits, classify
from tensorloom.operators import codecs, reductions, runs, statistics
from tensorloom.plans import queries
from tensorloom.sources import safetensors, tables
from tensorloom.streaming import histogram

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
#: idx + pal + esc bits of the embeddings of sf0.01, for tiles of 32, 64, 128.
KNOWN = {
    ("bump", "actual"): (152176, 137280, 242496),
    ("escape", "actual"): (143112, 126776, 200904),
    ("verbatim", "actual"): (256000, 256000, 512000),
    ("best", "actual"): (142992, 126624, 200856),
    ("best", "p16"): (224336, 162696, 250176),
    ("unary", "actual"): (134630, 115322, 147322),
    "rank_fixed": (106304, 113856, 227712),
    "rank_best": (99408, 100664, 186856),
    "rank_unary": (85094, 85750, 117750),
    "rank_rice": (81246, 82650, 117750),
}


def test_all_words(spark):
    w = spark.range(65536).select(F.col("id").cast("int").alias("w"))
    x = F.col("w")
    got = w.select("w", bits.join(bits.raw(x), bits.exponent(x)).alias("j"), bits.value(x).alias("v"), *[bits.round_mantissa(x, m).alias(f"m{m}") for m in range(1, 8)]).toPandas().set_index("w").sort_index()
    words = np.arange(65536)
    assert (got.j == words).all()
    exact = (words.astype(np.uint32) << 16).view(np.float32).astype(np.float64)
    assert np.array_equal(got.v.to_numpy(), exact, equal_nan=True)
    e, mant = (words >> 7) & 255, words & 127
    for m in range(1, 8):
        s = 7 - m
        q = np.minimum(np.rint(mant / (1 << s)).astype(int), (1 << m) - 1)
        assert (got[f"m{m}"] == np.where(e == 255, words, (words & 0xFF80) | q << s)).all()
    with pytest.raises(ValueError):
        bits.round_mantissa(x, 8)


def test_small_functions(spark):
    row = spark.range(1).select(
        *[bits.bit_length(F.lit(i)).alias(f"b{i}") for i in (0, 1, 255)],
        *[bits.plain_width(F.lit(k)).alias(f"p{k}") for k in (1, 2, 3, 16, 17)],
        bits.partitions(F.lit(704), 3).alias("parts"),
        bits.tiles_per_row(F.lit(704), 128).alias("tiles"),
        bits.tensor_seed(3, F.lit("a.weight")).alias("seed"),
    ).first()
    import zlib

    assert [row[f"b{i}"] for i in (0, 1, 255)] == [0, 1, 8] and [row[f"p{k}"] for k in (1, 2, 3, 16, 17)] == [0, 1, 2, 4, 99]
    assert list(row.parts) == [0, 256, 512, 704] and row.tiles == 6 and row.seed == (3 * 1_000_003 + zlib.crc32(b"a.weight")) % 2**31


@pytest.mark.parametrize(("i", "t"), list(enumerate((32, 64, 128))))
def test_known_costs(spark, i, t):
    for r in queries.QUERIES[f"palette_policies_t{t}"](spark, SF).where("name = 'embeddings'").collect():
        if (r.policy, r.objective) in KNOWN:
            assert r.idx + r.pal + r.esc == KNOWN[r.policy, r.objective][i], r
        assert r.ntiles == (1000, 500, 500)[i]
    for r in queries.QUERIES[f"rank_policies_t{t}"](spark, SF).where("name = 'embeddings'").collect():
        assert r.bits == KNOWN[r.policy][i], r


def test_known_figures(spark):
    one = lambda name, where="name = 'embeddings'": queries.QUERIES[name](spark, SF).where(where).first()
    e, m, b = one("entropy"), one("mutual_info"), one("baseline_codes")
    assert (e.distinct_ex, round(e.entropy, 6), e.entropy_mm) == (17, 2.538246, 2.538606562)
    assert (m.h_given_row, m.h_given_col) == (2.5106088, 2.5341297)
    assert (b.tensor_palette_bits, b.window7_bits, b.palette16_bits, b.weights_in_segments) == (160136, 108752, 128884, 31936)
    assert one("huffman_bits").huffman_bits == 82545
    assert [one("pack_totals", f"name = 'embeddings' and form = '{f}'").bits for f in ("v1", "v2")] == [448904, 369952]
    assert one("r4_escapes").escapes == 2
    ranks = [r.ex for r in queries.QUERIES["rank_table"](spark, SF).where("name = 'embeddings' and rk < 6").orderBy("rk").collect()]
    assert ranks == [123, 124, 122, 121, 120, 125]


def test_huffman_by_hand():
    n = np.array([8, 4, 2, 2, 0])
    assert sorted(statistics.huffman_lengths(n)) == [0, 1, 2, 3, 3] and (n * statistics.huffman_lengths(n)).sum() == 28
    assert statistics.huffman_lengths(np.array([0, 9])).tolist() == [0, 1]


def test_entropy_by_hand(spark):
    hist = spark.createDataFrame([("a", i, 1000) for i in range(4)], "name string, ex int, n long")
    assert math.isclose(statistics.entropy(hist).first().h_mm, 2 + 3 / (2 * 4000 * math.log(2)))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a, b = queries.QUERIES[name](spark, SMALL).toPandas(), c.sql(queries.ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted(map(repr, d[sorted(a.columns)].astype(object).where(d[sorted(a.columns)].notna(), None).values.tolist()))
    same = lambda x: [r.replace(".0,", ",").replace(".0]", "]") for r in x]
    assert same(rows(a)) == same(rows(b))


L = "model.language_model.layers.0."
# Names, shapes and the classes that they have.
CASES = [
    (L + "self_attn.q_proj.weight", (4096, 3840), "linear", "attn"),
    (L + "mlp.down_proj.weight", (3840, 15360), "linear", "mlp"),
    (L + "experts.gate_up_proj", (128, 1408, 2816), "linear", "experts"),
    (L + "per_layer_input_gate.weight", (256, 2560), "linear", "ple_proj"),
    (L + "router.proj.weight", (128, 2816), "other", "other"),
    (L + "input_layernorm.weight", (3840,), "other", "norm"),
    ("model.language_model.embed_tokens.weight", (262144, 3840), "embed", "embed_tokens"),
    ("model.language_model.embed_tokens_per_layer.weight", (262144, 10752), "ple", "ple"),
    ("model.embed_vision.embedding_projection.weight", (3840, 3840), "mm", "mm"),
    ("model.language_model.layers.3.linear_attn.out_proj.weight", (4096, 4096), "linear", "linattn"),
]


def test_classes(spark):
    df = spark.createDataFrame([(n, list(s)) for n, s, _, _ in CASES], "name string, shape array<bigint>")
    k = classify.classify(F.col("name"), F.col("shape"), F.lit("BF16"))
    got = {r.name: (r.k.cls, r.k.sub) for r in df.select("name", k.alias("k")).collect()}
    assert got == {n: (c, s) for n, _, c, s in CASES}
    packed = df.select("name", classify.packable(k["cls"], F.col("shape"), F.lit("BF16")).alias("p")).collect()
    assert {r.name: r.p for r in packed} == {n: c in classify.PACKED_CLASSES for n, _, c, _ in CASES}


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("form", ["v1", "v2", "r4"])
def test_rows_round_trip(spark, form, parts):
    rows = tables.tensor_rows(spark, SMALL).select("name", "r", "w").where("name = 'embeddings' or size(w) % 4 = 0").repartition(parts)
    back = codecs.unpack(codecs.pack(rows, form), codecs.histograms(rows), form)
    for r in statistics.differences(rows, back).collect():
        assert (r.mismatches, r.missing, r.extra) == (0, 0, 0) and r.numel
    broken = back.withColumn("w", F.when(F.col("r") == 3, F.slice("w", 1, 2)).otherwise(F.transform("w", lambda w: w + F.when(F.col("r") == 5, 1).otherwise(0))))
    assert any(r.mismatches and r.missing for r in statistics.differences(rows, broken).collect())


def test_order_of_additions():
    words = lambda x: bits.round_words(np.array(x, np.float32))
    big = [2.0**25] + [1.0] * 31 + [-(2.0**25)] + [0.0] * 95
    assert reductions.lane_dot(words(big), words([1.0] * 128)) == np.float32(28.0)  # three ones are lost beside the large number, which the tree takes away
    one = [0.0] * 256
    one[0], one[1], one[2], one[128] = 2.0**25, 1.0, 1.0, -(2.0**25)
    assert reductions.lane_dot(words(one), words([1.0] * 256)) == 0
    assert reductions.lane_dot(words(one), words([1.0] * 256), sums=2) == 0
    one[1], one[2], one[129] = 0.0, 0.0, 1.0
    assert reductions.lane_dot(words(one), words([1.0] * 256)) == 1
    assert reductions.lane_dot(words(one), words([1.0] * 256), sums=2) == 0


def test_fold(spark):
    df = spark.createDataFrame([([2.0**25, 1.0, 1.0, -(2.0**25)],)], "x array<float>")
    assert df.select(reductions.fold(F.col("x"))).first()[0] == 0.0
    got = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>").select(reductions.argmax(F.col("x")).alias("a"), reductions.log_sum_exp(F.col("x")).alias("l")).first()
    assert got.a == 1 and math.isclose(got.l, math.log(math.e + 2 * math.e**3))


def test_lossy(spark):
    rng = np.random.default_rng(0)
    w = bits.round_words(np.concatenate([rng.normal(0, 0.02, 96), np.zeros(32)]).astype(np.float32))
    df = spark.createDataFrame([("a", "x", 0, i, int(v)) for i, v in enumerate(w)], "name string, cls string, r long, c int, w int")
    got = {r.t: r for r in statistics.lossy_tiles(df, 32, 3).collect()}
    value = lambda x: (x.astype(np.uint32) << 16).view(np.float32).astype(float)
    q = np.minimum(np.rint((w & 127) / 16).astype(int), 7)
    d = np.abs(value(w) - value((w & 0xFF80) | q << 4))
    for t in range(3):
        a, b = d[32 * t : 32 * t + 32], np.abs(value(w))[32 * t : 32 * t + 32]
        assert math.isclose(got[t].rel_fro, math.sqrt((a**2).sum() / (b**2).sum()), rel_tol=1e-9) and math.isclose(got[t].max_rel, (a / b).max(), rel_tol=1e-9)
    assert got[3].rel_fro is None and got[3].max_rel is None


def test_shuffle_keeps_rows(spark):
    w = tables.weights(spark, SMALL)
    s = statistics.shuffled_in_rows(w)
    same = lambda d: sorted((r.name, r.r, tuple(r.x)) for r in d.groupBy("name", "r").agg(F.array_sort(F.collect_list("w")).alias("x")).collect())
    assert same(w) == same(s) and w.exceptAll(s.select(w.columns)).count() > 0


def test_safetensors(spark, tmp_path):
    rows = tables.tensor_rows(spark, SMALL).where("name = 'embeddings'").select("name", "r", "w")
    more = rows.select(F.lit("b.weight").alias("name"), "r", "w").where("r < 7")
    n = rows.count()
    shapes = spark.createDataFrame([("embeddings", "one.safetensors", [n, 64]), ("b.weight", "two.safetensors", [7, 64])], "name string, file string, shape array<bigint>")
    out = str(tmp_path / "m")
    assert safetensors.write(rows.unionByName(more), shapes, out).count() == 2
    listed = safetensors.catalog(spark, out).collect()
    assert [(t.name, t.dtype, t.rows, t.k, t.nbytes) for t in listed] == [("embeddings", "BF16", n, 64, n * 128), ("b.weight", "BF16", 7, 64, 896)]
    back = safetensors.read(spark, out, chunk="6400")
    assert back.rdd.getNumPartitions() > 2 and back.exceptAll(rows.unionByName(more)).count() == 0 and back.count() == n + 7
    some = safetensors.read(spark, out, names="b.weight", rows="2:5").collect()
    assert sorted(r.r for r in some) == [2, 3, 4]
    header, _ = safetensors.read_header(os.path.join(out, "one.safetensors"))
    assert header["embeddings"]["data_offsets"] == [0, n * 128]
    pushed = safetensors.read(spark, out).where("name = 'b.weight' and r >= 2 and r < 5 and size(w) > 0")
    assert sorted(r.r for r in pushed.collect()) == [2, 3, 4] and pushed.rdd.getNumPartitions() == 1
    assert safetensors.read(spark, out).where("name in ('x') or r = 3").count() == 2
    entries = [("a", "U8", [3]), ("b", "U8", [0]), ("c", "BF16", [2])]
    assert safetensors.save(tmp_path / "x", entries, [("a", b"ab"), ("a", b"c"), ("c", b"defg")]) == (tmp_path / "x").stat().st_size
    assert (tmp_path / "x").read_bytes().endswith(b"abcdefg") and safetensors.read_header(tmp_path / "x")[0]["c"]["data_offsets"] == [3, 7]
    for data in ([("a", b"ab")], [("a", b"abcd")], [("a", b"abc")], [("c", b"defg")], [("a", b"abc"), ("d", b"")]):
        with pytest.raises(ValueError):
            safetensors.save(tmp_path / "y", entries, data)
    with pytest.raises(ValueError):
        safetensors.head([("a", "U8", [1]), ("a", "U8", [1])])
    with pytest.raises(FileNotFoundError):
        safetensors.shard_files(tmp_path / "none")


def test_runs(spark):
    pos = [("ref", 0, i, i, i % 3, -1.0) for i in range(10)] + [("x", 0, i, i + (i == 9), i % 3, -1.5) for i in range(10)]
    got = {r.variant: r for r in runs.compare_positions(spark.createDataFrame(pos, "variant string, win int, pos int, h long, am int, lp double"), "ref").collect()}
    assert (got["x"].same_hash, got["x"].same_argmax, got["x"].max_diff, round(got["ref"].perplexity, 6)) == (0.9, 1.0, 0.5, round(math.e, 6))
    toks = [("ref", 0, i, i) for i in range(5)] + [("x", 0, i, i + (i >= 3)) for i in range(5)]
    div = {r.variant: r.diverges for r in runs.first_divergence(spark.createDataFrame(toks, "variant string, prompt int, step int, id int"), "ref").collect()}
    assert div == {"ref": None, "x": 3}
    m = spark.createDataFrame([("a", "c1", 5), ("b", "c1", 6)], "name string, git string, bytes long")
    c = spark.createDataFrame([("a", "c1", 5, 0), ("b", "c2", 6, 0)], "name string, git string, bytes long, mismatches long")
    assert {r.name: r.ok for r in runs.publishable(m, c).collect()} == {"a": True, "b": False}


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = histogram.windowed_exponents(stream, late="400 days").writeStream.format("memory").queryName("exps").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    want = histogram.windowed_exponents(events)
    assert sorted(map(tuple, spark.table("exps").collect())) == sorted(map(tuple, want.collect()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
