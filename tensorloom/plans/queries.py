"""The registered queries over the tables that stand in for tensors, and DuckDB's SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, classify
from ..operators import codecs, reductions, runs, statistics, tiles
from ..sources import tables
from . import tensor_sql as sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
W = tables.weights_sql()
EXPS = f"WITH {W}, {sql.exps(sql.DUCKDB)}"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def given(spark: SparkSession, sf_dir: str, text: str, t: int, order: Callable | None = None) -> dict[str, DataFrame]:
    """The tables that a text asks for, made from row arrays."""
    rows = tables.tensor_rows(spark, sf_dir).select("name", "cls", "r", "w")
    out = {}
    if "{tiles}" in text:
        out["tiles"] = tiles.palette_tiles(rows, t, order)
    if "{rtiles}" in text or "{counts}" in text:
        out["counts"] = tiles.counts(rows)
    if "{rtiles}" in text:
        out["rtiles"] = tiles.rank_tiles(tiles.with_ranks(rows, out["counts"]), t, order)
    return {k: v for k, v in out.items() if f"{{{k}}}" in text}


def tile_query(name: str, text: Callable[[sql.Dialect], str], t: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text(sql.SPARK), **given(spark, sf_dir, text(sql.SPARK), t))

    QUERIES[name] = run
    ORACLE[name] = text(sql.DUCKDB).replace("{weights}", W + ", ")


@query(f"{EXPS} SELECT name, ex, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY name) AS DOUBLE), 9) AS share FROM exps GROUP BY name, ex")
def exp_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    hist = statistics.exp_hist(tables.weights(spark, sf_dir))
    return hist.select("name", F.col("ex").cast("long").alias("ex"), "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("name")), 9).alias("share"))


@query(f"{EXPS}, {sql.ranks(sql.DUCKDB)} SELECT name, ex, CAST(n AS BIGINT) AS n, rk FROM ranks")
def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = statistics.rank_table(statistics.exp_hist(tables.weights(spark, sf_dir)))
    return t.select("name", F.col("ex").cast("long").alias("ex"), "n", F.col("rk").cast("long").alias("rk"))


_ENTROPY = """SELECT name, {by} CAST(sum(n) AS BIGINT) AS n, count(*) AS m, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(n)) / sum(n) AS h, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(n)) / sum(n) + (count(*) - 1) / (2.0 * sum(n) * ln(2)) AS h_mm FROM (SELECT name, {by} ex, count(*) AS n FROM exps GROUP BY name, {by} ex) GROUP BY {by} name"""


@query(f"{EXPS} SELECT name, n, m AS distinct_ex, round(h, 9) AS entropy, round(h_mm, 9) AS entropy_mm FROM ({_ENTROPY.format(by='')})")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = statistics.entropy(statistics.exp_hist(tables.weights(spark, sf_dir)))
    return e.select("name", "n", F.col("m").alias("distinct_ex"), F.round("h", 9).alias("entropy"), F.round("h_mm", 9).alias("entropy_mm"))


@query(
    f"{EXPS}, whole AS ({_ENTROPY.format(by='')}), gr AS (SELECT name, sum(h_mm * n) / sum(n) AS h FROM ({_ENTROPY.format(by='r,')}) GROUP BY name), gc AS (SELECT name, sum(h_mm * n) / sum(n) AS h FROM ({_ENTROPY.format(by='c,')}) GROUP BY name) "
    "SELECT w.name, w.n, round(w.h_mm, 7) AS h, round(gr.h, 7) AS h_given_row, round(gc.h, 7) AS h_given_col, round(w.h_mm - gr.h, 7) AS info_row, round(w.h_mm - gc.h, 7) AS info_col FROM whole w JOIN gr ON gr.name = w.name JOIN gc ON gc.name = w.name"
)
def mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = statistics.mutual_info(tables.tensor_rows(spark, sf_dir))
    return m.select("name", "n", *[F.round(a, 7).alias(b) for a, b in (("h", "h"), ("h_given_r", "h_given_row"), ("h_given_c", "h_given_col"), ("info_row", "info_row"), ("info_col", "info_col"))])


@query(f"WITH {W} SELECT name, count(*) AS n, CAST(sum(((w >> 8) & 128) + (w & 127)) AS BIGINT) AS sum_raw, CAST(sum((w >> 7) & 255) AS BIGINT) AS sum_ex, CAST(0 AS BIGINT) AS mismatches FROM weights GROUP BY name")
def split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    parts = tables.weights(spark, sf_dir).select("name", "w", bits.raw(w).alias("raw"), bits.exponent(w).alias("ex"))
    differs = F.when(bits.join(F.col("raw"), F.col("ex")) != w, 1).otherwise(0)
    return parts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("sum_raw"), F.sum("ex").alias("sum_ex"), F.sum(differs).alias("mismatches"))


def _rounded(m: int) -> str:
    s = 7 - m
    q = f"least(((w & 127) + {(1 << (s - 1)) - 1} + (((w & 127) >> {s}) & 1)) >> {s}, {(1 << m) - 1})"
    return f"SELECT name, {m} AS m, CASE WHEN ((w >> 7) & 255) = 255 THEN w ELSE (w & 65408) | ({q} << {s}) END AS v, w FROM weights"


@query(f"WITH {W} SELECT name, CAST(m AS BIGINT) AS m, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_words, count(DISTINCT v) AS distinct_words, CAST(sum(CASE WHEN v <> w THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM ({' UNION ALL '.join(_rounded(m) for m in range(2, 7))}) GROUP BY name, m")
def round_mantissa(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), bits.round_mantissa(F.col("w"), m).alias("v")) for m in range(2, 7)]))
    rounded = tables.weights(spark, sf_dir).select("name", "w", each.alias("x")).select("name", "w", "x.*")
    return rounded.groupBy("name", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum_words"), F.count_distinct("v").alias("distinct_words"), F.sum((F.col("v") != F.col("w")).cast("int")).alias("changed"))


for _t in (32, 64, 128):
    tile_query(f"tile_distinct_t{_t}", lambda d, t=_t: sql.tile_distinct(d, t), _t)
    tile_query(f"palette_policies_t{_t}", lambda d, t=_t: sql.palette_totals(d, t), _t)
    tile_query(f"rank_policies_t{_t}", lambda d, t=_t: sql.rank_totals(d, t), _t)
    tile_query(f"best_choices_t{_t}", lambda d, t=_t: sql.best_choices(d, t), _t)
tile_query("bits_per_weight", lambda d: sql.rank_bits(d, 128), 128)
tile_query("baseline_codes", sql.baselines, 64)
tile_query("v1_meta", sql.v1_meta, 128)
tile_query("v2_meta", sql.v2_meta, 128)


def _v1_words(text: str) -> str:
    return f"SELECT name, r, CAST(sum(4 * b) AS BIGINT) AS words, CAST(sum(escapes) AS BIGINT) AS escapes FROM ({text}) q GROUP BY name, r"


def _offsets(text: str, columns: tuple[str, ...]) -> str:
    return f"SELECT name, r, {', '.join(columns)}, " + ", ".join(f"CAST(coalesce(sum({c}) OVER (PARTITION BY name ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {c}_before" for c in columns) + f" FROM ({text}) o"


@query(_offsets(_v1_words(ORACLE["v1_meta"]), ("words", "escapes")))
def v1_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row's words and escapes begin."""
    rows = QUERIES["v1_meta"](spark, sf_dir).groupBy("name", "r").agg(F.sum(4 * F.col("b")).alias("words"), F.sum("escapes").alias("escapes"))
    return codecs.row_offsets(codecs.row_offsets(rows, "words", "words_before"), "escapes", "escapes_before")


def _v2_words(text: str) -> str:
    return f"SELECT name, r, CAST((sum(bits) + 31) // 32 AS BIGINT) AS words FROM ({text}) q GROUP BY name, r"


@query(_offsets(_v2_words(ORACLE["v2_meta"]), ("words",)))
def v2_roff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = QUERIES["v2_meta"](spark, sf_dir).groupBy("name", "r").agg(F.floor((F.sum("bits") + 31) / 32).alias("words"))
    return codecs.row_offsets(rows, "words", "words_before")


_V1_TOTAL = f"SELECT name, 'v1' AS form, CAST(sum(8 * n) + 2048 + 8 * count(*) + 32 * sum(4 * b) + 8 * sum(escapes) AS BIGINT) AS bits, CAST(sum(n) AS BIGINT) AS numel FROM ({ORACLE['v1_meta']}) a GROUP BY name"
_V2_TOTAL = f"SELECT t.name, 'v2' AS form, CAST(t.n * 8 + 2048 + 8 * t.tiles + 32 * r.words + 32 * r.n_rows AS BIGINT) AS bits, CAST(t.n AS BIGINT) AS numel FROM (SELECT name, sum(n) AS n, count(*) AS tiles FROM ({ORACLE['v2_meta']}) b GROUP BY name) t JOIN (SELECT name, sum(words) AS words, count(*) AS n_rows FROM ({_v2_words(ORACLE['v2_meta'])}) c GROUP BY name) r ON r.name = t.name"


@query(f"{_V1_TOTAL} UNION ALL {_V2_TOTAL}")
def pack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each tensor as encoded for real: the parts' lengths, not the cost model."""
    rows = tables.tensor_rows(spark, sf_dir).select("name", "r", "w")
    out = None
    for form in ("v1", "v2"):
        extra = F.length("esc") * 8 if form == "v1" else F.lit(32)
        one = codecs.pack(rows, form).select("name", F.length("raw").alias("n"), (8 * F.length("raw") + 8 * F.length("meta") + 8 * F.length("words") + extra).alias("bits"))
        one = one.groupBy("name").agg((F.sum("bits") + 2048).alias("bits"), F.sum("n").alias("numel")).select("name", F.lit(form).alias("form"), "bits", "numel")
        out = out.unionByName(one) if out is not None else one
    return out


@query(f"SELECT name, b AS width, count(*) AS tiles, CAST(sum(escape) AS BIGINT) AS escape_tiles, CAST(sum(escapes) AS BIGINT) AS escapes FROM ({ORACLE['v1_meta']}) q GROUP BY name, b")
def layout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["v1_meta"](spark, sf_dir).groupBy("name", F.col("b").alias("width")).agg(F.count(F.lit(1)).alias("tiles"), F.sum("escape").alias("escape_tiles"), F.sum("escapes").alias("escapes"))


@query(f"WITH {W} SELECT f.form, w.name, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, w.numel FROM (SELECT name, count(*) AS numel FROM weights GROUP BY name) w CROSS JOIN (VALUES ('v1'), ('v2')) f(form)")
def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, decodes and compares every weight."""
    rows = tables.tensor_rows(spark, sf_dir).select("name", "r", "w")
    hists = codecs.histograms(rows)
    out = None
    for form in ("v1", "v2"):
        back = codecs.unpack(codecs.pack(rows, form), hists, form)
        one = statistics.differences(rows, back).select(F.lit(form).alias("form"), "name", *[F.col(c).cast("long").alias(c) for c in ("mismatches", "missing", "extra", "numel")])
        out = out.unionByName(one) if out is not None else one
    return out


@query(f"{EXPS}, {sql.ranks(sql.DUCKDB)} SELECT x.name, CAST(sum(CASE WHEN k.rk >= 15 THEN 1 ELSE 0 END) AS BIGINT) AS escapes, count(*) AS numel FROM exps x JOIN ranks k ON k.name = x.name AND k.ex = x.ex WHERE x.name = 'embeddings' GROUP BY x.name")
def r4_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tensor_rows(spark, sf_dir).where("name = 'embeddings'").select("name", "r", "w")
    return codecs.pack(rows, "r4").groupBy("name").agg(F.sum(F.length("esc")).alias("escapes"), F.sum(F.length("raw")).alias("numel"))


_IDS = "SELECT CAST(event_id AS BIGINT) AS pos, CAST(user_id % 500 AS BIGINT) AS id FROM events"


@query(f"WITH {W}, ids AS ({_IDS}) SELECT i.pos, i.id, CAST(sum(w.w) AS BIGINT) AS sum_words, count(w.w) AS n FROM ids i LEFT JOIN weights w ON w.name = 'embeddings' AND w.r = i.id GROUP BY i.pos, i.id")
def row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by id, after a round through the lookup layout."""
    rows = tables.tensor_rows(spark, sf_dir).where("name = 'embeddings'").select("name", "r", "w")
    back = codecs.unpack(codecs.pack(rows, "r4"), codecs.histograms(rows), "r4")
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("pos"), (F.col("user_id") % 500).cast("long").alias("id"))
    found = reductions.lookup(ids, back)
    return found.select("pos", "id", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_words"), F.coalesce(F.size("w"), F.lit(0)).cast("long").alias("n"))


@query()
def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of the embeddings times a fixed vector, in the declared order."""
    rows = tables.tensor_rows(spark, sf_dir).where("name = 'embeddings'")
    return reductions.matvec(rows, [16256 + (i * 37) % 128 for i in range(64)])


@query("SELECT vec_id, list_reduce(list_prepend(CAST(0 AS FLOAT), CAST(embedding AS FLOAT[])), lambda a, b: CAST(a + b AS FLOAT)) AS total FROM embeddings")
def split_k_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", reductions.fold(F.col("embedding").cast("array<float>")).alias("total"))


@query(
    f"WITH RECURSIVE {W}, {sql.exps(sql.DUCKDB)}, merging AS (SELECT name, list_sort(list(n)) AS l, CAST(0 AS BIGINT) AS bits, CAST(sum(n) AS BIGINT) AS n FROM (SELECT name, ex, count(*) AS n FROM exps GROUP BY name, ex) h GROUP BY name "
    "UNION ALL SELECT name, list_sort(list_append(l[3:], l[1] + l[2])), CAST(bits + l[1] + l[2] AS BIGINT), n FROM merging WHERE len(l) > 1) "
    "SELECT name, n, CASE WHEN bits = 0 THEN n ELSE bits END AS huffman_bits FROM merging WHERE len(l) = 1"
)
def huffman_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.huffman_bits(statistics.exp_hist(tables.weights(spark, sf_dir)))


@query(f"{EXPS}, keyed AS (SELECT name, cls AS grp, ex FROM exps UNION ALL SELECT name, 'all' AS grp, ex FROM exps) SELECT grp, count(DISTINCT name) AS tensors, count(*) AS numel, count(DISTINCT ex) AS distinct_ex FROM keyed GROUP BY grp")
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = statistics.exp_hist(tables.weights(spark, sf_dir), "cls")
    keyed = hist.withColumn("grp", F.explode(F.array(F.col("cls"), F.lit("all"))))
    return keyed.groupBy("grp").agg(F.count_distinct("name").alias("tensors"), F.sum("n").alias("numel"), F.count_distinct("ex").alias("distinct_ex"))


_NAMES = (
    ("model.layers.0.self_attn.q_proj.weight", (4096, 3840)),
    ("model.layers.3.mlp.experts.12.gate_proj.weight", (768, 2048)),
    ("model.layers.0.experts.gate_up_proj", (128, 1408, 2816)),
    ("model.language_model.layers.3.linear_attn.in_proj_a.weight", (32, 4096)),
    ("model.layers.0.input_layernorm.weight", (3840,)),
    ("lm_head.weight", (128256, 4096)),
    ("model.visual.blocks.0.attn.qkv.weight", (3456, 1152)),
    ("mtp.layers.0.mlp.gate_proj.weight", (12288, 4096)),
)
_CLASSES = (("linear", "attn", 0), ("linear", "experts", 3), ("linear", "experts", 0), ("other", "other", 3), ("other", "norm", 0), ("embed", "lm_head", None), ("mm", "mm", None), ("linear", "mlp", None))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', '{s}', {'NULL' if layer is None else layer}::BIGINT)" for (n, _), (c, s, layer) in zip(_NAMES, _CLASSES, strict=True)) + ") t(name, cls, sub, layer)")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n, list(s)) for n, s in _NAMES], "name string, shape array<bigint>")
    k = classify.classify(F.col("name"), F.col("shape"), F.lit("BF16"))
    return names.select("name", k["cls"].alias("cls"), k["sub"].alias("sub"), k["layer"].cast("long").alias("layer"))


_BIN = f"CASE WHEN rel <= 0 THEN 0 ELSE least(greatest(floor((log10(rel) + 8) * 200), 0), {statistics.BINS - 1}) END"
_EDGE = "CASE WHEN {0} = 0 THEN 0.0 ELSE pow(10.0, -8 + ({0} + 1) / 200.0) END"
_SIZE = "CASE WHEN ({0} >> 7) & 255 = 0 THEN ({0} & 127) * pow(2.0, -133) ELSE (({0} & 127) + 128) * pow(2.0, (({0} >> 7) & 255) - 134) END"


@query(
    f"WITH {W}, pairs AS ({' UNION ALL '.join(_rounded(m).replace('SELECT name,', 'SELECT name, cls, r, c // 32 AS t,') for m in range(2, 7))}), "
    f"sizes AS (SELECT m, cls, name, r, t, CASE WHEN ((w >> 7) & 255) = 255 THEN 0 ELSE {_SIZE.format('w')} END AS a, CASE WHEN ((w >> 7) & 255) = 255 THEN 0 ELSE {_SIZE.format('v')} END AS b FROM pairs), "
    "errors AS (SELECT m, cls, sqrt(sum((a - b) * (a - b)) / sum(a * a)) AS rel, max(CASE WHEN a > 0 THEN abs(a - b) / a ELSE 0 END) AS most FROM sizes GROUP BY m, cls, name, r, t HAVING sum(a * a) > 0), "
    f"binned AS (SELECT m, cls, CAST({_BIN} AS INTEGER) AS bin, count(*) AS n, max(most) AS most FROM errors GROUP BY 1, 2, 3), "
    "running AS (SELECT *, sum(n) OVER (PARTITION BY m, cls ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY m, cls) AS total FROM binned) "
    "SELECT CAST(m AS BIGINT) AS m, cls, CAST(max(total) AS BIGINT) AS tiles, "
    + ", ".join(f"round({_EDGE.format(f'min(CASE WHEN upto >= {q / 100} * total THEN bin END)')}, 12) AS p{f'{q:g}'.replace('.', '_')}" for q in (50, 90, 99, 99.9))
    + ", round(max(most), 12) AS max_rel FROM running GROUP BY m, cls"
)
def lossy_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mantissa width: percentiles of the relative error of tiles of 32, from a histogram, and the exact largest."""
    hist = tiles.lossy_bins(tables.tensor_rows(spark, sf_dir), 32, (2, 3, 4, 5, 6), statistics.BINS)
    qs = (50, 90, 99, 99.9)
    names = [f"p{q:g}".replace(".", "_") for q in qs]
    found = statistics.percentiles(hist, qs, "m", "cls").join(hist.groupBy("m", "cls").agg(F.max("max_rel").alias("max_rel")), ["m", "cls"])
    return found.select(F.col("m").cast("long").alias("m"), "cls", "tiles", *[F.round(c, 12).alias(c) for c in (*names, "max_rel")])


@query("SELECT idx // 32 AS win, count(*) AS n, min(token) AS first_sorted, max(token) AS last_sorted FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, role AS token FROM conversations) GROUP BY idx // 32 HAVING count(*) = 32")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 32 turns of the conversations in order."""
    from pyspark.sql import Window

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # Two levels: turns inside a conversation, and conversations' sizes summed up; only the sizes meet.
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")).withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stream = turns.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).join(sizes, "conv_id").select((F.col("before") + F.col("at")).alias("idx"), F.col("role").alias("token"))
    return runs.windows(stream, 32).select("win", F.size("tokens").cast("long").alias("n"), F.array_min("tokens").alias("first_sorted"), F.array_max("tokens").alias("last_sorted"))


@query(
    f"WITH {W}, e AS (SELECT r, c, w, (w & 65408) | (least(((w & 127) + 7 + (((w & 127) >> 4) & 1)) >> 4, 7) << 4) AS v FROM weights WHERE name = 'embeddings'), "
    "best AS (SELECT r, CAST(sum(CASE WHEN v <> w THEN 1 ELSE 0 END) AS BIGINT) AS changed, count(*) AS n FROM e GROUP BY r) SELECT count(*) AS rows_compared, CAST(sum(CASE WHEN changed = 0 THEN 1 ELSE 0 END) AS BIGINT) AS equal_rows, CAST(sum(changed) AS BIGINT) AS changed FROM best"
)
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against one whose words are rounded to 3 mantissa bits: equal rows, changed words."""
    rows = tables.tensor_rows(spark, sf_dir).where("name = 'embeddings'").select("r", "w", F.transform("w", lambda w: bits.round_mantissa(w, 3)).alias("v"))
    changed = F.aggregate(F.zip_with("w", "v", lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    return rows.select(changed.alias("changed")).agg(F.count(F.lit(1)).alias("rows_compared"), F.sum((F.col("changed") == 0).cast("int")).alias("equal_rows"), F.sum("changed").alias("changed"))


@query("SELECT count(*) AS n, round(avg(abs(a - b)), 9) AS mean, round(quantile_cont(abs(a - b), 0.99), 9) AS p99, round(max(abs(a - b)), 9) AS most, round(corr(a, b), 9) AS correlation FROM (SELECT l_quantity * l_tax AS a, l_quantity * l_discount AS b FROM lineitem)")
def nll_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") * F.col("l_tax")).alias("a"), (F.col("l_quantity") * F.col("l_discount")).alias("b"))
    return runs.nll_comparison(t).select("n", *[F.round(c, 9).alias(c) for c in ("mean", "p99", "most", "correlation")])


_SAMPLES = "SELECT event_type AS shape, CAST(user_id % 3 AS BIGINT) AS method, CAST(event_id // 100 AS BIGINT) AS round, avg(abs(value) + 1) AS seconds FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3"


@query(f"WITH s AS ({_SAMPLES}) SELECT s.shape, s.method, round(median(s.seconds), 9) AS seconds, round(median(b.seconds / s.seconds), 9) AS ratio, count(*) AS rounds FROM s JOIN s b ON b.shape = s.shape AND b.round = s.round AND b.method = 0 GROUP BY s.shape, s.method")
def bench_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    samples = e.groupBy(F.col("event_type").alias("shape"), (F.col("user_id") % 3).cast("long").alias("method"), F.floor(F.col("event_id") / 100).alias("round")).agg(F.avg(F.abs("value") + 1).alias("seconds")).withColumn("bytes", F.lit(1.0))
    return runs.paired_medians(samples, 0).select("shape", "method", F.round("seconds", 9).alias("seconds"), F.round("ratio", 9).alias("ratio"), "rounds")


_SHUFFLED = "shuffled AS (SELECT name, cls, r, row_number() OVER (PARTITION BY name, r ORDER BY (r * 7919 + c * 104729 + 1) % 2147483647 * 48271 % 2147483647, c) - 1 AS c, w FROM weights)"
_GAIN = sql.rank_totals(sql.DUCKDB, 32)


@query(
    f"SELECT a.name, a.policy, a.bits AS bits_real, b.bits AS bits_shuffled, round((b.bits - a.bits) / CAST(a.numel AS DOUBLE), 9) AS gain FROM ({_GAIN.replace('{weights}', W + ', ')}) a JOIN ({_GAIN.replace('{weights}', W + ', ' + _SHUFFLED + ', ').replace('% 256 AS ex FROM weights', '% 256 AS ex FROM shuffled')}) b ON b.name = a.name AND b.policy = a.policy"
)
def locality_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that the real order saves against the same weights shuffled inside their rows."""
    text = sql.rank_totals(sql.SPARK, 32)
    a = spark.sql(text, **given(spark, sf_dir, text, 32)).alias("a")
    b = spark.sql(text, **given(spark, sf_dir, text, 32, tiles.in_hash_order())).alias("b")
    return a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.policy") == F.col("b.policy"))).select("a.name", "a.policy", F.col("a.bits").alias("bits_real"), F.col("b.bits").alias("bits_shuffled"), F.round((F.col("b.bits") - F.col("a.bits")) / F.col("a.numel"), 9).alias("gain"))


@query(f"{EXPS}, {sql.ranks(sql.DUCKDB)} SELECT x.r, x.c, k.rk FROM exps x JOIN ranks k ON k.name = x.name AND k.ex = x.ex WHERE x.name = 'embeddings' AND x.r < 48 AND x.c < 192")
def exponent_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner of a tensor, as ranks."""
    w = tables.weights(spark, sf_dir).where("name = 'embeddings'")
    table = statistics.rank_table(statistics.exp_hist(w)).select("name", "ex", "rk")
    patch = w.where("r < 48 and c < 192").withColumn("ex", bits.exponent(F.col("w")))
    return patch.join(F.broadcast(table), ["name", "ex"]).select("r", F.col("c").cast("long").alias("c"), F.col("rk").cast("long").alias("rk"))
