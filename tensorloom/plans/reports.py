"""Registered queries of reports, checkpoints, offsets and gathers, with DuckDB's SQL."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import checkpoint, codecs, reductions, report, runs, statistics, tiles
from ..sources import safetensors, tables
from ..staging import shared_folder
from . import tensor_sql as sql
from .queries import _SHUFFLED, _V1_TOTAL, EXPS, ORACLE, QUERIES, W, query

#: name, cls, sub, layer, dtype of the tables as tensors of a model.
MODEL = (
    ("embeddings", "embed", "embed_tokens", None),
    ("acctbal", "linear", "mlp", 0),
    ("retailprice", "linear", "mlp", 2),
    ("supplier_bal", "linear", "attn", 0),
    ("totalprice", "linear", "attn", 10),
    ("event_value", "other", "other", None),
)
TILES = (32, 64, 128)
_MODEL = "model AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', '{s}', {'NULL' if x is None else x}::BIGINT)" for n, c, s, x in MODEL) + ") v(name, cls, sub, layer))"
_GROUPS = f"{_MODEL}, grouped AS (SELECT name, layer, sub AS grp FROM model WHERE cls = 'linear' UNION ALL SELECT name, layer, 'linear' FROM model WHERE cls = 'linear' UNION ALL SELECT name, layer, 'L' || layer FROM model WHERE cls = 'linear' AND layer IS NOT NULL UNION ALL SELECT name, layer, cls FROM model WHERE cls <> 'linear')"


def model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL, "name string, cls string, sub string, layer long")


def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensors' rows, written once for all passes over them."""
    folder = shared_folder(spark)
    tables.tensor_rows(spark, sf_dir).select("name", "cls", "r", "w").write.parquet(folder)
    return spark.read.parquet(folder)


def all_totals(spark: SparkSession, rows: DataFrame, order=None, ranks: bool = True) -> DataFrame:
    """name, t, policy, numel, ntiles, code of every policy and tile size."""
    out = None
    counts = tiles.counts(rows)
    ranked = tiles.with_ranks(rows, counts) if ranks else None
    for t in TILES:
        one = spark.sql(sql.palette_totals(sql.SPARK, t), tiles=tiles.palette_tiles(rows, t, order)).where("objective = 'actual'")
        one = one.select("name", F.lit(t).cast("long").alias("t"), "policy", "numel", "ntiles", (F.col("idx") + F.col("pal") + F.col("esc")).alias("code"))
        if ranks:
            text = sql.rank_totals(sql.SPARK, t)
            more = spark.sql(text, rtiles=tiles.rank_tiles(ranked, t, order))
            one = one.unionByName(more.select("name", F.lit(t).cast("long").alias("t"), "policy", "numel", "ntiles", F.col("bits").alias("code")))
        out = out.unionByName(one) if out is not None else one
    return out


def _totals(shuffled: bool, ranks: bool = True) -> str:
    extra = ", " + _SHUFFLED if shuffled else ""
    swap = (lambda x: x.replace("AS ex FROM weights", "AS ex FROM shuffled")) if shuffled else (lambda x: x)
    parts = [f"SELECT name, {t} AS t, policy, numel, ntiles, idx + pal + esc AS code FROM ({swap(sql.palette_totals(sql.DUCKDB, t)).replace('{weights}', W + extra + ', ')}) p WHERE objective = 'actual'" for t in TILES]
    if ranks:
        parts += [f"SELECT name, {t}, policy, numel, ntiles, bits FROM ({swap(sql.rank_totals(sql.DUCKDB, t)).replace('{weights}', W + extra + ', ')}) p" for t in TILES]
    return " UNION ALL ".join(parts)


def _group_bits(totals: str) -> str:
    return f"SELECT grp, CAST(t AS BIGINT) AS t, policy, count(*) AS tensors, CAST(sum(numel) AS BIGINT) AS numel, CAST(sum(9 * 0 + 8 * numel + code + 8 * ntiles) AS BIGINT) AS bits, CAST(sum(8 * numel + code + 40 * ntiles) AS BIGINT) AS bits_off FROM ({totals}) q JOIN grouped g ON g.name = q.name GROUP BY grp, t, policy".replace("9 * 0 + ", "")


@query(f"WITH {_GROUPS} SELECT *, round(bits / CAST(numel AS DOUBLE), 9) AS bpw, round(bits_off / CAST(numel AS DOUBLE), 9) AS bpw_off, TRY_CAST(CASE WHEN grp SIMILAR TO 'L[0-9]+' THEN substr(grp, 2) END AS BIGINT) AS layer FROM ({_group_bits(_totals(False))}) b")
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of every group, tile size and policy."""
    out = report.group_bits(all_totals(spark, staged_rows(spark, sf_dir)), model(spark))
    return out.select("grp", "t", "policy", "tensors", "numel", "bits", "bits_off", F.round("bpw", 9).alias("bpw"), F.round("bpw_off", 9).alias("bpw_off"), report.layer_number(F.col("grp")).alias("layer"))


FIXED = ("bump", "escape", "best", "rank_fixed", "rank_best")


@query(
    f"WITH {_GROUPS}, reals AS (SELECT *, bits / CAST(numel AS DOUBLE) AS bpw FROM ({_group_bits(_totals(False))}) a WHERE grp = 'linear'), "
    f"shuf AS (SELECT t, bits / CAST(numel AS DOUBLE) AS bpw FROM ({_group_bits(_totals(True, False))}) b WHERE grp = 'linear' AND policy = 'best'), "
    "best AS (SELECT r.t, s.bpw - r.bpw AS gain FROM reals r JOIN shuf s ON s.t = r.t WHERE r.policy = 'best' ORDER BY r.bpw, r.t LIMIT 1), "
    f"f AS (SELECT * FROM reals WHERE policy IN {FIXED} ORDER BY bpw, t, policy LIMIT 1), a AS (SELECT * FROM reals ORDER BY bpw, t, policy LIMIT 1) "
    f"SELECT best.t AS best_t, round(gain, 9) AS gain, CASE WHEN gain >= {report.BANDS[0][0]} THEN '{report.BANDS[0][1]}' WHEN gain >= {report.BANDS[1][0]} THEN '{report.BANDS[1][1]}' ELSE 'stop' END AS band, "
    "f.policy AS fixed_policy, f.t AS fixed_t, round(f.bpw, 9) AS fixed_bpw, a.policy AS any_policy, a.t AS any_t, round(a.bpw, 9) AS any_bpw FROM best CROSS JOIN f CROSS JOIN a"
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear group's best tile size, gain over shuffled rows, band, and cheapest policies."""
    rows = staged_rows(spark, sf_dir)
    of = lambda totals: report.group_bits(totals, model(spark)).where("grp = 'linear'")
    out = report.verdict(of(all_totals(spark, rows)), of(all_totals(spark, rows, tiles.in_hash_order(), False)), FIXED)
    return out.select(*[F.round(c, 9).alias(c) if c in ("gain", "fixed_bpw", "any_bpw") else c for c in out.columns])


_SCOPES = "SELECT grp || '/global' AS name, grp, 'global' AS scope, ex, n FROM kept UNION ALL SELECT grp || '/block/' || coalesce(CAST(layer AS VARCHAR), '-'), grp, 'block', ex, n FROM kept UNION ALL SELECT grp || '/tensor/' || name, grp, 'tensor', ex, n FROM kept"
_AT = "sum(CASE WHEN scope = '{0}' THEN {1} ELSE 0 END)"


@query(
    f"WITH RECURSIVE {W}, {sql.exps(sql.DUCKDB)}, {_GROUPS}, kept AS (SELECT g.grp, g.layer, g.name, h.ex, h.n FROM (SELECT name, ex, count(*) AS n FROM exps GROUP BY name, ex) h JOIN grouped g ON g.name = h.name), "
    f"counts AS (SELECT name, grp, scope, ex, CAST(sum(n) AS BIGINT) AS n FROM ({_SCOPES}) s GROUP BY name, grp, scope, ex), "
    "merging AS (SELECT name, grp, scope, list_sort(list(n)) AS l, CAST(0 AS BIGINT) AS bits, CAST(sum(n) AS BIGINT) AS size FROM counts GROUP BY name, grp, scope UNION ALL SELECT name, grp, scope, list_sort(list_append(l[3:], l[1] + l[2])), CAST(bits + l[1] + l[2] AS BIGINT), size FROM merging WHERE len(l) > 1), "
    "codes AS (SELECT name, grp, scope, size, CASE WHEN bits = 0 THEN size ELSE bits END AS hb FROM merging WHERE len(l) = 1), "
    "ents AS (SELECT name, sum(n) * log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(n)) AS eb FROM counts GROUP BY name) "
    f"SELECT grp, CAST({_AT.format('global', 'size')} AS BIGINT) AS numel, "
    + ", ".join(f"round(8 + {_AT.format(s, 'hb')} / CAST({_AT.format('global', 'size')} AS DOUBLE), 8) AS huffman_{s}" for s in ("global", "block", "tensor"))
    + ", "
    + ", ".join(f"round(8 + {_AT.format(s, 'eb')} / CAST({_AT.format('global', 'size')} AS DOUBLE), 8) AS entropy_{s}" for s in ("global", "tensor"))
    + " FROM codes JOIN ents ON ents.name = codes.name GROUP BY grp"
)
def group_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.group_baselines(tiles.counts(tables.tensor_rows(spark, sf_dir)), model(spark))
    return out.select("grp", "numel", *[F.round(c, 8).alias(c) for c in out.columns if c not in ("grp", "numel")])


_SIZES = "sizes AS (SELECT w.name, m.cls, m.sub, m.layer, 'BF16' AS dtype, count(*) AS numel FROM weights w JOIN model m ON m.name = w.name GROUP BY ALL)"


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tables.tensor_rows(spark, sf_dir).groupBy("name").agg(F.sum(F.size("w")).cast("long").alias("numel"))
    return model(spark).join(sizes, "name").withColumn("dtype", F.lit("BF16"))


@query(
    f"WITH {W}, {_MODEL}, {_SIZES}, t AS (SELECT cls, sub, count(*) AS tensors, CAST(sum(numel) AS BIGINT) AS params, 'BF16' AS dtypes FROM sizes GROUP BY cls, sub) "
    f"SELECT *, round(params / CAST(sum(params) OVER () AS DOUBLE), 9) AS share, row_number() OVER (ORDER BY list_position({list(report.CLASS_ORDER)}, cls), params DESC, sub) AS place, row_number() OVER (ORDER BY params DESC, sub) <= 3 AS largest, "
    "(SELECT round(sum(CASE WHEN cls = 'linear' THEN numel ELSE 0 END) / CAST(sum(CASE WHEN cls IN ('linear', 'other') THEN numel ELSE 0 END) AS DOUBLE), 9) FROM sizes) AS linear_share FROM t"
)
def classification_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = sized(spark, sf_dir)
    share = report.linear_share(catalog).select(F.round("share", 9).alias("linear_share"))
    table = report.classification_table(catalog).crossJoin(share)  # one row
    return table.select("cls", "sub", "tensors", "params", "dtypes", F.round("share", 9).alias("share"), F.col("place").cast("long").alias("place"), "largest", "linear_share")


_INFO = ("h", "h_given_row", "h_given_col", "info_row", "info_col")


@query(
    f"WITH {_GROUPS}, info AS ({ORACLE['mutual_info'].replace(', 7)', ', 12)')}) SELECT grp, count(*) AS tensors, CAST(sum(n) AS BIGINT) AS numel, "
    + ", ".join(f"round(sum({c} * n) / sum(n), 6) AS {c}" for c in _INFO)
    + " FROM info JOIN grouped g ON g.name = info.name WHERE grp IN ('linear', 'mlp', 'attn') GROUP BY grp"
)
def mutual_info_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = statistics.mutual_info(tables.tensor_rows(spark, sf_dir)).withColumnsRenamed({"h_given_r": "h_given_row", "h_given_c": "h_given_col"})
    groups = model(spark).where("cls = 'linear'").select("name", F.explode(F.array("sub", F.lit("linear"))).alias("grp"))
    out = report.weighted_means(info, groups, list(_INFO))
    return out.select("grp", "tensors", "numel", *[F.round(c, 6).alias(c) for c in _INFO])


@query(_MODEL.replace("model AS (", "", 1)[:-1] + " WHERE cls IN ('linear', 'embed') ORDER BY name LIMIT 3")
def first_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three chosen tensors, as a limited scan takes them."""
    listed = model(spark).where("cls in ('linear', 'embed')").withColumn("file", F.lit("one")).withColumn("offset", F.col("name"))
    return report.first_tensors(listed, 3).select("name", "cls", "sub", "layer")


# The lookup layout


@query(
    f"{EXPS}, {sql.ranks(sql.DUCKDB)}, rows AS (SELECT x.name, x.r, count(*) AS n, sum(CASE WHEN k.rk >= 15 THEN 1 ELSE 0 END) AS escapes, count(DISTINCT CASE WHEN k.rk >= 15 THEN x.c // 128 END) AS flagged FROM exps x JOIN ranks k ON k.name = x.name AND k.ex = x.ex GROUP BY x.name, x.r) "
    "SELECT name, r, n, CAST(escapes AS BIGINT) AS escapes, CAST(flagged AS BIGINT) AS flagged, CAST(coalesce(sum(escapes) OVER (PARTITION BY name ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_esc FROM rows"
)
def r4_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row in the lookup layout: escapes, tiles that have some, and where its escapes begin."""
    rows = tables.tensor_rows(spark, sf_dir).select("name", "cls", "r", "w")
    of = tiles.rank_tiles(tiles.with_ranks(rows, tiles.counts(rows)), 128)
    per_row = of.groupBy("name", "r").agg(F.sum("n").alias("n"), F.sum("e4").alias("escapes"), F.sum((F.col("e4") > 0).cast("long")).alias("flagged"))
    return codecs.row_offsets(per_row, "escapes", "row_esc")


@query("SELECT name, r, t, b, CAST(sum(4 * b) OVER (PARTITION BY name ORDER BY r, t) - 4 * b AS BIGINT) AS start FROM (" + ORACLE["v1_meta"] + ") m")
def tile_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each tile's words begin in its tensor's stream."""
    meta = QUERIES["v1_meta"](spark, sf_dir)
    before = codecs.row_offsets(meta.groupBy("name", "r").agg(F.sum(4 * F.col("b")).alias("words")), "words", "row_begin").select("name", "r", "row_begin")
    inside = F.sum(4 * F.col("b")).over(Window.partitionBy("name", "r").orderBy("t")) - 4 * F.col("b")
    return meta.withColumn("inside", inside).join(before, ["name", "r"]).select("name", "r", "t", "b", (F.col("row_begin") + F.col("inside")).cast("long").alias("start"))


@query(f"SELECT name, r, words_before AS begin, CAST(coalesce(lead(words_before) OVER (PARTITION BY name ORDER BY r), words_before + words) AS BIGINT) AS next FROM ({ORACLE['v2_roff']}) o")
def row_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row's stream begins and the next one's does; rows of a tensor follow each other without a gap."""
    return QUERIES["v2_roff"](spark, sf_dir).select("name", "r", F.col("words_before").alias("begin"), (F.col("words_before") + F.col("words")).cast("long").alias("next"))


_SLOTS = "slots AS (SELECT CAST(event_id AS BIGINT) AS token, CAST(user_id % 8 AS BIGINT) AS expert FROM events)"


@query(f"WITH {W}, {_SLOTS} SELECT s.token, s.expert, count(DISTINCT w.r) AS n_rows, CAST(sum(w.w) AS BIGINT) AS sum_words FROM slots s JOIN weights w ON w.name = 'embeddings' AND w.r BETWEEN s.expert * 32 + 4 AND s.expert * 32 + 11 GROUP BY s.token, s.expert")
def expert_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rows from the fourth of each token's expert, out of the lookup layout."""
    rows = tables.tensor_rows(spark, sf_dir).where("name = 'embeddings'").select("name", "r", "w")
    back = codecs.unpack(codecs.pack(rows, "r4"), codecs.histograms(rows), "r4")
    slots = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("token"), (F.col("user_id") % 8).cast("long").alias("expert"))
    found = reductions.expert_rows(slots, back, 32, 4, 8)
    words = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.groupBy("token", "expert").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(words).alias("sum_words"))


@query(f"WITH {W} SELECT (r // 32) * 8 + r % 32 - 4 AS r, CAST(sum(w) AS BIGINT) AS sum_words, count(*) AS n FROM weights WHERE name = 'embeddings' AND r % 32 BETWEEN 4 AND 11 GROUP BY 1")
def block_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 4 to 11 of every 32, decoded from the lookup layout; the others are not."""
    rows = tables.tensor_rows(spark, sf_dir).where("name = 'embeddings'").select("name", "r", "w")
    hists = codecs.histograms(rows)
    packed = codecs.pack(rows, "r4", hists)
    back = codecs.unpack(reductions.block_rows(packed, 32, 4, 8), hists, "r4")
    return back.select("r", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_words"), F.size("w").cast("long").alias("n"))


_WANTED = "SELECT DISTINCT CAST(user_id % 500 AS BIGINT) // 16 AS chunk FROM events WHERE event_id % 50 = 0"


@query(f"WITH {W}, wanted AS ({_WANTED}) SELECT r // 16 AS chunk, count(DISTINCT r) AS n_rows, CAST(sum(w) AS BIGINT) AS sum_words FROM weights WHERE name = 'embeddings' AND r // 16 IN (SELECT chunk FROM wanted) GROUP BY 1")
def wanted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 16 rows that hold a row asked for; the others are not read on."""
    wanted = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 50 = 0").select(F.floor((F.col("user_id") % 500) / 16).cast("long").alias("chunk")).distinct()
    rows = tables.tensor_rows(spark, sf_dir).where("name = 'embeddings'").withColumn("chunk", F.floor(F.col("r") / 16).cast("long"))
    words = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.join(wanted, "chunk", "left_semi").groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(words).alias("sum_words"))


# Views, scalars and small reports


@query(
    f"{EXPS}, {sql.ranks(sql.DUCKDB)}, e AS (SELECT x.r, x.c, k.rk, row_number() OVER (PARTITION BY x.r ORDER BY (x.r * 7919 + x.c * 104729 + 1) % 2147483647 * 48271 % 2147483647, x.c) - 1 AS sc, ((x.r * 64 + x.c) * 48271 + 12345) % (SELECT count(*) FROM weights WHERE name = 'embeddings') AS p FROM exps x JOIN ranks k ON k.name = x.name AND k.ex = x.ex WHERE x.name = 'embeddings'), "
    "v AS (SELECT 'real' AS view, r, c, rk FROM e UNION ALL SELECT 'shuf_row', r, sc, rk FROM e UNION ALL SELECT 'shuf_tensor', p // 64, p % 64, rk FROM e) SELECT view, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, rk FROM v WHERE r < 48 AND c < 192"
)
def patch_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner of a tensor as ranks: as it is, shuffled inside rows, and shuffled as a whole."""
    rows = tables.tensor_rows(spark, sf_dir).where("name = 'embeddings'").select("name", "cls", "r", "w")
    ranked = tiles.with_ranks(rows, tiles.counts(rows))
    cells = ranked.select("r", "ranks", F.posexplode("w").alias("c", "w")).select("r", F.col("c").cast("long").alias("c"), F.get("ranks", bits.exponent(F.col("w"))).cast("long").alias("rk"))
    size = rows.agg(F.sum(F.size("w")).cast("long").alias("n"))
    place = report.permuted(F.col("r") * 64 + F.col("c"), F.col("n"))
    whole = cells.crossJoin(F.broadcast(size)).select(F.lit("shuf_tensor").alias("view"), F.floor(place / 64).alias("r"), (place % 64).alias("c"), "rk")
    inside = statistics.shuffled_in_rows(cells.where("r < 48").withColumn("name", F.lit("embeddings")))
    out = cells.select(F.lit("real").alias("view"), "r", "c", "rk").unionByName(inside.select(F.lit("shuf_row").alias("view"), "r", F.col("c").cast("long").alias("c"), "rk")).unionByName(whole)
    return out.where("r < 48 and c < 192")


@query(
    "WITH s AS (SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id % 200 + 1 AS BIGINT) AS m, CAST((event_id % 64 + 1) * 16 AS BIGINT) AS n, CAST((user_id % 40 + 1) * 32 AS BIGINT) AS k FROM events) "
    "SELECT id, CASE WHEN k % 128 = 0 THEN 4 WHEN k % 64 = 0 THEN 2 ELSE 1 END AS step, k > 64 AND k < 16 * n AS matvec, CASE WHEN m <= 16 THEN 16 WHEN m <= 32 OR (m + 63) // 64 * 64 - m >= 32 THEN 32 ELSE 64 END AS bm, CASE WHEN m <= 16 THEN 32 ELSE 64 END AS bn, printf('%.3f', k / CAST(n + 1 AS DOUBLE)) AS ratio, row_number() OVER (ORDER BY n * k DESC, id) AS place FROM s"
)
def dispatch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How products of given shapes would run; shapes in order of N K."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = e.select(F.col("event_id").cast("long").alias("id"), (F.col("user_id") % 200 + 1).cast("long").alias("m"), ((F.col("event_id") % 64 + 1) * 16).cast("long").alias("n"), ((F.col("user_id") % 40 + 1) * 32).cast("long").alias("k"))
    tile = reductions.gemm_tile(F.col("m"))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("n") * F.col("k")), "id"))  # a report of shapes
    return s.select("id", reductions.n_per_thread(F.col("k")).alias("step"), reductions.use_matvec(F.col("n"), F.col("k")).alias("matvec"), tile["bm"].alias("bm"), tile["bn"].alias("bn"), F.format_string("%.3f", F.col("k") / (F.col("n") + 1)).alias("ratio"), place.cast("long").alias("place"))


@query(f"WITH {W} SELECT name, r, sha256(string_agg(CAST(w AS VARCHAR), ',' ORDER BY c)) AS hash FROM weights GROUP BY name, r")
def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each row's words, by which runs are compared without their rows."""
    rows = tables.tensor_rows(spark, sf_dir)
    return rows.where(F.size("w") > 0).select("name", "r", F.sha2(F.array_join(F.col("w").cast("array<string>"), ","), 256).alias("hash"))


@query("SELECT vec_id, CAST(sum(CAST(CAST(x AS BIT) AS INTEGER)::BIGINT & 4294967295) AS BIGINT) AS sum_bits, CAST(sum((CAST(CAST(x AS BIT) AS INTEGER)::BIGINT & 4294967295) >> 16) AS BIGINT) AS sum_truncated FROM (SELECT vec_id, unnest(CAST(embedding AS FLOAT[])) AS x FROM embeddings) GROUP BY vec_id")
def truncated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BF16 by truncation."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") > 0)
    u = F.transform(F.col("embedding").cast("array<float>"), lambda x: bits.float_bits(x))
    add = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("vec_id", add(u).alias("sum_bits"), add(F.transform(u, bits.truncated)).alias("sum_truncated"))


_LOGITS = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) > 0"


@query(f"SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS BIGINT) AS best, round(l, 9) AS lse, round(x[vec_id % 64 + 1] - l, 9) AS logp FROM (SELECT vec_id, x, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS l FROM ({_LOGITS}) a) b")
def logit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmax, log of the sum of exponentials, and a target's log-probability, taking vectors as logits."""
    x = F.col("x")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") > 0).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", reductions.argmax(x).cast("long").alias("best"), F.round(reductions.log_sum_exp(x), 9).alias("lse"), F.round(reductions.log_softmax_at(x, (F.col("vec_id") % 64).cast("int")), 9).alias("logp"))


_RUNS = "runs AS (SELECT v.variant, CAST(vec_id // 32 AS BIGINT) AS win, CAST(vec_id % 32 AS BIGINT) AS pos, CASE WHEN variant = 'ref' THEN x ELSE list_transform(x, lambda y: round(y, 2)) END AS x FROM ({0}) e CROSS JOIN (VALUES ('ref'), ('rounded')) v(variant))".format(_LOGITS)


@query(
    f"WITH {_RUNS}, p AS (SELECT variant, win, pos, list_position(x, list_max(x)) - 1 AS am, x[pos % 64 + 1] - (list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))))) AS lp FROM runs) "
    "SELECT a.variant, count(*) AS positions, round(avg(CASE WHEN a.am = r.am THEN 1.0 ELSE 0.0 END), 9) AS same_argmax, round(exp(-avg(a.lp)), 9) AS perplexity, round(max(abs(a.lp - r.lp)), 9) AS max_diff FROM p a JOIN p r ON r.variant = 'ref' AND r.win = a.win AND r.pos = a.pos GROUP BY a.variant"
)
def run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of rounded logits against the reference, position by position."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") > 0).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    made = e.withColumn("variant", F.explode(F.array(F.lit("ref"), F.lit("rounded")))).withColumn("x", F.when(F.col("variant") == "ref", F.col("x")).otherwise(F.transform("x", lambda y: F.round(y, 2))))
    pos = (F.col("vec_id") % 32).cast("int")
    each = made.select("variant", F.floor(F.col("vec_id") / 32).alias("win"), pos.alias("pos"), F.xxhash64("x").alias("h"), reductions.argmax(F.col("x")).alias("am"), reductions.log_softmax_at(F.col("x"), pos % 64).alias("lp"))
    out = runs.compare_positions(each, "ref")
    return out.select("variant", "positions", *[F.round(c, 9).alias(c) for c in ("same_argmax", "perplexity", "max_diff")])


@query("SELECT CAST(user_id AS BIGINT) AS variant, CAST(event_id AS BIGINT) AS step, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 9) AS delta FROM events")
def step_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("variant"), F.col("event_id").cast("long").alias("step"), F.col("value").alias("t"))
    return runs.step_deltas(e).select("variant", "step", F.round("delta", 9).alias("delta"))


@query(
    "SELECT event_type AS method, count(p.p_partkey) AS shapes, round(sum(e.value * p.p_size), 6) AS us_per_token FROM (SELECT event_type, event_id, value FROM events WHERE value IS NOT NULL) e LEFT JOIN part p ON p.p_partkey = e.event_id WHERE p.p_partkey IS NOT NULL GROUP BY event_type"
)
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings weighted by how often a token needs the shape; timings of shapes without a count are left out."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null").select(F.col("event_type").alias("method"), F.col("event_id").alias("shape"), "value")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), "p_size")
    return e.join(p, F.col("shape") == F.col("key"), "left").where("key is not null").groupBy("method").agg(F.count(F.lit(1)).alias("shapes"), F.round(F.sum(F.col("value") * F.col("p_size")), 6).alias("us_per_token"))


_MAPS = "a AS (SELECT doc_id AS key, sha256(text) AS value FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id AS key, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS value FROM documents WHERE doc_id % 13 <> 0)"


@query(f"WITH {_MAPS} SELECT CASE WHEN a.key IS NULL THEN 'extra' WHEN b.key IS NULL THEN 'missing' WHEN a.value IS NOT DISTINCT FROM b.value THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM a FULL OUTER JOIN b ON a.key = b.key GROUP BY 1")
def digest_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of digests held against each other."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    local = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("key"), sha(F.col("text")).alias("value"))
    remote = d.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("key"), sha(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("value"))
    return report.maps_differ(local, remote)


# Whole checkpoints


def checkpoint_of(spark: SparkSession, sf_dir: str) -> str:
    """The tables as a checkpoint of two files: embeddings by rows, the others as vectors."""
    folder = shared_folder(spark).removeprefix("file://")
    rows = staged_rows(spark, sf_dir).select("name", "r", "w")
    sizes = rows.groupBy("name").agg(F.sum(F.size("w")).cast("long").alias("n"), F.max(F.size("w")).cast("long").alias("k"))
    flat = F.array("n")
    shape = F.when(F.col("name") == "embeddings", F.array(F.floor(F.col("n") / F.col("k")), F.col("k"))).otherwise(flat)
    safetensors.write(rows, sizes.select("name", F.when(F.col("name") == "embeddings", "one.safetensors").otherwise("two.safetensors").alias("file"), shape.cast("array<bigint>").alias("shape")), folder)
    return folder


def packed_checkpoint(spark: SparkSession, sf_dir: str) -> tuple[str, str, DataFrame]:
    folder, into = checkpoint_of(spark, sf_dir), shared_folder(spark)
    return folder, into, checkpoint.pack_model(spark, folder, into, "v1", F.size("shape") == 2)


_MANIFEST = f"SELECT t.name, CASE WHEN t.name = 'embeddings' THEN 'v1' ELSE 'copy' END AS form, t.numel, CASE WHEN t.name = 'embeddings' THEN t.bits ELSE 16 * t.numel END AS bits FROM ({_V1_TOTAL}) t"


@query(_MANIFEST)
def pack_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing a whole checkpoint says of each tensor."""
    return packed_checkpoint(spark, sf_dir)[2]


@query(f"WITH {_MODEL}, keyed AS (SELECT x.*, m.cls FROM ({_MANIFEST}) x JOIN model m ON m.name = x.name), spread AS (SELECT cls, numel, bits FROM keyed UNION ALL SELECT 'all', numel, bits FROM keyed) SELECT cls, count(*) AS tensors, CAST(sum(numel) AS BIGINT) AS numel, CAST(sum(bits) AS BIGINT) AS bits, round(sum(bits) / CAST(sum(numel) AS DOUBLE), 9) AS bits_per_weight FROM spread GROUP BY cls")
def class_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checkpoint.class_bits(packed_checkpoint(spark, sf_dir)[2], model(spark).select("name", "cls"))
    return out.withColumn("bits_per_weight", F.round("bits_per_weight", 9))


@query(f"WITH {W} SELECT name, count(*) AS numel, CAST(sum(w) AS BIGINT) AS sum_words, CAST(0 AS BIGINT) AS catalog_differences, CAST(2 AS BIGINT) AS equal_files FROM weights GROUP BY name")
def unpack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint packed and unpacked again: its tensors, differences of the catalogs, and files that are the same byte by byte."""
    folder, into, _ = packed_checkpoint(spark, sf_dir)
    back = shared_folder(spark).removeprefix("file://")
    checkpoint.unpack_model(spark, into, back)
    differ = checkpoint.catalogs_differ(safetensors.catalog(spark, folder), safetensors.catalog(spark, back)).agg(F.count(F.lit(1)).alias("catalog_differences"))
    digests = lambda at: report.file_digests(spark, at, "*.safetensors").select(F.element_at(F.split("key", "/"), -1).alias("key"), "value")
    Path(back, safetensors.INDEX).write_text(json.dumps({"weight_map": {t[0]: t[3] for t in safetensors.tensors(back)}}))
    same = report.maps_differ(digests(folder), digests(back)).agg(F.sum(F.when(F.col("state") == "same", F.col("n")).otherwise(0)).alias("equal_files"))
    rows = safetensors.read(spark, back)
    words = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    per = rows.groupBy("name").agg(F.sum(F.size("w")).cast("long").alias("numel"), F.sum(words).alias("sum_words"))
    return per.crossJoin(differ).crossJoin(same)  # one row each
