"""Histograms, ranks, entropy and information of exponents, as DataFrame operations on weights (name, cls, r, c, w)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..workers import ship
from . import tiles


def exp_hist(weights: DataFrame, *by: str) -> DataFrame:
    """n of each exponent, per name and what else is asked for; partial sums before the shuffle, so a task sends 256 rows a group at most."""
    return weights.groupBy("name", *by, bits.exponent(F.col("w")).alias("ex")).agg(F.count(F.lit(1)).alias("n"))


def rank_table(hist: DataFrame) -> DataFrame:
    """name, ex, n, rk: all 256 exponents of each name by count, ties by exponent, absent ones last."""
    spine = hist.sparkSession.range(256).select(F.col("id").cast("int").alias("ex"))
    dense = hist.select("name").distinct().crossJoin(F.broadcast(spine)).join(hist, ["name", "ex"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.withColumn("rk", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "ex")) - 1)


def entropy(hist: DataFrame, *by: str) -> DataFrame:
    """n, distinct exponents, Shannon entropy, and with the Miller-Madow correction (m - 1) / (2 n ln 2)."""
    # H = log2 N - sum(n log2 n) / N needs one pass over the counts.
    total = F.sum("n")
    h = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return hist.groupBy("name", *by).agg(total.alias("n"), F.count(F.lit(1)).alias("m"), h.alias("h")).withColumn("h_mm", F.col("h") + (F.col("m") - 1) / (2 * F.col("n") * math.log(2)))


def mutual_info(rows: DataFrame) -> DataFrame:
    """Entropy of the exponent, and given its row and its column, corrected, weighted by how many weights a row or column has.

    From rows (name, w array): rows are told inside themselves, columns by one
    shuffle of (column, exponent) counts, and the whole by adding those up.
    """
    places = rows.select("name", F.posexplode("w").alias("c", "w"))
    columns = exp_hist(places, "c")
    given_c = entropy(columns, "c").groupBy("name").agg((F.sum(F.col("h_mm") * F.col("n")) / F.sum("n")).alias("h_given_c"))
    whole = entropy(columns.groupBy("name", "ex").agg(F.sum("n").alias("n"))).select("name", "n", F.col("h_mm").alias("h"))
    given_r = tiles.row_entropies(rows).select("name", (F.col("h") / F.col("n")).alias("h_given_r"))
    both = whole.join(given_r, "name").join(given_c, "name")
    return both.withColumn("info_row", F.col("h") - F.col("h_given_r")).withColumn("info_col", F.col("h") - F.col("h_given_c"))


def huffman_lengths(counts: np.ndarray) -> np.ndarray:
    """Code length of each symbol of an optimal prefix code; one symbol alone has one bit, absent ones none.

    The leaves in order of count, and the merged nodes in the order they are made,
    which is that of their weights too, are two queues: the two least are at their fronts.
    """
    leaves = np.flatnonzero(counts)[np.argsort(counts[counts > 0], kind="stable")]
    m = len(leaves)
    lengths = np.zeros(len(counts), np.int64)
    if m < 2:
        lengths[leaves] = 1
        return lengths
    weight = np.concatenate([counts[leaves], np.zeros(m - 1, counts.dtype)])
    above = np.zeros(2 * m - 1, np.int64)
    leaf, node = 0, m
    for made in range(m, 2 * m - 1):
        for _ in range(2):
            if leaf < m and (node >= made or weight[leaf] <= weight[node]):
                taken, leaf = leaf, leaf + 1
            else:
                taken, node = node, node + 1
            above[taken] = made
            weight[made] += weight[taken]
    depth = np.zeros(2 * m - 1, np.int64)
    for i in range(2 * m - 3, -1, -1):
        depth[i] = depth[above[i]] + 1
    lengths[leaves] = depth[:m]
    return lengths


def huffman_bits(hist: DataFrame) -> DataFrame:
    """name, n, huffman_bits: a name's histogram is 256 rows at most, so a group fits in a task."""
    ship(hist.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].to_numpy()
        return pd.DataFrame({"name": [group["name"].iloc[0]], "n": [int(n.sum())], "huffman_bits": [int((n * huffman_lengths(n)).sum())]})

    return hist.select("name", "n").groupBy("name").applyInPandas(run, "name string, n long, huffman_bits long")


# Lossy rounding

BINS = 1601


def lossy_tiles(weights: DataFrame, t: int, m: int) -> DataFrame:
    """Per tile the relative Frobenius error and the largest relative error of rounding to m bits; null where undefined."""
    w = F.col("w")
    special = bits.exponent(w) == 255
    a = F.when(special, 0.0).otherwise(F.abs(bits.value(w)))
    d = F.when(special, 0.0).otherwise(F.abs(bits.value(w) - bits.value(bits.round_mantissa(w, m))))
    cells = weights.select("name", "cls", "r", F.floor(F.col("c") / t).alias("t"), a.alias("a"), d.alias("d"))
    return cells.groupBy("name", "cls", "r", "t").agg(
        F.when(F.sum(F.col("a") * F.col("a")) > 0, F.sqrt(F.sum(F.col("d") * F.col("d")) / F.sum(F.col("a") * F.col("a")))).alias("rel_fro"),
        F.max(F.when(F.col("a") > 0, F.col("d") / F.col("a"))).alias("max_rel"),
    )


def error_bin(x: Column) -> Column:
    return F.when(x <= 0, 0).otherwise(F.least(F.greatest(F.floor((F.log10(x) + 8) * 200), F.lit(0)), F.lit(BINS - 1))).cast("int")


def bin_upper(i: Column) -> Column:
    return F.when(i == 0, 0.0).otherwise(F.pow(F.lit(10.0), -8 + (i + 1) / 200))


def percentiles(hist: DataFrame, qs: tuple[float, ...], *by: str) -> DataFrame:
    """Upper edge of the first bin whose running count reaches q percent; from bin and n per group."""
    window = Window.partitionBy(*by)
    running = hist.withColumn("upto", F.sum("n").over(window.orderBy("bin"))).withColumn("total", F.sum("n").over(window))
    at = [bin_upper(F.min(F.when(F.col("upto") >= q / 100 * F.col("total"), F.col("bin")))).alias(f"p{q:g}".replace(".", "_")) for q in qs]
    return running.groupBy(*by).agg(F.max("total").alias("tiles"), *at)


# Layouts to compare with: the same weights in another order


def shuffled_in_rows(weights: DataFrame, seed: int = 1) -> DataFrame:
    """Weights of each row in the order of an integer hash of their place; both engines of a test can compute it."""
    place = (F.col("r") * 7919 + F.col("c") * 104_729 + seed) % F.lit(2_147_483_647) * 48_271 % F.lit(2_147_483_647)
    order = Window.partitionBy("name", "r").orderBy(place, "c")
    return weights.withColumn("c", (F.row_number().over(order) - 1).cast("int"))


# Verification


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per name: weights on both sides that differ, and weights that one side lacks; rows (name, r, w array)."""
    both = left.select("name", "r", F.col("w").alias("a")).join(right.select("name", "r", F.col("w").alias("b")), ["name", "r"], "full_outer")
    n = lambda x: F.coalesce(F.size(x), F.lit(0))
    common = F.zip_with("a", "b", lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1).otherwise(0))
    mismatch = F.coalesce(F.aggregate(common, F.lit(0), lambda s, x: s + x), F.lit(0))
    return both.groupBy("name").agg(F.sum(mismatch).alias("mismatches"), F.sum(F.greatest(n("a") - n("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(n("b") - n("a"), F.lit(0))).alias("extra"), F.sum(n("a")).alias("numel"))


