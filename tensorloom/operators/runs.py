"""Comparison of runs position by position, of timings round by round, and windows of a token stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_positions(runs: DataFrame, reference: str) -> DataFrame:
    """Per variant against the reference: positions, equal hashes, equal argmax, perplexity, largest difference of log probability."""
    ref = runs.where(F.col("variant") == reference).select("win", "pos", F.col("h").alias("rh"), F.col("am").alias("ra"), F.col("lp").alias("rl"))
    share = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("int"))
    return runs.join(ref, ["win", "pos"]).groupBy("variant").agg(F.count(F.lit(1)).alias("positions"), share("h", "rh").alias("same_hash"), share("am", "ra").alias("same_argmax"), F.exp(-F.avg("lp")).alias("perplexity"), F.max(F.abs(F.col("lp") - F.col("rl"))).alias("max_diff"))


def first_divergence(tokens: DataFrame, reference: str) -> DataFrame:
    """Per variant and prompt the first step whose id differs from the reference's, null where none does."""
    ref = tokens.where(F.col("variant") == reference).select("prompt", "step", F.col("id").alias("rid"))
    return tokens.join(ref, ["prompt", "step"]).groupBy("variant", "prompt").agg(F.min(F.when(F.col("id") != F.col("rid"), F.col("step"))).alias("diverges"))


def nll_comparison(pairs: DataFrame) -> DataFrame:
    """Of columns a and b: mean, 99th percentile and largest absolute difference, and correlation."""
    d = F.abs(F.col("a") - F.col("b"))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.percentile(d, F.lit(0.99)).alias("p99"), F.max(d).alias("most"), F.corr("a", "b").alias("correlation"))


def paired_medians(samples: DataFrame, reference: str) -> DataFrame:
    """Per shape and method the median seconds, and the median over rounds of the ratio of throughput to the reference's in that round."""
    ref = samples.where(F.col("method") == reference).select("shape", "round", (F.col("bytes") / F.col("seconds")).alias("base"))
    joined = samples.join(ref, ["shape", "round"]).withColumn("ratio", F.col("bytes") / F.col("seconds") / F.col("base"))
    return joined.groupBy("shape", "method").agg(F.median("seconds").alias("seconds"), F.median("ratio").alias("ratio"), F.count(F.lit(1)).alias("rounds"))


def windows(tokens: DataFrame, length: int) -> DataFrame:
    """Whole windows of a stream (idx from 0, token): win, tokens in order; what does not fill a window is left."""
    return tokens.groupBy(F.floor(F.col("idx") / length).alias("win")).agg(F.array_sort(F.collect_list(F.struct("idx", "token"))).alias("x")).where(F.size("x") == length).select("win", F.col("x.token").alias("tokens"))


def publishable(manifest: DataFrame, checks: DataFrame) -> DataFrame:
    """name and ok: no mismatch, and the commit and bytes of the manifest are those that were checked."""
    joined = manifest.alias("m").join(checks.alias("c"), "name", "left")
    return joined.select("name", (F.coalesce(F.col("c.mismatches") == 0, F.lit(False)) & F.col("m.git").eqNullSafe(F.col("c.git")) & F.col("m.bytes").eqNullSafe(F.col("c.bytes"))).alias("ok"))


def step_deltas(steps: DataFrame) -> DataFrame:
    return steps.withColumn("delta", F.col("t") - F.lag("t").over(Window.partitionBy("variant").orderBy("step")))
