"""Reports over many tensors: classes, groups, baselines, verdicts, comparisons of maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import statistics

#: Order of the classes in a report, the least share of linear weights, and the bands of a verdict.
CLASS_ORDER = ("linear", "embed", "ple", "mm", "other")
LINEAR_SHARE = 0.9
BANDS = ((0.7, "alive"), (0.2, "speed"))


def group_keys(cls: Column, sub: Column, layer: Column) -> Column:
    """Groups that a tensor counts in: of linear ones the subclass, 'linear' and the layer; of others the class."""
    linear = F.array_compact(F.array(sub, F.lit("linear"), F.when(layer.isNotNull(), F.concat(F.lit("L"), layer.cast("string")))))
    return F.when(cls == "linear", linear).otherwise(F.array(cls))


def layer_number(group: Column) -> Column:
    """n of a group named L{n}, to sort layers as numbers."""
    return F.when(group.rlike("^L[0-9]+$"), F.substring(group, 2, 10).cast("long"))


def first_tensors(catalog: DataFrame, n: int) -> DataFrame:
    """The first n tensors by file and offset."""
    return catalog.orderBy("file", "offset").limit(n)


def classification_table(catalog: DataFrame) -> DataFrame:
    """cls, sub, tensors, params, dtypes, share, place (classes in order, then by params), largest (among the three subclasses with most).

    From a row for each tensor: cls, sub, dtype, numel.
    """
    table = catalog.groupBy("cls", "sub").agg(F.count(F.lit(1)).alias("tensors"), F.sum("numel").alias("params"), F.array_join(F.array_sort(F.collect_set("dtype")), ",").alias("dtypes"))
    order = F.array_position(F.array(*map(F.lit, CLASS_ORDER)), F.col("cls"))
    return table.select(
        "*",
        (F.col("params") / F.sum("params").over(Window.partitionBy())).alias("share"),
        F.row_number().over(Window.orderBy(order, F.desc("params"), "sub")).alias("place"),
        (F.row_number().over(Window.orderBy(F.desc("params"), "sub")) <= 3).alias("largest"),
    )


def linear_share(catalog: DataFrame) -> DataFrame:
    """One row, share: linear weights among linear and other ones."""
    of = lambda *c: F.sum(F.when(F.col("cls").isin(*c), F.col("numel")).otherwise(0))
    return catalog.agg((of("linear") / F.greatest(of("linear", "other"), F.lit(1))).alias("share"))


def guarded(catalog: DataFrame, least: float = LINEAR_SHARE) -> DataFrame:
    """The catalog; reading it raises if too few of the weights outside embeddings are linear."""
    share = linear_share(catalog).select(F.when(F.col("share") >= least, True).otherwise(F.raise_error(F.lit("too many weights are of class other")).cast("boolean")).alias("fine"))
    return catalog.crossJoin(F.broadcast(share)).where("fine").drop("fine")


def group_bits(totals: DataFrame, catalog: DataFrame) -> DataFrame:
    """grp, t, policy, tensors, numel, bits and bits_off (with a 32-bit offset for each tile), from totals (name, t, policy, numel, ntiles, code: bits of indexes, palettes and escapes)."""
    keyed = totals.join(F.broadcast(catalog.select("name", "cls", "sub", "layer")), "name").withColumn("grp", F.explode(group_keys(F.col("cls"), F.col("sub"), F.col("layer"))))
    bits = 8 * F.col("numel") + F.col("code") + 8 * F.col("ntiles")
    sums = keyed.groupBy("grp", "t", "policy").agg(F.count(F.lit(1)).alias("tensors"), F.sum("numel").alias("numel"), F.sum(bits).alias("bits"), F.sum(bits + 32 * F.col("ntiles")).alias("bits_off"))
    return sums.withColumn("bpw", F.col("bits") / F.col("numel")).withColumn("bpw_off", F.col("bits_off") / F.col("numel"))


def verdict(real: DataFrame, shuffled: DataFrame, fixed: tuple[str, ...]) -> DataFrame:
    """Of one group's rows of group_bits: best_t of policy 'best', what the real order gains there, the band, and the cheapest policies.

    Ties go to the smaller tile, then by policy name.
    """
    best = real.where("policy = 'best'").join(shuffled.where("policy = 'best'").select("t", F.col("bpw").alias("apart")), "t")
    one = best.agg(F.min_by(F.struct("t", (F.col("apart") - F.col("bpw")).alias("gain"), "bpw"), F.struct("bpw", "t")).alias("b"))
    cheap = lambda rows, name: rows.agg(F.min(F.struct("bpw", "t", "policy")).alias(name))
    gain = F.col("b.gain")
    band = F.when(gain >= BANDS[0][0], BANDS[0][1]).when(gain >= BANDS[1][0], BANDS[1][1]).otherwise("stop")
    all_in = one.crossJoin(cheap(real.where(F.col("policy").isin(*fixed)), "f")).crossJoin(cheap(real, "a"))  # one row each
    return all_in.select(F.col("b.t").alias("best_t"), gain.alias("gain"), band.alias("band"), F.col("f.policy").alias("fixed_policy"), F.col("f.t").alias("fixed_t"), F.col("f.bpw").alias("fixed_bpw"), F.col("a.policy").alias("any_policy"), F.col("a.t").alias("any_t"), F.col("a.bpw").alias("any_bpw"))


def group_baselines(hist: DataFrame, catalog: DataFrame) -> DataFrame:
    """grp, numel and bits per weight of Huffman and entropy codes: one for the group, one a layer, one a tensor."""
    kept = hist.join(F.broadcast(catalog.select("name", "cls", "sub", "layer")), "name").withColumn("grp", F.explode(group_keys(F.col("cls"), F.col("sub"), F.col("layer"))))
    block = F.coalesce(F.col("layer").cast("string"), F.lit("-"))
    scopes = F.explode(F.array(F.struct(F.lit("global").alias("scope"), F.lit("").alias("part")), F.struct(F.lit("block").alias("scope"), block.alias("part")), F.struct(F.lit("tensor").alias("scope"), F.col("name").alias("part"))))
    counts = kept.select("grp", scopes.alias("s"), "ex", "n").groupBy("grp", "s.scope", "s.part", "ex").agg(F.sum("n").alias("n"))
    keyed = counts.select(F.to_json(F.struct("grp", "scope", "part")).alias("name"), "grp", "scope", "ex", "n")
    codes = statistics.huffman_bits(keyed).withColumnRenamed("n", "size")
    entropies = statistics.entropy(keyed).select("name", (F.col("n") * F.col("h")).alias("entropy_bits"))
    each = codes.join(entropies, "name").withColumn("k", F.from_json("name", "grp string, scope string, part string")).select("k.grp", "k.scope", "size", "huffman_bits", "entropy_bits")
    at = lambda scope, what: F.sum(F.when(F.col("scope") == scope, F.col(what)).otherwise(0))
    numel = at("global", "size")
    return each.groupBy("grp").agg(
        numel.alias("numel"),
        *[(8 + at(s, "huffman_bits") / numel).alias(f"huffman_{s}") for s in ("global", "block", "tensor")],
        *[(8 + at(s, "entropy_bits") / numel).alias(f"entropy_{s}") for s in ("global", "tensor")],
    )


def weighted_means(info: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """grp, tensors, numel, and the columns' means weighted by n; groups: name, grp (several rows a name)."""
    sums = info.join(F.broadcast(groups), "name").groupBy("grp")
    return sums.agg(F.count(F.lit(1)).alias("tensors"), F.sum("n").alias("numel"), *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in columns])


def maps_differ(local: DataFrame, remote: DataFrame) -> DataFrame:
    """state ('same', 'changed', 'missing', 'extra') and n, of two maps (key, value); nulls equal nulls."""
    both = local.select("key", F.struct("value").alias("a")).join(remote.select("key", F.struct("value").alias("b")), "key", "full_outer")
    state = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def file_digests(spark, folder: str, pattern: str = "*") -> DataFrame:
    """key (path) and value (sha256) of the files of a folder, small enough each for a row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("key"), F.sha2("content", 256).alias("value"))


def permuted(i: Column, n: Column, factor: int = 48_271, shift: int = 12_345) -> Column:
    """Where place i of n goes: an affine map, one to one unless the factor (a prime) divides n; no sort, no shuffle."""
    return F.pmod(i * factor + shift, n)
