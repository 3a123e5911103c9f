"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Per source every document expects the same number of copies (target over size).
Running sums of these, plus one random offset per source, give a document a copy
for each integer boundary that its step crosses.  Documents are laid out by
source and size, so each stretch of similar sizes gets its share of copies and the
words taken come near the target.  The running sum has two levels: counts per
range partition, then positions inside it, so no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stage, text_words

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of each source, from source and source_size.

    Sources by code point, null last, take the weights in turn.  Shares by weight
    of share * all sizes that exceed most * the source's size stop there, and the
    excess is shared anew by weight, until none is above.  That process fixes a
    level: a source stops if its ratio of limit to weight is below it.  So the
    sources are sorted by that ratio, and running sums tell where the level lies.
    The table has a row per source and no more.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = named.withColumn("level", level).withColumn("stops", F.col("limit") <= F.col("weight") * F.col("level"))
    # The level that holds is that of the first source which does not stop; where all stop, none is needed.
    held = F.min(F.when(~F.col("stops"), F.struct((F.col("limit") / F.col("weight")).alias("r"), "level"))).over(whole)["level"]
    return leveled.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(F.col("weight") * held).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, the same in every run: 52 bits of the md5 of the seed and the source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    r"""How many copies of each document the mix takes.

    docs needs doc_id, text, source.  Returns doc_id, source, size,
    source_size, target, copies, taken (copies * size).  The size of a document
    is its number of ``[^\x20\x09-\x0D]+``; null and blank texts have size 0, take
    part in the running sums and weigh nothing.  A null source is a source, the
    last.  A source without words has target 0 and no copies.  Ties in size go by
    doc_id.  Rows that repeat a doc_id are documents of their own, taken each for
    itself.  Rows with a null doc_id are left out; an empty table gives an empty
    one.
    """
    # Staged first: the range bounds are sampled from sizes, not from texts split a second time.
    sized = stage(docs.select("doc_id", "source", F.size(text_words(F.col("text"))).cast("long").alias("size")).where(F.col("doc_id").isNotNull()))
    sized = stage(
        sized.repartitionByRange(F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"))
        .sortWithinPartitions(F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"))
        .withColumn("part", F.spark_partition_id())
    )
    # Staged, the partition numbers stay what they were: the sampled range bounds are not drawn again.
    parts = sized.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("part_size"))
    so_far = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("rows_before", F.coalesce(F.sum("rows").over(so_far), F.lit(0)))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").cast("long").alias("source_size")), weights, share, most)
    targets = targets.withColumnRenamed("source", "of")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    steps = parts.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("part").alias("of_part"), "of", "rows_before", "source_size", "target", step.alias("step"), offset(F.col("of"), seed).alias("offset")
    )
    at = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id"))
    placed = sized.withColumn("at", at)
    joined = placed.join(steps, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of")))
    upto = F.col("rows_before") + F.col("at")
    copies = F.floor(upto * F.col("step") + F.col("offset")) - F.floor((upto - 1) * F.col("step") + F.col("offset"))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
