"""Connected components of links between 64-bit nodes, in rounds of two star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..workers import map_arrow
from ._common import stage

#: Links (16 bytes each) that one task joins by itself; more go through the rounds.
SMALL = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links u, v to node, root: the smallest label passes over links, and labels take their label's label, until nothing changes."""
    got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if got:
        u, v = (np.concatenate(x) for x in zip(*got, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, before[a], least)
            np.minimum.at(label, before[b], least)
            label = label[label]
            if (label == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v) to (v, smallest of u and its v's) for each v, and u itself; v < u or any v, as the caller has filtered."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # Both sides are dealt by u; a broadcast would go through the driver, round after round.
    return pairs.join(least.hint("merge"), "u")


def components(links: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """node and root (the smallest node it reaches) of every node in links (a, b: bigint).

    Up to ``small`` links, counted first, are joined in one task on an executor.
    Beyond, it alternates the large-star and the small-star step until nothing changes: a
    number of rounds in the order of log squared of the nodes.  Each round's links are
    written to the shared folder, so a lost executor costs a reread and no
    lineage grows.  Minima combine map-side; the join back to a star's centre is
    one of Spark's own, which splits a centre that many nodes share.  Nothing but
    a count and a checksum of a round comes to the driver.  Null ends are left out;
    links of a node with itself give a component of one.  An empty table gives an
    empty one.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u").isNotNull() & links["a"].isNotNull() & links["b"].isNotNull())
    told = Observation()
    now = stage(ends.distinct().observe(told, F.count(F.lit(1)).alias("links")))
    if (told.get.get("links") or 0) <= small:
        return stage(map_arrow(now.repartition(1), _joined, "node long, root long"))
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(now.where("u = v")).distinct()
        star = _stars(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").unionByName(large.where("u = v")).distinct()
        told = Observation()
        now = stage(small.observe(told, F.count(F.lit(1)).alias("links"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        state = told.get
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct().groupBy("node").agg(F.min("root").alias("root"))
