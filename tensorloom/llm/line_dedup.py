"""Line deduplication across documents, with DataFrame operations only.

Lines are exploded into 128-bit keys; per key only the smallest and the largest
document are aggregated (both combine map-side, so a line that every document
holds costs one row per task), which tells whether two documents hold it and who
keeps it.  What comes back to a document is the positions it loses, never the
lines of others, and the text is put together again by position.  Keys that very
many lines have are looked up by broadcast, so none of them fills one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import MOST_ROWS, SPACES, ascii_lower, looked_up, only


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, most: int = MOST_ROWS) -> DataFrame:
    """Drops lines whose key is held by at least two documents, but in the smallest doc_id.

    docs needs doc_id and text; other columns are ignored, whatever their names.
    Returns doc_id, n_lines, n_dropped, text.  ``most`` bounds what is broadcast.

    A null or empty text is one empty line, and is returned as ''.  Keys shorter
    than ``min_chars`` code points never count.  A line that one document repeats
    but no other holds stays as often as it occurs; the smallest holder keeps all
    its copies.  Rows that repeat a doc_id are parts of one document, each with a
    result of its own: they take no lines from each other.  Rows with a null doc_id
    are left out: they name no document.
    An empty table gives an empty table.
    """
    base = only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("own", F.xxhash64("text"))
    lines = base.select("doc_id", "own", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = (
        lines.select("doc_id", "own", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "own", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))
    )
    held = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("keeper < last").drop("last")
    # Rows are told apart by doc_id and text: those that are equal in both lose the same.
    lost = (
        looked_up(keyed, held, ["k1", "k2"], "n", most)
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "own")
        .agg(F.collect_set("pos").alias("lost"))
    )
    lines_of = F.split("text", "\n", -1)
    return (
        base.join(lost, ["doc_id", "own"], "left")
        .withColumn("lost", F.array_sort("lost"))
        .select(
            "doc_id",
            F.size(lines_of).cast("long").alias("n_lines"),
            F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(_without(lines_of, F.col("lost")), "\n")).alias("text"),
        )
    )


def _without(items: Column, lost: Column) -> Column:
    """items but those at the sorted 0-based positions in lost: slices between one lost position and the next."""
    n = F.size(lost)
    before = F.transform(
        lost,
        lambda p, i: F.slice(items, F.when(i == 0, 1).otherwise(F.element_at(lost, F.greatest(i, F.lit(1))) + 2), p - F.when(i == 0, 0).otherwise(F.element_at(lost, F.greatest(i, F.lit(1))) + 1)),
    )
    rest = F.slice(items, F.element_at(lost, n) + 2, F.size(items) - F.element_at(lost, n) - 1)
    return F.concat(F.flatten(before), rest)
