"""Exponent histograms of a stream of values, per window of event time (an extension: the batch operators have no such counterpart)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits


def windowed_exponents(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, ex, n of events (ts, value): tumbling windows, closed once the watermark has passed them."""
    words = events.where("value is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("w", F.element_at(bits.bf16_words(F.array(F.col("value").cast("float"))), 1))
    return words.groupBy(F.window("ts", window).alias("span"), bits.exponent(F.col("w")).alias("ex")).agg(F.count(F.lit(1)).alias("n")).select(F.col("span.start").alias("start"), "ex", "n")
