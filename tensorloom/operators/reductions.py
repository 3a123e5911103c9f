"""Products with a declared order of float32 additions, and lookups of rows by id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import round_words
from ..workers import ship

LANES, STEP = 32, 4


def floats(words: np.ndarray) -> np.ndarray:
    return (np.asarray(words, np.uint32) << 16).view(np.float32)


def lane_dots(w: np.ndarray, x: np.ndarray, step: int = STEP, sums: int = 1) -> np.ndarray:
    """Products of rows of words (n, k) with x: 32 lanes; lane i owns ``step`` successive weights of each block of 32 * step, added in K order; then lanes i and i + 16, 8, 4, 2, 1.

    Past the end a lane adds zeros.  With two ``sums``, even and odd blocks have
    their own, added before the lanes meet.  All rows take each step together; a
    row's additions keep their order.
    """
    n, k = w.shape
    block = LANES * step
    product = np.zeros((n, -(-max(k, 1) // block) * block), np.float32)
    product[:, :k] = floats(w) * floats(x[:k])
    product = product.reshape(n, -1, LANES, step)
    lanes = np.zeros((sums, n, LANES), np.float32)
    for t in range(product.shape[1]):
        for j in range(step):
            lanes[t % sums] += product[:, t, :, j]
    lane = lanes[0]
    for more in lanes[1:]:
        lane = lane + more
    for s in (16, 8, 4, 2, 1):
        lane = lane[:, :s] + lane[:, s : 2 * s]
    return lane[:, 0]


def lane_dot(w: np.ndarray, x: np.ndarray, step: int = STEP, sums: int = 1) -> np.float32:
    """One row's product, as ``lane_dots`` adds it."""
    return lane_dots(np.asarray(w)[None, :], np.asarray(x), step, sums)[0]


def matvec(rows: DataFrame, x: list[int], step: int = STEP, sums: int = 1) -> DataFrame:
    """name, r, y (a BF16 word): each row's product with x (BF16 words), rounded once; rows of a length are worked out together."""
    ship(rows.sparkSession)
    vector = np.asarray(x, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["w"].str.len().to_numpy()
            y = np.zeros(len(batch), np.int32)
            for k in np.unique(sizes):
                at = np.flatnonzero(sizes == k)
                y[at] = round_words(lane_dots(np.stack(batch["w"].to_numpy()[at]).reshape(len(at), k), vector, step, sums))
            yield pd.DataFrame({"name": batch["name"], "r": batch["r"], "y": y})

    return rows.select("name", "r", "w").mapInPandas(run, "name string, r long, y int")


def n_per_thread(k: Column) -> Column:
    """Successive weights of a lane (``step``) for rows of k."""
    return F.when(k % 128 == 0, 4).when(k % 64 == 0, 2).otherwise(1)


def use_matvec(n: Column, k: Column) -> Column:
    """Whether a single row goes to the declared-order product: K above 64 and below 16 N."""
    return (k > 64) & (k < 16 * n)


def gemm_tile(rows: Column) -> Column:
    """Tile (bm, bn, wm, wn) of a grouped product with about so many rows a group: 64 x 64 unless a block of 64 rows would be half empty."""
    tile = lambda *x: F.struct(*[F.lit(v).alias(k) for k, v in zip(("bm", "bn", "wm", "wn"), x, strict=True)])
    return F.when(rows <= 16, tile(16, 32, 1, 2)).when((rows <= 32) | (F.ceil(rows / 64) * 64 - rows >= 32), tile(32, 64, 2, 2)).otherwise(tile(64, 64, 2, 2))


def expert_rows(slots: DataFrame, rows: DataFrame, size: int, first: int, n: int) -> DataFrame:
    """Rows ``first`` to ``first + n`` of each slot's expert, whose rows stand in blocks of ``size``: slots' columns, i (0 to n - 1), w.

    Each expert's rows are looked up once for all its slots.
    """
    wanted = slots.select("expert").distinct().select("expert", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    wanted = wanted.withColumn("r", (F.col("expert") * size + first + F.col("i")).cast("long"))
    return slots.join(wanted.join(rows.select("r", "w"), "r").drop("r"), "expert")


def block_rows(rows: DataFrame, size: int, first: int, n: int) -> DataFrame:
    """Rows ``first`` to ``first + n`` of every block of ``size``, numbered anew; a filter on r, so before decoding it saves that."""
    inside = F.col("r") % size
    return rows.where((inside >= first) & (inside < first + n)).withColumn("r", (F.floor(F.col("r") / size) * n + inside - first).cast("long"))


def log_softmax_at(values: Column, target: Column) -> Column:
    """Log-probability of the 0-based target."""
    return F.get(values, target) - log_sum_exp(values)


def fold(parts: Column) -> Column:
    """Left fold of array<float> from 0, each sum rounded to float32: the order of additions is the array's."""
    return F.aggregate(parts, F.lit(0.0).cast("float"), lambda s, p: (s + p).cast("float"))


def lookup(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows for ids (pos, id) in the order asked for, repeats included: pos, id, w; w is null for an id that no row has."""
    return ids.join(rows.select(F.col("r").alias("id"), "w"), "id", "left").select("pos", "id", "w")


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def log_sum_exp(values: Column) -> Column:
    most = F.array_max(values)
    return most + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - most)))
