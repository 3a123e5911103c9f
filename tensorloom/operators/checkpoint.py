"""Whole checkpoints: folders of safetensors files packed into tables, and back to the same bytes.

A packed checkpoint is a folder of Parquet tables:

* ``files``  file, header (its bytes as they were, length in front).
* ``catalog``  the tensors: name, dtype, shape, file, offset, and form ('v1', 'v2', or
  'copy' for those that are not packed).
* ``packed``  name, r and the parts of the format, for each row of a packed tensor.
* ``copied``  name, piece, data of the others, some MB a piece.
* ``histograms``  name, hist: what ranks are told by.
* ``manifest``  name, form, numel, bits: the tensor's parts as stored.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..sources import safetensors
from ..workers import ship
from . import codecs

PIECE = 4 << 20


def headers(folder: str) -> list[tuple[str, bytes]]:
    """Each file's first bytes up to its data."""
    out = []
    for file in safetensors.shard_files(folder):
        with open(os.path.join(folder, file), "rb") as f:
            length = f.read(8)
            out.append((file, length + f.read(struct.unpack("<Q", length)[0])))
    return out


def pieces(spark: SparkSession, catalog: DataFrame, folder: str, piece: int = PIECE) -> DataFrame:
    """name, piece, data: the bytes of the catalog's tensors as they stand in their files, read where a task wants them."""
    ship(spark)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("nbytes") - 1, F.lit(0)), F.lit(piece).cast("long"))
    listed = catalog.where("nbytes > 0").select("name", "file", "offset", "nbytes", F.posexplode(starts).alias("piece", "begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                with open(os.path.join(folder, x["file"]), "rb") as f:
                    f.seek(x["offset"] + x["begin"])
                    data = f.read(min(piece, x["nbytes"] - x["begin"]))
                yield pa.RecordBatch.from_pydict({"name": [x["name"]], "piece": [x["piece"]], "data": [data]}, schema=pa.schema([("name", pa.string()), ("piece", pa.int64()), ("data", pa.binary())]))

    count = max(1, listed.count())
    return listed.repartition(min(count, 10_000), "name", "piece").mapInArrow(run, "name string, piece long, data binary")


def chosen() -> Column:
    """Which tensors are packed, by their class and shape."""
    kind = classify.classify(F.col("name"), F.col("shape"), F.col("dtype"))
    return classify.packable(kind["cls"], F.col("shape"), F.col("dtype"))


def pack_model(spark: SparkSession, folder: str, into: str, form: str = "v1", packed: Column | None = None) -> DataFrame:
    """Packs the checkpoint in ``folder`` into tables below ``into`` and returns the manifest.

    ``packed`` says which tensors of the catalog are coded (BF16 ones only); without
    it ``chosen`` does.  The others are copied byte by byte.
    """
    of = safetensors.catalog(spark, folder)
    rule = (chosen() if packed is None else packed) & (F.col("dtype") == "BF16") & (F.col("numel") > 0)
    of.withColumn("form", F.when(rule, F.lit(form)).otherwise("copy")).write.parquet(f"{into}/catalog")
    catalog = spark.read.parquet(f"{into}/catalog")
    spark.createDataFrame(headers(folder), "file string, header binary").write.parquet(f"{into}/files")
    coded = catalog.where(F.col("form") == form)
    rows = safetensors.read(spark, folder).join(F.broadcast(coded.select("name")), "name", "left_semi")
    codecs.histograms(rows).write.parquet(f"{into}/histograms")
    hists = spark.read.parquet(f"{into}/histograms")
    codecs.pack(rows, form, hists).write.parquet(f"{into}/packed")
    pieces(spark, catalog.where("form = 'copy'"), folder).write.parquet(f"{into}/copied")
    parts = spark.read.parquet(f"{into}/packed")
    extra = F.length("esc") * 8 if form == "v1" else F.lit(32)
    size = parts.groupBy("name").agg((F.sum(8 * F.length("raw") + 8 * F.length("meta") + 8 * F.length("words") + extra) + 2048).cast("long").alias("coded"))
    manifest = catalog.join(size, "name", "left").select("name", "form", "numel", F.coalesce("coded", 8 * F.col("nbytes")).cast("long").alias("bits"))
    manifest.write.parquet(f"{into}/manifest")
    return spark.read.parquet(f"{into}/manifest")


def unpacked_rows(spark: SparkSession, packed: str) -> DataFrame:
    """name, r, w of the coded tensors."""
    catalog = spark.read.parquet(f"{packed}/catalog").where("form <> 'copy'")
    form = catalog.select("form").distinct().collect()  # one form a checkpoint
    if not form:
        return spark.createDataFrame([], "name string, r long, w array<int>")
    return codecs.unpack(spark.read.parquet(f"{packed}/packed"), spark.read.parquet(f"{packed}/histograms"), form[0].form)


def tensor_rows(spark: SparkSession, packed: str, name: str, begin: int = 0, end: int | None = None) -> DataFrame:
    """Rows begin to end of one coded tensor: a row decodes alone, so only these are read."""
    catalog = spark.read.parquet(f"{packed}/catalog").where(F.col("name") == name).first()
    if catalog is None or catalog.form == "copy":
        raise KeyError(f"{name} is not a packed tensor")
    rows = spark.read.parquet(f"{packed}/packed").where((F.col("name") == name) & (F.col("r") >= begin))
    rows = rows if end is None else rows.where(F.col("r") < end)
    return codecs.unpack(rows, spark.read.parquet(f"{packed}/histograms").where(F.col("name") == name), catalog.form)


def unpack_model(spark: SparkSession, packed: str, folder: str) -> DataFrame:
    """Writes the checkpoint's files again, the same bytes under the same names; returns file and bytes.  A task streams a file."""
    ship(spark)
    os.makedirs(folder, exist_ok=True)
    catalog = spark.read.parquet(f"{packed}/catalog")
    to_bytes = F.pandas_udf(_row_bytes, "binary")
    rows = unpacked_rows(spark, packed).select("name", F.col("r").alias("piece"), to_bytes("w").alias("data"))
    data = rows.unionByName(spark.read.parquet(f"{packed}/copied"))
    placed = data.join(F.broadcast(catalog.select("name", "file", "offset")), "name").select("file", "offset", "piece", "data")
    # A file's header comes first: it stands before all offsets.
    tops = spark.read.parquet(f"{packed}/files").select("file", F.lit(-1).cast("long").alias("offset"), F.lit(0).cast("long").alias("piece"), F.col("header").alias("data"))
    ordered = placed.unionByName(tops).repartition("file").sortWithinPartitions("file", "offset", "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = ((f, d) for b in batches for f, d in zip(b["file"], b["data"], strict=True))
        for file, own in groupby(flat, key=lambda x: x[0]):
            part = os.path.join(folder, f".{file}.{os.getpid()}")
            with open(part, "wb") as out:
                for _, d in own:
                    out.write(d)
                size = out.tell()
            os.replace(part, os.path.join(folder, file))
            yield pd.DataFrame({"file": [file], "bytes": [size]})

    done = ordered.select("file", "data").mapInPandas(run, "file string, bytes long").collect()  # a row for each file
    return spark.createDataFrame(done, "file string, bytes long")


def _row_bytes(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for rows in arrays:
        yield pd.Series([np.asarray(w).astype("<u2").tobytes() for w in rows])


def catalogs_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """name and side ('missing': only left has it; 'extra': only right; 'changed': dtype or shape differ)."""
    a = left.select("name", F.struct("dtype", "shape").alias("a"))
    b = right.select("name", F.struct("dtype", "shape").alias("b"))
    side = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "name", "full_outer").select("name", side.alias("side")).where("side is not null")


def class_bits(manifest: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, tensors, numel, bits, bits_per_weight; and a row 'all'.  classes: name, cls."""
    keyed = manifest.join(classes, "name").withColumn("cls", F.explode(F.array("cls", F.lit("all"))))
    sums = keyed.groupBy("cls").agg(F.count(F.lit(1)).alias("tensors"), F.sum("numel").alias("numel"), F.sum("bits").alias("bits"))
    return sums.withColumn("bits_per_weight", F.col("bits") / F.col("numel"))
