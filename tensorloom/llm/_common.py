"""Small pieces that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    A string with as many bytes as characters is ASCII, where lower() does the
    same and is faster.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_words(text: Column) -> Column:
    r"""array<string> of ``[^\x20\x09-\x0D]+``; null and blank texts give an empty array."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that the cluster shares.

    ``spark.checkpoint.dir`` names that folder.  Where it is unset on one machine
    (master local, as in tests) a temporary folder is chosen and set, once; on a
    cluster that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="tensorloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tensorloom-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage in a way that survives lost executors, and the rows
    keep their values on every later read.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """What an operator stages for itself: it is deleted when the ``with`` block ends, and shuffles' files already when their query ends.

    Nothing that is read later may depend on it.
    """

    FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folders: list[str] = []
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(self.FREED, None)
        self.spark.conf.set(self.FREED, "true")
        return self

    def folder(self) -> str:
        self.folders.append(shared_dir(self.spark))
        return self.folders[-1]

    def stage(self, df: DataFrame) -> DataFrame:
        return stage(df, self.folder())

    def stage_by(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """As ``stage``, in buckets by a key: a join with rows dealt out by ``repartition(buckets, key)`` does not move these rows."""
        self.tables.append(f"tensorloom_{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").option("path", self.folder()).bucketBy(buckets, key).saveAsTable(self.tables[-1], format="parquet")
        return self.spark.table(self.tables[-1])

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(self.FREED)
        else:
            self.spark.conf.set(self.FREED, self.before)
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in self.folders:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and no others, so that extra columns can't clash with an operator's own."""
    return docs.select(*columns)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


#: Rows that are broadcast at most, and bytes of their strings.
MOST_ROWS, MOST_BYTES = 100_000, 32 << 20


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, most: int = MOST_ROWS, size: Column | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows, with the other columns of the table's row that has the same keys (each once there), or nulls.

    No key meets in one task, however many rows have it.  ``weight`` is a column of
    the table, the rows that a key has.  A table of at most ``most`` rows and
    ``most_bytes`` (the sum of ``size``, where keys or values vary in length) is
    broadcast.  Of a larger one that is done with the keys of over 1/most of all
    weight, which are fewer than ``most`` by that; rows that those serve, or that
    have a null key, are dealt out at random, and the others shuffled by their keys.
    """
    table = stage(table)
    carried = [c for c in table.columns if c not in (*keys, weight)]
    total = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("weight"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).alias("bytes")).first()
    if total.n <= most and total.bytes <= most_bytes:
        return rows.join(F.broadcast(table.drop(weight)), keys, "left")
    per_row = total.bytes / total.n
    floor = max(total.weight / most, total.weight * per_row / most_bytes)
    of = [F.col(k).alias(f"_{k}") for k in keys]
    hot = table.where(F.col(weight) > floor).select(*of, F.struct(F.lit(1).alias("_in"), *carried).alias("_hot"))
    cold = table.where(F.col(weight) <= floor).select(*of, F.lit(0).cast("long").alias("_none"), F.struct(F.lit(1).alias("_in"), *carried).alias("_cold"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    flagged = rows.join(F.broadcast(hot), same, "left").drop(*[f"_{k}" for k in keys])
    away = F.col("_hot").isNotNull()
    for k in keys:
        away = away | F.col(k).isNull()
    dealt = flagged.withColumn("_salt", F.when(away, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).otherwise(0))
    met = dealt.join(cold.hint("merge"), same & (F.col("_salt") == F.col("_none")), "left")
    got = F.coalesce("_hot", "_cold")
    return met.select(*rows.columns, *[got[c].alias(c) for c in carried])
