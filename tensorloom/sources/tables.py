"""Tables as tensors: float columns, laid out by a unique key, become rows of BF16 words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import bf16_words
from ..workers import ship

#: name, class, table, key (unique), column; a row holds the values of K successive keys.
COLUMNS = (
    ("acctbal", "mlp", "customer", "c_custkey", "c_acctbal"),
    ("retailprice", "mlp", "part", "p_partkey", "p_retailprice"),
    ("supplier_bal", "attn", "supplier", "s_suppkey", "s_acctbal"),
    ("totalprice", "attn", "orders", "o_orderkey", "o_totalprice"),
    ("event_value", "other", "events", "event_id", "value"),
)
K = 128


def tensor_rows(spark: SparkSession, sf_dir: str, with_embeddings: bool = True) -> DataFrame:
    """name, cls, r, c0 (array<int> of columns present), w (array<int> of words).

    Row arrays are the storage form: a row's values come from one shuffle by (name,
    r) and all later steps on rows need none.
    """
    ship(spark)
    out = None
    if with_embeddings:
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("embedding").isNotNull())
        out = e.select(F.lit("embeddings").alias("name"), F.lit("embed").alias("cls"), F.col("vec_id").cast("long").alias("r"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("c"), F.col("embedding").cast("array<float>").alias("x"))
    for name, cls, table, key, column in COLUMNS:
        t = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k"), F.col(column).alias("v")).where("k is not null and v is not null")
        rows = t.groupBy(F.floor(F.col("k") / K).alias("r")).agg(F.array_sort(F.collect_list(F.struct(F.pmod("k", F.lit(K)).cast("int").alias("c"), F.col("v").cast("float").alias("x")))).alias("cells"))
        rows = rows.select(F.lit(name).alias("name"), F.lit(cls).alias("cls"), F.col("r").cast("long").alias("r"), F.col("cells.c").alias("c"), F.col("cells.x").alias("x"))
        out = out.unionByName(rows) if out is not None else rows
    return out.select("name", "cls", "r", "c", bf16_words("x").alias("w"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, cls, r, c, w: a row for each weight; c counts from 0 along the row's present values."""
    return tensor_rows(spark, sf_dir).select("name", "cls", "r", F.posexplode("w").alias("c", "w"))


def _bits(column: str) -> str:
    u = f"CAST(CAST(CAST({column} AS FLOAT) AS BIT) AS INTEGER)::BIGINT & 4294967295"
    return f"((({u}) + 32767 + ((({u}) >> 16) & 1)) >> 16) & 65535"


def weights_sql() -> str:
    """The same for DuckDB: a common table expression ``weights``."""
    parts = [f"SELECT 'embeddings' AS name, 'embed' AS cls, CAST(vec_id AS BIGINT) AS r, c, CAST({_bits('x')} AS BIGINT) AS w FROM (SELECT vec_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c FROM embeddings)"]
    for name, cls, table, key, column in COLUMNS:
        parts.append(
            f"SELECT '{name}', '{cls}', CAST({key} // {K} AS BIGINT), CAST(row_number() OVER (PARTITION BY {key} // {K} ORDER BY {key}) - 1 AS BIGINT), CAST({_bits(column)} AS BIGINT) FROM {table} WHERE {key} IS NOT NULL AND {column} IS NOT NULL"
        )
    return "weights AS (" + " UNION ALL ".join(parts) + ")"
