"""From documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one
before has kept, and returns the columns of documents; the last returns what it
reads back from the token store.  Every document has a doc_id of its own; rows
without one are left out by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import decontaminate, kneser_ney, mixing, simhash, token_store
from tensorloom.llm._common import shared_dir, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted text's model is within their language's threshold."""
    kept = kneser_ney.classify(docs, _table(spark, sf_dir, "labels")).where("kept").select("doc_id")
    return docs.select(COLUMNS).join(kept, "doc_id", "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies: five-word shingles, similarity 0.8."""
    kept = simhash.near_copies(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    return docs.select(COLUMNS).join(kept, "doc_id", "left_semi")


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    kept = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select("doc_id")
    return docs.select(COLUMNS).join(kept, "doc_id", "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it: never, once or twice.

    Rows that repeat a doc_id are each taken as often as the one of them that is taken most.
    """
    copies = mixing.mix(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    return docs.select(COLUMNS).join(copies, "doc_id").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and reads it back: doc_id, start, n_tokens, ids_crc32, copy."""
    import public_tokenizers

    folder = shared_dir(spark)
    token_store.write_store(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.verify(spark, folder)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", clean_of_benchmarks),
    ("mixing sources", mixed),
    ("token-ID output", token_ids),
]

#: No stage but two can be written in SQL: XXH64 and the tokenizer are not there, and the classifier is trained.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each stage's result written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
