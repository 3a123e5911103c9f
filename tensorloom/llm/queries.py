"""The driver's queries over the operators of this package: digests of what they return, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as contamination
from . import katz, kneser_ney, licenses, line_dedup, mixing, quality_rules, repeats, simhash, token_store
from ._common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.verify(spark, folder)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path of their own: theirs is /source/lang/doc_id.txt."""
    docs = table(spark, sf_dir, "documents")
    place = F.concat(F.lit("/"), F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return licenses.scan(docs.select("doc_id", place.alias("path"), "text"), "doc_id").select(
        "doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", F.col("source").alias("license_source"), "licensed_by"
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL) s),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM lines),
held AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT k.*, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS lost FROM keyed k LEFT JOIN held h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN lost THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

OP4_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, source, {_WORDS} AS words FROM documents WHERE doc_id IS NOT NULL),
windows AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 8], ' ') AS win FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 7, 0))) AS i FROM docs) w),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) q WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice CROSS JOIN range(8) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, coalesce(source, chr(0)) AS host, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE trim(line, {_SPACES}) <> '' GROUP BY doc_id),
keyed AS (SELECT doc_id, host, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM lines),
long AS (SELECT doc_id, host, key, len(regexp_extract_all(key, '[^\\x20\\x09-\\x0D]+')) AS n FROM keyed WHERE length(key) >= 10),
hosts AS (SELECT coalesce(source, chr(0)) AS host, count(*) AS host_docs FROM docs GROUP BY 1),
common AS (SELECT l.host, l.key FROM (SELECT host, key, count(DISTINCT doc_id) AS holders FROM long GROUP BY host, key) l JOIN hosts h ON h.host = l.host WHERE l.holders > 20 AND l.holders > 0.002 * h.host_docs),
lost AS (SELECT l.doc_id, sum(l.n) AS lost_words FROM long l JOIN common c ON c.host = l.host AND c.key = l.key GROUP BY l.doc_id),
base AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
  FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN dups u ON u.doc_id = d.doc_id LEFT JOIN lost t ON t.doc_id = d.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_words <= 0.5 * n_words AND n_words - lost_words >= 20 AS kept FROM base"""

OP7_SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents WHERE doc_id IS NOT NULL),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, n, array_to_string(words[i + 1 : i + n], ' ') AS win FROM (SELECT item, words, n, unnest(range(len(words) - n + 1)) AS i FROM (SELECT *, least(len(words), 13) AS n FROM items WHERE len(words) > 0) a) b),
places AS (SELECT d.doc_id, n, unnest(range(greatest(len(words) - n + 1, 0))) AS i, words FROM docs d CROSS JOIN (SELECT DISTINCT n FROM wins) s),
hits AS (SELECT a.doc_id, a.i, a.n, w.item FROM (SELECT doc_id, n, i, array_to_string(words[i + 1 : i + n], ' ') AS win FROM places) a JOIN wins w ON w.n = a.n AND w.win = a.win),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits CROSS JOIN range(13) r(k) WHERE k < n GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id"""

OP10_SQL = f"""
WITH docs AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents WHERE doc_id IS NOT NULL),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS most FROM docs GROUP BY source),
named AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM sources),
leveled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM named WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT arg_min(level, most / weight) AS level FROM leveled WHERE most > weight * level),
targets AS (SELECT source, source_size, CASE WHEN l.most <= l.weight * l.level THEN l.most ELSE l.weight * h.level END AS target FROM leveled l CROSS JOIN held h),
steps AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step,
  CAST(CAST('0x' || substr(md5('42:' || coalesce('s' || source, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS start FROM targets),
placed AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.step, s.start, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS upto
  FROM docs d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(floor(upto * step + start) - floor((upto - 1) * step + start) AS BIGINT) * size AS taken FROM placed"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_licenses": op5_licenses,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_repeats": op8_repeats,
    "op9_katz": op9_katz,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op7_decontamination": OP7_SQL, "op10_mixing": OP10_SQL}
