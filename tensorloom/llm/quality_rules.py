"""Quality rules with DataFrame operations only: counts within a text, and lines that a host repeats.

The counts within a text are array expressions on its own row, so nothing is
shuffled for them.  For lines across documents only (host, 128-bit key, document)
is shuffled, and after the map-side combine only once per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import MOST_ROWS, SPACES, ascii_lower, let, looked_up, text_words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many words lie in n-word windows that the text has twice or more, the first included."""
    return F.aggregate(
        F.transform(repeated_starts(words, n), lambda p: F.struct(p.alias("p"))),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-n).alias("last")),
        lambda a, x: F.struct((a["sum"] + F.least(F.lit(n), x["p"] - a["last"])).cast("long").alias("sum"), x["p"].alias("last")),
        lambda a: a["sum"],
    )


def repeated_starts(words: Column, n: int) -> Column:
    """Sorted starts of windows found at least twice; computed from hashes of words, so that each word is hashed once."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda hs: _starts(hs, n))


def _starts(hs: Column, n: int) -> Column:
    none = F.array().cast("array<int>")
    windows = F.when(F.size(hs) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(hs) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hs, i, n)))
    )
    return let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), none).otherwise(_twice(ws)))


def _twice(ws: Column) -> Column:
    """Positions of the values that ws holds at least twice: after a sort equal values are neighbours."""
    ordered = F.array_sort(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        keep = F.filter(
            F.transform(s, lambda x, i: F.when(((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])), x["p"])),
            lambda p: p.isNotNull(),
        )
        return F.array_sort(keep)

    return let(ordered, repeated)


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text has no words.  n_dup_lines counts lines that have a word and
    equal an earlier line of the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", *keep, text.alias("text")).withColumn("words", text_words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    counted = counted.select(
        "doc_id",
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def row_key(host: str | None) -> Column:
    """Tells rows of one doc_id apart that differ in text or host."""
    return F.xxhash64("text", *([host] if host else []))


def host_lines(docs: DataFrame, host: str, max_docs: int, max_share: float, min_chars: int, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, own (see row_key) and lost_words: how many words it has in lines that too many documents of its host hold.

    A line is over the limit if more than max_docs documents of its host hold it
    and they are more than max_share of the host's documents.  A null host is a
    host of its own.  Of rows that are equal the words add up.
    """
    host_key = F.coalesce(F.xxhash64(host), F.lit(0)) if host else F.lit(0)
    lines = docs.select("doc_id", row_key(host).alias("own"), host_key.alias("host"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    key = ascii_lower(F.trim("line", F.lit(SPACES)))
    # Per document and key once, with its words: a groupBy whose partial step sees whole documents, as a document is one row.
    per_doc = (
        lines.withColumn("key", key)
        .where(F.char_length("key") >= min_chars)
        .select("host", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), "doc_id", "own", F.size(F.split("key", r"[\x20\x09-\x0D]+")).alias("n"))
        .groupBy("doc_id", "own", "host", "k1", "k2")
        .agg(F.sum("n").alias("n"))
    )
    hosts = docs.groupBy(host_key.alias("host")).agg(F.count(F.lit(1)).alias("host_docs"))
    common = (
        per_doc.groupBy("host", "k1", "k2")
        .agg(F.count(F.lit(1)).alias("holders"))
        .where(F.col("holders") > max_docs)
        .join(hosts, "host")
        .where(F.col("holders") > max_share * F.col("host_docs"))
        .select("host", "k1", "k2", "holders", F.lit(True).alias("over"))
    )
    return looked_up(per_doc, common, ["host", "k1", "k2"], "holders", most).where("over").groupBy("doc_id", "own").agg(F.sum("n").alias("lost_words"))


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = 20, max_share: float = 0.002, min_chars: int = 10, max_lost: float = 0.5, most: int = MOST_ROWS) -> DataFrame:
    """The base rules of a text, and the host's line frequency: a document that loses too much to common lines goes.

    docs needs doc_id, text and the column named by host; others are ignored.
    Returns doc_id, the counts of text_counts, lost_words (words in lines over
    the host's limit), kept.  A document is depleted, and not kept, if over
    max_lost of its words are in such lines or fewer than 20 words are left.
    Null texts have no words and fail the base rules; a null host is one host.
    Rows that repeat a doc_id are judged each by its own text; those that are equal
    count as one holder of their lines.  Rows with a null doc_id are left out; an
    empty table gives an empty table.
    """
    own = docs.select("doc_id", "text", F.col(host).alias("host")).where(F.col("doc_id").isNotNull())
    counts = text_counts(own.withColumn("own", row_key("host")), "own")
    lost = host_lines(own, "host", max_docs, max_share, min_chars, most)
    left = F.col("n_words") - F.col("lost_words")
    equal = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "own"))
    return (
        counts.join(lost, ["doc_id", "own"], "left")
        .withColumn("lost_words", (F.coalesce("lost_words", F.lit(0)) / equal).cast("long"))
        .drop("own")
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words")) & (left >= 20))
    )


def drop_common_lines(docs: DataFrame, host: str = "source", max_docs: int = 20, max_share: float = 0.002, min_chars: int = 10) -> DataFrame:
    """doc_id and text without the lines that are over the host's limit (see host_lines)."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.xxhash64(host), F.lit(0)).alias("host")).where(F.col("doc_id").isNotNull()).withColumn("own", row_key("host"))
    lines = own.select("doc_id", "own", "host", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", ascii_lower(F.trim("line", F.lit(SPACES))))
    keyed = lines.where(F.char_length("key") >= min_chars).select("doc_id", "own", "pos", "host", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))
    hosts = own.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    common = (
        keyed.select("doc_id", "own", "host", "k1", "k2")
        .distinct()
        .groupBy("host", "k1", "k2")
        .agg(F.count(F.lit(1)).alias("holders"))
        .where(F.col("holders") > max_docs)
        .join(hosts, "host")
        .where(F.col("holders") > max_share * F.col("host_docs"))
        .select("host", "k1", "k2", "holders", F.lit(True).alias("over"))
    )
    gone = looked_up(keyed, common, ["host", "k1", "k2"], "holders").where("over").groupBy("doc_id", "own").agg(F.collect_set("pos").alias("gone"))
    kept = F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))), lambda i: F.get(F.col("lines"), i)), "\n")
    return own.join(gone, ["doc_id", "own"], "left").withColumn("lines", F.split("text", "\n", -1)).select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
