"""Benchmark decontamination by word windows, with DataFrame operations only.

Each item gives windows of 13 words (a shorter item one shorter window).  The
windows' hashes, texts and items are broadcast, after a count of rows and bytes
against bounds; above them they are taken in blocks of about that size, one pass
of the documents each.  A document's windows are hashed on its own row from the hashes of its
words, looked up in the broadcast table, and a hit is verified against the
window's words inside the same join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, let, stage

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
#: What is broadcast at once: rows, and bytes of words and item names (one window with more has a block of its own).
MAX_WINDOWS, MAX_BYTES = 200_000, 64 << 20
#: Key of the row that tells a document's number of words.
MARK = 7


def plain_words(text: Column) -> Column:
    r"""array<string> of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in the text with A-Z lower-cased; null: none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def window_keys(hashes: Column, n: int) -> Column:
    """A key for each n successive elements: the hash of four of them, the first and the last among them; fewer elements: none.

    Whole windows are compared afterwards, so four words only have to make that rare.
    """
    places = sorted({0, n // 3, (2 * n) // 3, n - 1})
    return F.when(F.size(hashes) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + p) for p in places]))
    )


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """n, hash, words (joined by a space) and the sorted item_ids (strings) of each distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("words")).where((F.size("words") > 0) & F.col("item").isNotNull())
    n = F.least(F.size("words"), F.lit(width))
    windows = items.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))).alias("win"))
    return (
        windows.groupBy("n", F.array_join("win", " ").alias("words"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("hash", _key_of(F.transform(F.split("words", " "), lambda w: F.xxhash64(w)), width))
    )


def _key_of(hashes: Column, width: int) -> Column:
    """The key of a window of its own length."""
    return F.coalesce(*[F.when(F.size(hashes) == n, F.get(window_keys(hashes, n), F.lit(0))) for n in range(1, width + 1)])


def _bytes(words: Column, items: Column) -> Column:
    """What a window takes in a broadcast: its words and its items' names."""
    return F.octet_length(words) + F.aggregate(items, F.lit(0), lambda a, x: a + F.octet_length(x) + 8) + 64


def window_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, own (hash of the text), pos (0-based word), n, items: every place where a document has an item's window.

    Besides, each row of docs has one row here with n = 0 and its number of words as
    pos, so that its text is split once for all.
    """
    # Once in files: every pass reads the same windows.
    windows = stage(item_windows(benchmark, width))
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # at most `width` rows
    size = windows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_bytes(F.col("words"), F.col("items"))), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.rows // max_windows), -(-size.bytes // max_bytes))
    words = docs.select("doc_id", F.xxhash64("text").alias("own"), plain_words(F.col("text")).alias("words"))
    words = words.select("doc_id", "own", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    # A row for each length that windows have, then a row for each window: its key and place alone, with the words beside it unread.
    own_length = F.struct(F.lit(0).alias("n"), F.array(F.lit(MARK).cast("long")).alias("keys"))
    per_length = [F.struct(F.lit(n).alias("n"), window_keys(F.col("hashes"), n).alias("keys")) for n in sorted(lengths)]
    hits = None
    for block in range(blocks):
        at = words.select("doc_id", "own", "words", F.explode(F.array(*([own_length] if not block else []), *per_length)).alias("of"))
        at = at.select("doc_id", "own", "words", F.col("of.n").alias("n"), F.posexplode("of.keys").alias("pos", "key"))
        known = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).select("hash", F.col("n").alias("width"), F.col("words").alias("known"), "items")
        known = known.union(docs.sparkSession.range(1).select(F.lit(MARK).cast("long"), F.lit(0), F.lit(""), F.array().cast("array<string>")))
        same = (F.col("key") == F.col("hash")) & (F.col("n") == F.col("width"))
        # An equality would become a key of the join, and be worked out for every window; this is a condition on matches.
        own = F.array_join(F.slice("words", F.col("pos") + 1, F.col("n")), " ")
        verified = F.startswith(own, F.col("known")) & F.startswith(F.col("known"), own)
        place = F.when(F.col("n") == 0, F.size("words")).otherwise(F.col("pos"))
        found = at.join(F.broadcast(known), same & verified).select("doc_id", "own", place.alias("pos"), "n", "items")
        hits = hits.unionByName(found) if block else found
    return hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """What of each document lies in an item's window.

    docs needs doc_id and text, benchmark item_id and text.  Returns doc_id,
    n_words, n_hit (words inside windows), spans (array of start and end, words,
    0-based and half open, sorted, apart), items (sorted strings), contaminated:
    n_hit > 0 and 20 * n_hit >= n_words.

    Null texts have no words; items without words or item_id have no window; an
    empty benchmark hits nothing; an empty documents table gives an empty one.
    Rows that repeat a doc_id are judged each by its own text.  Rows with a null
    doc_id are left out.
    """
    own = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    hit = F.col("n") > 0
    # Rows of one doc_id with equal texts come together here, and apart again.
    found = (
        window_hits(own, benchmark, width, max_windows, max_bytes)
        .groupBy("doc_id", "own")
        .agg(
            F.max(F.when(~hit, F.col("pos"))).cast("long").alias("n_words"),
            F.count_if(~hit).cast("int").alias("rows"),
            F.array_sort(F.collect_set(F.when(hit, F.struct("pos", "n")))).alias("at"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
        )
    )
    found = found.select("doc_id", "n_words", "at", "items", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (
        found.withColumn("spans", F.when(F.size("at") > 0, _merged(F.col("at"))).otherwise(none))
        .select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"), "spans", "items")
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def _merged(at: Column) -> Column:
    """Spans apart from each other, of sorted (pos, n)."""

    def widest(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1)["pos"] != x["pos"]))

    def end(x: Column) -> Column:
        return x["pos"] + x["n"]

    # With one element a position, only as many elements before one as the largest n can reach it.
    def firsts(a: Column) -> Column:
        most = F.array_max(F.transform(a, lambda x: x["n"]))
        reach = lambda i: F.array_max(F.transform(F.slice(a, F.greatest(i - most + 1, F.lit(1)), F.least(i, most)), end))
        return F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (reach(i) < x["pos"]), i)), lambda i: i.isNotNull())

    def spans(a: Column, f: Column) -> Column:
        upto = lambda j: F.coalesce(F.get(f, j + 1), F.size(a))
        return F.transform(f, lambda i, j: F.struct(F.get(a, i)["pos"].alias("start"), F.array_max(F.transform(F.slice(a, i + 1, upto(j) - i), end)).alias("end")))

    return let(widest(at), lambda a: let(firsts(a), lambda f: spans(a, f)))


def remove_spans(docs: DataFrame, report: DataFrame) -> DataFrame:
    """doc_id and the plain words left of each document once the report's spans are cut out, joined by a space."""
    words = docs.select("doc_id", plain_words(F.col("text")).alias("words"))
    left = F.filter("words", lambda w, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    return words.join(report.select("doc_id", "spans"), "doc_id").select("doc_id", F.array_join(left, " ").alias("text"))
