"""One local session for the tests of the corpus operators, and texts that break things."""

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"

NASTY = [
    None,
    "",
    " ",
    "\n",
    "one line only of text here",
    "Common Line Here\nother\n\n  COMMON line here \t\nCommon Line Here",
    "common line here\nunique words of mine",
    "Common line here",
    "common line here\x0b",
    "a b c d e f g h i a b c d e f g h i j k l m n o p q r s t",
    "x " * 60,
    "ÀÉ straße É é nbsp words here İstanbul",
    "pipe | dollar $ # * % & < > end",
    "line\r\nline\r\nline\r\n",
    "tail space \n tail space",
    "word " * 3000 + "\n" + "more words " * 2000,
    "same text of a copy that is repeated here with some words in it to be long enough for all of the rules",
    "same text of a copy that is repeated here with some words in it to be long enough for all of the rules",
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def nasty(spark):
    """documents with extra columns whose names clash with those that operators use inside."""
    rows = [(i * 3, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), i, "x", i, "k") for i, t in enumerate(NASTY)]
    rows.append((None, "no id", "en", "s1", 5, 0, "x", 0, "k"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pos int, key string, part int, words string")


@pytest.fixture(scope="session")
def nothing(spark, nasty):
    return nasty.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect() if r.doc_id is not None}
