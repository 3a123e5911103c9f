"""Line deduplication, quality rules, decontamination and mixing against plain Python."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import decontaminate as dc
from tensorloom.llm import line_dedup, mixing, quality_rules, queries
from tensorloom.llm._common import looked_up

from .conftest import SF, texts

WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("which", ["nasty", "documents"])
def test_line_dedup(which, request):
    df = request.getfixturevalue(which)
    docs = texts(df)
    held = defaultdict(set)
    key = lambda line: line.strip(WS).translate(LOW)
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(d)
    want = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == d]
        want[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == want
    assert any(w[1] for w in want.values())


@pytest.mark.parametrize("which", ["nasty", "documents"])
def test_quality_counts(which, request):
    df = request.getfixturevalue(which)
    want = {}
    for d, t in texts(df).items():
        w = words(t)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if line.strip(WS):
                dup += line in seen
                seen.add(line)
        want[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))
    rows = quality_rules.quality_rules(df).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert any(w[4] for w in want.values())


def test_host_lines(spark):
    common = "a line that the host repeats on all its pages"
    own = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{own} {i}\n{common}", "h1") for i in range(30)]
    rows += [(100 + i, "\n".join([common] * 5 + [f"{own[:60]} {i}"]), "h1") for i in range(3)]
    rows += [(200 + i, f"{common}\n{own} {i}", "h2") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.lost_words, r.kept) for r in quality_rules.quality_rules(df, max_docs=10, max_share=0.1).collect()}
    assert all(got[i] == (10, True) for i in range(30))
    assert all(got[100 + i] == (50, False) for i in range(3))
    assert all(got[200 + i] == (0, True) for i in range(3))
    cut = {r.doc_id: r.text for r in quality_rules.drop_common_lines(df, max_docs=10, max_share=0.1).collect()}
    assert cut[0] == f"{own} 0" and cut[200] == f"{common}\n{own} 0"


def brute_hits(t, items):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
    w, hit, found = split(t), set(), set()
    for k, x in items:
        v = split(x)
        n = min(13, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(k))
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontaminate(spark, documents, nasty, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:10]
    items += [(100, None), (101, "..."), (102, "Same text of; a COPY"), (11, "word"), (103, "w word"), (104, "rules"), (105, "word word more")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for df in (documents, nasty):
        got = {r.doc_id: r for r in dc.decontaminate(df, bench, max_windows=block).collect()}
        docs = texts(df)
        assert got.keys() == docs.keys()
        for d, t in docs.items():
            n, hit, found = brute_hits(t, items)
            r = got[d]
            assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (n, len(hit), found, len(hit) > 0 and 20 * len(hit) >= n)
            assert {j for s in r.spans for j in range(s.start, s.end)} == hit
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_decontaminate_empty(spark, nasty, nothing):
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert dc.decontaminate(nothing, bench).count() == 0
    assert {r.n_hit for r in dc.decontaminate(nasty, bench.where("false")).collect()} == {0}
    report = dc.decontaminate(nasty, spark.createDataFrame([(1, "common line")], "item_id long, text string"))
    left = {r.doc_id: r.text for r in dc.remove_spans(nasty, report).collect()}
    assert left[18] == "here unique words of mine"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("which", ["nasty", "documents"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    rows = mixing.mix(df).collect()
    docs = {r.doc_id: (r.source, len(words(r.text))) for r in df.collect() if r.doc_id is not None}
    sizes = Counter()
    for s, n in docs.values():
        sizes[s] += n
    want = brute_targets(sizes)
    assert {r.doc_id: (r.source, r.size, r.source_size) for r in rows} == {d: (s, n, sizes[s]) for d, (s, n) in docs.items()}
    copies = defaultdict(int)
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.copies in (math.floor(rate), math.ceil(rate)) and r.taken == r.copies * r.size <= 2 * r.size
        copies[r.source] += r.copies
    for s, n in Counter(s for s, _ in docs.values()).items():
        assert abs(copies[s] - n * (want[s] / sizes[s] if sizes[s] else 0)) <= 1
    again = mixing.mix(df.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}


@pytest.mark.parametrize("which", ["nasty", "documents"])
def test_mixing_sql(spark, which, request, tmp_path):
    df = request.getfixturevalue(which)
    df.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.OP10_SQL})").fetchall()
    got = [tuple(r) for r in queries.op10_mixing(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == df.where("doc_id is not null").count()


def test_mixing_near_target(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    for r in got:
        assert abs(r.taken - r.target) <= max(r.most, 0.02 * r.target)


def test_empty(nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert quality_rules.quality_rules(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0




REPEATED = [
    (1, "a common line of the host\nsome own words", "h"),
    (1, "a common line of the host\nsome own words", "h"),
    (1, "another text of the same document", "h"),
    (2, "a common line of the host\nmore own words here", "h"),
    (2, None, "h"),
    (2, None, "h"),
]


def repeated(spark):
    return spark.createDataFrame(REPEATED, "doc_id long, text string, source string")


def test_repeated_rows_lines(spark):
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(repeated(spark)).collect())
    assert got == sorted([*[(1, 2, 0, REPEATED[0][1])] * 2, (1, 1, 0, REPEATED[2][1]), (2, 2, 1, "more own words here"), (2, 1, 0, ""), (2, 1, 0, "")])


def test_repeated_rows_quality(spark):
    got = sorted((r.doc_id, r.n_words, r.lost_words) for r in quality_rules.quality_rules(repeated(spark), max_docs=1, max_share=0.1).collect())
    assert got == [(1, 6, 0), (1, 9, 6), (1, 9, 6), (2, 0, 0), (2, 0, 0), (2, 10, 6)]


def test_repeated_rows_contamination(spark):
    bench = spark.createDataFrame([("q", "some own words")], "item_id string, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in dc.decontaminate(repeated(spark), bench).collect())
    assert got == [(1, 6, 0, False), (1, 9, 3, True), (1, 9, 3, True), (2, 0, 0, False), (2, 0, 0, False), (2, 10, 0, False)]


def test_contamination_by_bytes(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(10)
    key = lambda rows: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows)
    assert key(dc.decontaminate(documents, bench).collect()) == key(dc.decontaminate(documents, bench, max_bytes=20_000).collect())


def test_repeated_rows_mixing(spark):
    rows = mixing.mix(repeated(spark)).collect()
    assert len(rows) == len(REPEATED) and sum(r["size"] for r in rows) == rows[0].source_size


def test_hot_keys(spark, documents):
    """Keys over the broadcast's bound are shuffled, hot ones never: the rows are the same."""
    table = spark.createDataFrame([(k, f"v{k}", 1000 if k == 1 else 2) for k in range(40)], "k long, v string, n long")
    rows = spark.createDataFrame([(i, 1 if i % 3 else None if i % 2 else i) for i in range(300)], "i long, k long")
    want = sorted(((i, k, f"v{k}" if k is not None and k < 40 else None) for i, k in ((i, 1 if i % 3 else None if i % 2 else i) for i in range(300))), key=lambda x: x[0])
    for most, size, most_bytes in ((100, None, 1), (5, None, 1), (100, F.length("v"), 20)):
        got = looked_up(rows, table, ["k"], "n", most, size, most_bytes).select("i", "k", "v").collect()
        assert sorted(map(tuple, got), key=lambda x: x[0]) == want
    lines = lambda most: sorted(map(tuple, line_dedup.dedup_lines(documents, most=most).collect()))
    assert lines(3) == lines(100_000)
    kept = lambda most: sorted((r.doc_id, r.lost_words) for r in quality_rules.quality_rules(documents, max_docs=2, max_share=0.001, most=most).collect())
    assert kept(3) == kept(100_000)
