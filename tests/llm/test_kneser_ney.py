"""Modified Kneser-Ney: normalisation, a plain evaluation, the classifier's decisions."""

import math
import os
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import kneser_ney as kn
from tensorloom.llm.packed import pack, pack_words, unpack, unpack_words

from .conftest import SF

TEXTS = ["the cat sat on the mat", "the dog sat on the cat", "a cat and a dog", "the mat", "", None, "on the mat the cat sat on the mat"]


class Brute:
    """Interpolated probabilities straight from counts of tuples."""

    def __init__(self, texts):
        lines = [["<s>", "<s>", *(t or "").lower().split(), "</s>"] for t in texts]
        self.c3 = Counter(tuple(x[i - 2 : i + 1]) for x in lines for i in range(2, len(x)))
        c2, before = Counter(), defaultdict(set)
        for (a, b, c), n in self.c3.items():
            if b == "<s>":
                c2[b, c] += n  # only a start stands before
            else:
                before[b, c].add(a)
        self.c2 = Counter(c2) + Counter({k: len(v) for k, v in before.items()})
        self.c1 = Counter()
        for _, c in self.c2:
            self.c1[c] += 1
        self.v = len({w for x in lines for w in x} - {"<s>"}) + 1
        self.d = [kn.discounts(np.array(list(c.values()))) for c in (self.c1, self.c2, self.c3)]

    def p(self, counts, d, context, w, lower):
        total = sum(n for k, n in counts.items() if k[:-1] == context)
        if not total:
            return lower
        n = counts.get((*context, w), 0)
        left = sum(d[min(m, 3)] for k, m in counts.items() if k[:-1] == context) / total
        return max(n - d[min(n, 3)], 0) / total + left * lower

    def prob(self, a, b, c):
        one = Counter({(k,): n for k, n in self.c1.items()})
        p1 = self.p(one, self.d[0], (), c, 1 / self.v)
        p2 = self.p(self.c2, self.d[1], (b,), c, p1)
        return self.p(self.c3, self.d[2], (a, b), c, p2)


@pytest.mark.parametrize("again", [False, True])
def test_probabilities(again):
    model, brute = kn.train(TEXTS), Brute(TEXTS)
    if again:
        model = kn.Model.from_bytes(model.to_bytes())
    tests = [*TEXTS, "unknown words here", "the the the", "cat unknown sat on"]
    got, n = kn.log_probabilities(model, pa.array(tests, pa.large_string()))
    for t, g, k in zip(tests, got, n, strict=True):
        x = ["<s>", "<s>", *(w if w in brute.c1 else "?" for w in (t or "").lower().split()), "</s>"]
        want = sum(math.log(brute.prob(*x[i - 2 : i + 1])) for i in range(2, len(x)))
        assert k == len(x) - 3 and math.isclose(g, want, rel_tol=1e-5)
    words = [*brute.c1, "?"]
    for a, b in (("<s>", "<s>"), ("on", "the"), ("the", "cat"), ("?", "the"), ("?", "?")):
        assert math.isclose(sum(brute.prob(a, b, c) for c in words), 1)


def test_decisions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = kn.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.99 and share[0] < 0.5


def test_sharded(spark):
    """Small blocks and shards give what a model of all training texts gives, in one task; the last blocks' documents have tokens that shards know nothing of."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trusted = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    text = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in trusted.collect()} & text.keys()
    used = {d for d in good if zlib.crc32(str(d).encode()) % kn.HELD_OUT}
    want, n = kn.log_probabilities(kn.train([text[d] for d in sorted(used)]), pa.array(list(text.values()), pa.large_string()))
    got = {r.doc_id: r for r in kn.scored(docs.repartition(3), trusted, block_bytes=100_000, shard_tokens=20_000).collect()}
    assert len(got) == len(text) and {d for d, r in got.items() if r.held} == good - used
    for d, w, k in zip(text, want, n, strict=True):
        assert got[d].n_tokens == k + 1 and math.isclose(got[d].log_probability, w, rel_tol=1e-5)


def test_rounds(spark):
    """Blocks that ask in rounds get the same; what was staged on the way is gone, and only the scores are left in the shared folder."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3, "doc_id")
    trusted = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id").distinct()
    shared, freed = spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = set(os.listdir(shared)), spark.conf.get(freed, None)
    got = kn.scored(docs, trusted, block_bytes=60_000, shard_tokens=100_000, round_tokens=20_000)
    left = set(os.listdir(shared)) - before
    assert 1 < len(left) <= kn.ROUNDS and len(left) == len({f.rsplit("/", 2)[1] for f in got.inputFiles()})
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tensorloom_")]
    assert spark.conf.get(freed, None) == setting
    one = kn.scored(docs, trusted)
    assert len(set(os.listdir(shared)) - before - left) == 1
    want = {r.doc_id: r for r in one.collect()}
    rows = got.collect()
    assert len(rows) == len(want) == docs.count()
    for r in rows:
        w = want[r.doc_id]
        assert (r.lang, r.n_tokens, r.held) == (w.lang, w.n_tokens, w.held) and math.isclose(r.log_probability, w.log_probability, rel_tol=1e-9)


def test_grams_memory():
    """A block's trigrams take at most 80 bytes a token on the way and 40 when done, so that two blocks fit beside an executor's heap."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 400, 2_000)
    ids = np.minimum(rng.zipf(1.3, int(counts.sum())), 100_000)
    ids = np.where(ids % 7 == 0, kn.UNKNOWN, ids + 2)
    tracemalloc.start()
    g = kn.Grams(ids, counts, 5)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 80 * len(ids) and held < 40 * len(ids)
    ends = np.cumsum(counts)
    lines = [[kn.START, kn.START, *ids[e - n : e].tolist(), kn.END] for e, n in zip(ends, counts, strict=True)]
    places = [(x[i - 2], x[i - 1], x[i]) for x in lines for i in range(2, len(x))]
    pairs, thirds = g.pairs.tolist(), g.thirds.tolist()
    of_third = np.repeat(np.arange(len(pairs)), g.lens)
    for (a, b, c), head, tail, triple in list(zip(places, g.head, g.tail, g.triple, strict=True))[:20_000]:
        assert (pairs[head] == a << 32 | b) if a and b else head == -1
        assert (pairs[tail] == b << 32 | c) if b and c else tail == -1
        assert (pairs[of_third[triple]], thirds[triple]) == (a << 32 | b, c) if a and b and c else triple == -1
    assert g.times.sum() == sum(1 for t in places if all(t))


def test_grams_cost():
    """A block's trigrams cost less than sorting the places of its pairs one and a half times, and its words are packed without a Python string each."""

    def least(f):
        took = []
        for _ in range(3):
            begun = time.process_time()
            f()
            took.append(time.process_time() - begun)
        return min(took)

    rng = np.random.default_rng(7)
    ids = np.minimum(rng.zipf(1.2, 1_000_000), 150_000) + 2
    counts = np.full(2_000, 500)
    pairs = ids[:-1] << 32 | ids[1:]
    assert least(lambda: kn.Grams(ids, counts, 60)) < 1.5 * least(lambda: np.unique(pairs, return_inverse=True, return_counts=True))
    words = pa.array([f"w{i}" for i in range(200_000)], pa.large_string())
    assert least(lambda: pack_words(words)) < least(words.to_pylist)


def test_same_as_plain():
    """Distinct codes, packed words and numbers, and trigrams of words by position, are what the plain ways give."""
    rng = np.random.default_rng(3)
    for n, bound in ((0, 1), (1, 1), (5_000, 40), (5_000, 1 << 49), (5_000, 1 << 61)):
        codes = rng.integers(0, bound, n)
        for got, want in zip(kn.distinct(codes.copy(), bound), np.unique(codes, return_inverse=True, return_counts=True), strict=True):
            assert got.tolist() == want.tolist()
    for words in ([], ["a"], ["é", "a\x00b", "x"]):
        for array in (pa.array(words, pa.large_string()), pa.array(["first", *words]).slice(1)):
            assert unpack_words(pack_words(array)) == words
    for values in (np.zeros(0, np.int64), np.array([-1, 0, 1 << 62]), np.array([0, 300, 7], np.uint32), np.array([0.5, -2.0])):
        assert unpack(pack(values)).tolist() == values.tolist() and unpack(pack(values)).dtype == values.dtype
    names = np.array([kn.UNKNOWN, 900, 3, (1 << 31) - 1, 17, 17], np.uint32)
    tokens, counts = rng.integers(0, len(names), 600), np.array([0, 100, 1, 499])
    places, at = kn.ranked(names)
    a, b = kn.Grams(names.astype(np.int64)[tokens], counts, 3), kn.Grams(at[tokens], counts, 3, places)
    for k in ("pairs", "bounds", "lens", "thirds", "times", "third_bounds", "head", "tail", "triple", "of_third"):
        assert getattr(a, k).tolist() == getattr(b, k).tolist(), k
    assert places[b.b].tolist() == a.b.tolist() and places[b.c].tolist() == a.c.tolist()


def test_all_trusted_count(spark):
    """More trusted documents than a former bound of 4,000: each of them is learned from."""
    rows = [(d, "en", f"shared words and w{d} here") for d in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _ in rows], "doc_id long, quality int, toxic int")
    used = [t for d, _, t in rows if zlib.crc32(str(d).encode()) % 4]
    assert len(used) > 4_000
    log_p, n = kn.log_probabilities(kn.train(used), pa.array([t for _, _, t in rows], pa.large_string()))
    got = {r.doc_id: r.perplexity for r in kn.classify(docs, labels).collect()}
    assert all(math.isclose(got[d], math.exp(-p / (k + 1)), rel_tol=1e-5) for (d, _, _), p, k in zip(rows, log_p, n, strict=True))


def test_edges(spark, nasty, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (3, None, 0), (None, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in kn.classify(nasty, labels).collect()}
    assert len(rows) == nasty.where("doc_id is not null").count()
    assert not rows[0].kept and not rows[6].kept and rows[12].kept  # null, blank, and words without any threshold
    assert kn.classify(nothing, labels).count() == 0
    assert kn.classify(nasty, labels.where("false")).count() == len(rows)
    assert kn.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels.where("false")).where("kept").count() > 150
