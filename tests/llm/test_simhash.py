"""Fingerprints, links and components against plain Python; near copies against all pairs."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tensorloom.llm import components, simhash

from .conftest import texts


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([b" ".join(w)] if w else [])


def fingerprint(t):
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles(t, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("which", ["documents", "nasty"])
@pytest.mark.parametrize("hot", [simhash.HOT, 4])
def test_groups(which, hot, request):
    df = request.getfixturevalue(which)
    fp = {d: fingerprint(t) for d, t in texts(df).items()}
    want = classes(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.simhash_groups(df, hot=hot).collect()}
    assert got == {d: (fp[d], want[d]) for d in fp}


def test_close_fingerprints(spark):
    """All links of crowded fingerprints, with buckets in parts and whole."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 12)
    node = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 7), replace=False)) for b in base for _ in range(40)}
    df = spark.createDataFrame([(x,) for x in node], "node long")
    want = classes(node, [(a, b) for a, b in itertools.combinations(sorted(node), 2) if (a ^ b).bit_count() <= 3])
    keys = [simhash.block_key(F.col("node"), i, p) for i, p in enumerate(simhash.pigeonholes())]
    for hot in (simhash.HOT, 10):
        links = simhash.near_links(df, keys, ["node"], 3, hot)
        got = {r.node: r.root for r in components.components(links).collect()}
        assert {n: got.get(n, n) for n in node} == want


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    path = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 400), (500, 500), (None, 3)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long"), small=small).collect()}
    want = classes({x for p in path if None not in p for x in p}, [p for p in path if None not in p])
    assert got == want


@pytest.mark.parametrize("members", [1024, 3])
def test_near_copies(spark, nasty, members):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, nasty):
        sets = {d: set(shingles(t, 5)) for d, t in texts(df).items()}
        pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        got = {r.doc_id: r.component_id for r in simhash.near_copies(df, members=members).collect()}
        assert got == classes(sets, pairs)


def test_empty(nothing):
    assert simhash.simhash_groups(nothing).count() == 0
    assert simhash.near_copies(nothing).count() == 0


def test_short_near_copies(spark):
    """Pairs of similarity 0.8 and a little more, from 4 of 5 shingles to sizes on both sides of the bound: none is lost."""
    rng = np.random.default_rng(7)
    rows, pairs = [], []
    for shared in [4] * 300 + [8, 12, 16, 20] * 40 + [200, 204, 208, 256] * 10:
        words = [f"w{x}" for x in rng.integers(0, 10**9, shared + 4 + shared // 4)]
        a = len(rows)
        rows += [(a, " ".join(words[: shared + 4])), (a + 1, " ".join(words))]
        pairs.append((a, a + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: set(shingles(t, 5)) for d, t in rows}
    assert all(len(sets[a] & sets[b]) == 0.8 * len(sets[a] | sets[b]) for a, b in pairs)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert got == {x: a for a, b in pairs for x in (a, b)}


def test_blocks_of_any_table():
    width, blocks = simhash.wide_blocks(0.8)
    assert (1 - (1 - 0.1515) ** width) ** blocks < 0.0011
