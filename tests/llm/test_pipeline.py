"""The pipeline's stages, each against plain Python on what the stage before kept, and on odd tables."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from tensorloom.llm import kneser_ney as kn
from tensorloom.llm._common import stage

from .conftest import SF, texts
from .test_native import brute_hits, brute_targets, words
from .test_simhash import classes, shingles


def plain_discounts(counts):
    n = [list(counts).count(k) for k in range(5)]
    if not all(n[1:]):
        return [0, 0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))]


class Plain:
    """Interpolated modified Kneser-Ney trigrams from counts of tuples."""

    def __init__(self, lines):
        three = Counter(tuple(x[i - 2 : i + 1]) for x in lines for i in range(2, len(x)))
        two, one = Counter(), Counter()
        for (_, b, c), n in three.items():
            two[b, c] += n if b == "<s>" else 1
        for _, c in two:
            one[(c,)] += 1
        self.known = {c for (c,) in one}
        self.levels = []
        for counts in (one, two, three):
            d, total, left = plain_discounts(counts.values()), Counter(), defaultdict(float)
            for k, n in counts.items():
                total[k[:-1]] += n
                left[k[:-1]] += d[min(n, 3)]
            self.levels.append((counts, d, total, left))

    def probability(self, *gram):
        p = 1 / (len(self.known) + 1)  # every word and end, and one unknown
        for n, (counts, d, total, left) in enumerate(self.levels, 1):
            k = gram[3 - n :]
            if total[k[:-1]]:
                p = max(counts[k] - d[min(counts[k], 3)], 0) / total[k[:-1]] + left[k[:-1]] / total[k[:-1]] * p
        return p


def plain_quality(docs, langs, labels, least):
    """Ids kept, with the whole trusted text (it is below the bounds) as training sample."""
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0 and r.doc_id in docs}
    used = {d for d in good if zlib.crc32(str(d).encode()) % 4}
    model = Plain([["<s>", "<s>", *split(docs[d]), "</s>"] for d in used])
    level = {}
    for d, t in docs.items():
        x = ["<s>", "<s>", *(w if w in model.known else "?" for w in split(t)), "</s>"]
        level[d] = (-sum(math.log(model.probability(*x[i - 2 : i + 1])) for i in range(2, len(x))) / (len(x) - 2), len(x) - 2)
    held = defaultdict(list)
    for d in good - used:
        if level[d][1] > 1:
            held[langs[d]].append(math.ceil(level[d][0] * 1000))
    quantile = lambda v: sorted(v)[math.ceil(kn.QUANTILE * len(v)) - 1] / 1000
    every = quantile([s for v in held.values() for s in v])
    own = {x: quantile(v) for x, v in held.items() if len(v) >= least}
    return {d for d, (x, n) in level.items() if n > 1 and x <= own.get(langs[d], every) + kn.SLACK + 3 / math.sqrt(n)}, set(own)


@pytest.fixture(scope="module")
def stages(spark, documents):
    """What each stage is given and returns, with few trusted documents enough for a language's own threshold."""
    least, kn.LEAST_TRUSTED = kn.LEAST_TRUSTED, 4
    docs, out = documents, []
    for _, function in cp.STAGES:
        given, docs = docs, stage(function(spark, docs, SF))
        out.append((given, docs))
    kn.LEAST_TRUSTED = least
    return out


def unchanged(given, kept):
    """Rows that stay keep all their columns."""
    assert kept.columns == cp.COLUMNS
    assert kept.exceptAll(given.select(cp.COLUMNS)).count() == 0


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "token-ID output"]


def test_quality(spark, stages):
    given, kept = stages[0]
    langs = {r.doc_id: r.lang for r in given.collect()}
    want, own = plain_quality(texts(given), langs, spark.read.parquet(f"{SF}/labels.parquet").collect(), 4)
    assert texts(kept).keys() == want and own and len(want) < len(langs)
    unchanged(given, kept)


def test_near_dedup(stages):
    given, kept = stages[1]
    sets = {d: set(shingles(t, 5)) for d, t in texts(given).items()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert pairs and texts(kept).keys() == set(classes(sets, pairs).values())
    unchanged(given, kept)


def test_decontamination(spark, stages):
    given, kept = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for d, t in texts(given).items():
        n, hit, _ = brute_hits(t, items)
        if not (hit and 20 * len(hit) >= n):
            want.add(d)
    assert texts(kept).keys() == want and len(want) < given.count()
    unchanged(given, kept)


def test_mixing(stages):
    given, kept = stages[3]
    rows = {r.doc_id: r for r in given.collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows.values():
        sizes[r.source] += len(words(r.text))
        largest[r.source] = max(largest[r.source], len(words(r.text)))
    copies = Counter(r.doc_id for r in kept.collect())
    target = brute_targets(sizes)
    for d, n in copies.items():
        rate = target[rows[d].source] / sizes[rows[d].source]
        assert math.floor(rate) <= n <= math.ceil(rate)
        taken[rows[d].source] += n * len(words(rows[d].text))
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    assert kept.columns == cp.COLUMNS and kept.distinct().exceptAll(given.select(cp.COLUMNS)).count() == 0


def test_token_ids(stages):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given, back = stages[4]
    start, want = 0, []
    for d, t in sorted((r.doc_id, r.text or "") for r in given.collect()):
        ids = [*encoder.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back.collect()) == want


@pytest.mark.parametrize("at", range(5))
def test_odd_tables(spark, nasty, nothing, at):
    """Nulls, blanks, repeated rows, clashing extra columns and no rows: defined results, no crash."""
    pytest.importorskip("public_tokenizers")
    function = cp.STAGES[at][1]
    assert function(spark, nothing, SF).count() == 0
    ids = {r.doc_id for r in nasty.collect()} - {None}
    rows = Counter(r.doc_id for r in function(spark, nasty, SF).collect())
    assert rows and rows.keys() <= ids
    twice = Counter(r.doc_id for r in function(spark, nasty.unionByName(nasty), SF).collect())
    assert twice.keys() <= ids and all(n <= 4 for n in twice.values())
    if at in (0, 1, 2, 4):
        assert twice == {d: 2 * n for d, n in rows.items()}
