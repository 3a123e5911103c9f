"""Katz backoff scores against a plain model with dictionaries, and the model's normalisation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tensorloom.llm import katz

from .conftest import texts

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
END, START = object(), object()


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [END]


class Brute:
    def __init__(self, docs):
        train = [tokens(t) for d, t in docs.items() if zlib.crc32(str(d).encode()) % 7 != 2]
        self.c1 = Counter(w for t in train for w in t)
        self.c2 = Counter(p for t in train for p in zip([START, *t], t, strict=False))
        self.n = sum(self.c1.values())
        self.d1, self.d2 = ({c: self.worth(c, Counter(k.values())) for c in set(k.values())} for k in (self.c1, self.c2))
        self.unknown = 1 - sum(self.d1[c] for c in self.c1.values()) / self.n
        self.context = Counter()
        self.after = defaultdict(list)
        for (a, b), c in self.c2.items():
            self.context[a] += c
            self.after[a].append((b, c))

    @classmethod
    def worth(cls, r, having):
        """Good and Turing's estimate of a count, or half off where it is out of bounds; a count over 5 loses what 5 does."""
        if r > 5:
            return r - (5 - cls.worth(5, having))
        turing = (r + 1) * having[r + 1] / having[r] if having[r] else 0
        return turing if r * 0.05 <= turing <= r - 0.05 else r - 0.5

    def p1(self, w):
        return self.d1[self.c1[w]] / self.n if w in self.c1 else self.unknown

    def weight(self, a):
        if a not in self.context:
            return 1.0
        return (1 - sum(self.d2[c] for _, c in self.after[a]) / self.context[a]) / (1 - sum(self.p1(b) for b, _ in self.after[a]))

    def p2(self, a, b):
        return self.d2[self.c2[a, b]] / self.context[a] if (a, b) in self.c2 else self.weight(a) * self.p1(b)


@pytest.mark.parametrize(("which", "block", "shard"), [("documents", 60_000, 9_000), ("nasty", 2_000, 1_000)])
def test_scores(which, block, shard, request):
    df = request.getfixturevalue(which)
    docs = texts(df)
    model = Brute(docs)
    rows = {r.doc_id: r for r in katz.katz_scores(df, block, shard).collect()}
    assert rows.keys() == docs.keys()
    better = 0.0
    for d, t in docs.items():
        w = tokens(t)
        base = sum(math.log10((model.c1[x] + 1) / (model.n + len(model.c1) + 1)) for x in w)
        score = sum(math.log10(model.p2(a, b)) for a, b in zip([START, *w], w, strict=False))
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(x in model.c1 for x in w), model.n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-7)
        better += (r.score - r.base_score) * r.held_out
    assert which == "nasty" or better > 0


def test_normalised(documents):
    model = Brute(texts(documents))
    assert math.isclose(sum(model.p1(w) for w in model.c1) + model.unknown, 1)
    for a in [START, *list(model.context)[1:200:40]]:
        seen = sum(model.p2(a, b) for b, _ in model.after[a])
        rest = model.weight(a) * (1 - sum(model.p1(b) for b, _ in model.after[a]))
        assert math.isclose(seen + rest, 1) and model.weight(a) > 0


def test_many_tiny_texts(spark):
    """More rows than a block takes, with few bytes: scores don't depend on blocks."""
    tiny = spark.range(0, 140_000, 1, 1).selectExpr("id as doc_id", "case when id % 3 = 0 then null when id % 3 = 1 then 'ab' else concat('c', id % 7) end as text")
    long = spark.createDataFrame([(-1, "some words " * 3000), (-2, "c1 ab")], "doc_id long, text string")
    df = tiny.union(long).coalesce(1)
    a, b = ({r.doc_id: (r.n_tokens, r.n_known, round(r.score, 6)) for r in katz.katz_scores(df, size, 50_000).collect()} for size in (katz.BLOCK_BYTES, 20_000))
    assert len(a) == 140_002 and a == b


def test_repeated_rows(spark, documents):
    """Rows that repeat a doc_id are documents of their own, counted and scored each."""
    some = documents.limit(30)
    twice = katz.katz_scores(some.union(some)).collect()
    own = [(i, r.text) for i, r in enumerate(some.collect())]
    assert len(twice) == 2 * len(own)
    by = {}
    for r in twice:
        by.setdefault(r.doc_id, set()).add((r.n_tokens, round(r.score, 9)))
    assert all(len(x) == 1 for x in by.values())


def test_empty(nothing):
    assert katz.katz_scores(nothing).count() == 0
