"""Repeated strings against a dictionary of all strings of the length."""

import hashlib
import random

import numpy as np
import pytest

from tensorloom.llm import anchors, repeats

from .conftest import texts


def brute(docs, length):
    seen = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for i, (_, b) in enumerate(raw):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    gone = [np.zeros(len(b), bool) for _, b in raw]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                gone[i][p : p + length] = True
    return {(d, len(b), int(g.sum()), int((np.diff(g.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for (d, b), g in zip(raw, gone, strict=True)}


def got(df, **more):
    return {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, **more).collect()}


@pytest.mark.parametrize(("which", "length", "block"), [("documents", 400, 50_000), ("documents", 150, 50_000), ("nasty", 150, 2_000), ("nasty", 400, 1 << 20)])
def test_against_dictionary(which, length, block, request):
    df = request.getfixturevalue(which)
    docs = sorted(texts(df).items())
    want = brute(docs, length)
    assert got(df, length=length, block_bytes=block, shard_keys=500) == want
    assert any(w[2] for w in want)


def test_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(120) for _ in range(4)]
    docs = []
    for _ in range(60):
        parts = [prose(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 150)
            parts += [s[a : a + rng.randint(300, 500)], prose(rng.randint(0, 60))]
        docs.append("".join(parts))
    docs += ["ab" * 700, "x" * 900, "x" * 399, "y" * 400, "y" * 401, shared[0], shared[0], None, ""]
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 400)
    assert got(df, block_bytes=9_000, shard_keys=300) == want
    assert len({w[2] for w in want}) > 10


def test_anchor_promise():
    rng = np.random.default_rng(1)
    same = rng.integers(97, 123, 79, dtype=np.uint8)
    for _ in range(50):
        a, b = (rng.integers(97, 123, rng.integers(0, 200), dtype=np.uint8) for _ in range(2))
        at = []
        for x in (a, b):
            buffer = np.concatenate([x, same, rng.integers(97, 123, 60, dtype=np.uint8)])
            at.append({p - len(x) for p in anchors.anchors(buffer, np.array([len(buffer)])).tolist()})
        assert at[0] & at[1] & set(range(64))


def test_empty(nothing):
    assert repeats.remove_repeats(nothing).count() == 0
