"""The suffix tree against one grown from plain counts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyverify.llm import blobs, suffix_tree


def plain(rows, held, depth, least, gain, prior):
    """(id, held, tokens, known, N, base, score) of each row, and the depths of the states used."""
    words = [[*(r[1] or "").encode().lower().split(), b""] for r in rows]
    train = [x for x, h in zip(words, held, strict=True) if not h]
    count = Counter(w for x in train for w in x)
    n, v = sum(count.values()), len(count)
    follows = defaultdict(Counter)  # of contexts, the last word first; a text begins after an end
    for x in train:
        past = [b"", *x]
        for k, w in enumerate(x):
            for d in range(1, min(depth, k + 1) + 1):
                follows[tuple(past[k + 1 - d : k + 1][::-1])][w] += 1
    candidate, retained = {()}, {()}
    total = {c: sum(f.values()) for c, f in follows.items()}

    def share(c, w):
        return follows[c][w] / total[c] if c else count[w] / n

    for c in sorted(follows, key=len):
        if total[c] >= (1 if len(c) == 1 else least) and c[:-1] in retained and (len(c) == 1 or c[1:] in candidate):
            candidate.add(c)
            if sum(x * math.log(x / total[c] / share(c[:-1], w)) for w, x in follows[c].items()) >= gain:
                retained.add(c)
    out, used = [], Counter()
    for r, h, x in zip(rows, held, words, strict=True):
        past, base, score = [b"", *x], 0.0, 0.0
        for k, w in enumerate(x):
            p = (count[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            d = 0
            for e in range(1, min(depth, k + 1) + 1):
                c = tuple(past[k + 1 - e : k + 1][::-1])
                if c not in retained:
                    break
                m = prior[min(e, len(prior)) - 1]
                p, d = (follows[c][w] + m * p) / (total[c] + m), e
            used[d] += 1
            score += math.log10(p)
        out.append((r[0], h, len(x), sum(count[w] > 0 for w in x), n, round(base, 6), round(score, 6)))
    return out, used


def made(rng):
    word = [f"w{k}" for k in range(60)] + ["É x", "\0", "Ÿ"]
    texts = [" ".join(rng.choice(word[: 1 + int(63 * rng.random() ** 2)]) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += [" ".join(f"u{k}{j} " for j in range(9)) for k in range(24)]
    texts += [None, "", " \t\n", "THE", "the " * 900, *texts[:9], texts[3] + " tail", "x\x0by\x0cz\x1cq", " ".join(rng.choice(word) for _ in range(3000))]
    return [(None if k % 37 == 5 else k % 90, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("group", "bucket", "depth"), [(10**6, 10**6, 3), (900, 1500, 3), (900, 700, 1), (1, 9000, 4)])
def test_scores_are_those_of_plain_counts(spark, group, bucket, depth):
    rows = made(random.Random(5))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, grp int, part int").repartition(3)
    got = suffix_tree.score(docs, F.col("doc_id") % 4 == 1, depth=depth, gain=2.0, prior=(20.0, 4.0), group_bytes=group, bucket_bytes=bucket).collect()
    held = [i is not None and i % 4 == 1 for i, _ in rows]
    want, used = plain(rows, held, depth, 2, 2.0, (20.0, 4.0))
    assert all(used[d] > 9 for d in range(depth + 1))
    key = lambda x: tuple((v is None, v) for v in x)
    mine = sorted(((*g[:5], round(g[5], 6), round(g[6], 6)) for g in got), key=key)
    assert [m[:5] for m in mine] == [w[:5] for w in sorted(want, key=key)]
    assert np.allclose([m[5:] for m in mine], [w[5:] for w in sorted(want, key=key)], atol=1e-4)


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = suffix_tree.score(docs, F.lit(True)).collect()
    assert sorted((g.doc_id, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_blobs_round_trip():
    rng = np.random.default_rng(1)
    arrays = [np.zeros(0, np.int64), np.array([0]), rng.integers(0, 2**62, 99), rng.integers(-(2**63), 2**63 - 1, 50), rng.random(7), rng.integers(0, 300, 1000), np.zeros(0)]
    for a, b in zip(arrays, blobs.unpack(blobs.pack(*arrays)), strict=True):
        assert np.array_equal(a, b)
