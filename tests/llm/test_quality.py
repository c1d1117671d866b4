"""The compression bands against text without language, and on clean text."""

import random
import string

import pytest

from skyverify.llm import quality

HEX, LOWER, WORDS, BASE64 = "0123456789abcdef", string.ascii_lowercase, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"


def salad(rng, symbols, size):
    out = ""
    while len(out) < size:
        out += "".join(rng.choice(symbols) for _ in range(rng.randrange(3, 9))) + " "
    return out[:size].encode()


@pytest.mark.parametrize("size", [400, 600, 900, 1500, 3000, 6000, 12000, 30000, 100000])
@pytest.mark.parametrize("symbols", [HEX, LOWER, WORDS, BASE64])
def test_salad_goes(size, symbols):
    rng, rules = random.Random(size), quality.Rules(quality.Bands())
    for _ in range(3):
        row = rules.row(salad(rng, symbols, size))
        assert not row[5] and not row[6]


def test_junk_of_a_third_of_the_chunks_goes_and_prose_stays():
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    rules = quality.Rules(quality.Bands())
    clean = [t.encode() for t in docs[docs.quality == 1].text.dropna()]
    rows = [rules.row(t) for t in clean]
    passing = [r for r in rows if not r[5]]
    assert len(passing) > 200 and sum(r[6] for r in passing) >= 0.99 * len(passing)
    long = max((t for t, r in zip(clean, rows, strict=True) if r[6]), key=len)[:8192]
    assert len(long) == 8192 and not rules.row(long + salad(random.Random(1), HEX, 4096))[6]


def test_kept_is_what_plain_bands_say(spark):
    """Every document of sf0.01 by the limits written out: ratios of the whole text and of chunks, and pairs of bytes."""
    import numpy as np
    import zstandard

    limits = [(256, 0.45, 1.10), (512, 0.51, 0.76), (1024, 0.47, 0.72), (2048, 0.43, 0.61), (4096, 0.42, 0.56), (8192, 0.39, 0.505), (16384, 0.38, 0.485), (65536, 0.37, 0.46), (10**12, 0.20, 0.46)]
    size = lambda raw: len(zstandard.ZstdCompressor(level=3).compress(raw))

    def kept(raw):
        words = raw.split()
        grams = list(zip(words, words[1:], words[2:], strict=False))
        times = {}
        for g in grams:
            times[g] = times.get(g, 0) + 1
        if len(words) < 50 or 100 * len({k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}) > 50 * len(words):
            return False
        _, low, high = next(x for x in limits if len(raw) < x[0])
        chunks = [raw[a : a + 4096] for a in range(0, len(raw) - 4096, 4096)] + [raw[-4096:]] if len(raw) > 4096 else []
        bad = sum(not 0.41 <= size(c) / 4096 <= 0.505 for c in chunks)
        if len(raw) < 4096:
            lower = np.frombuffer(raw.lower(), np.uint8)
            mixed = np.random.default_rng(len(lower)).permutation(lower)
            pairs = [len(set(zip(x[:-1].tolist(), x[1:].tolist(), strict=True))) for x in (lower, mixed)]
            if pairs[0] > 0.85 * pairs[1]:
                return False
        return low <= size(raw) / len(raw) <= high and 4 * bad <= len(chunks)

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert got == {k: kept(raw) for k, raw in texts.items()} and 500 < sum(got.values()) < len(got)
