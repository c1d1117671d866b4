"""Rejection of unlearned languages, the sample, and scripts."""

import random

import pandas as pd
import pytest

from skyverify.llm import langid


@pytest.fixture(scope="module")
def given():
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    docs = docs[(docs.quality == 1) & docs.lang.notna()].drop_duplicates("text")
    return {x: g.text.tolist()[:300] for x, g in docs.groupby("lang")}


def test_unlearned_language_goes_and_short_clean_texts_stay(spark, given):
    rng = random.Random(4)
    for left in given:
        learned = [x for x in given if x != left]
        model = langid.fit_model([t for x in learned for t in given[x][:200]], [x for x in learned for _ in given[x][:200]])
        cut = lambda t: " ".join(t.split()[:12])
        rows = [(k, t, x) for x in learned for k, t in enumerate(given[x][200:230] + [*map(cut, given[x][230:260])])]
        rows += [(k, t, "left") for k, t in enumerate(given[left][200:260])]
        rows += [(k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(60)), "salad") for k in range(20)]
        rows += [(0, "съешь ещё этих мягких французских булок, да выпей чаю", "other"), (1, "日本語の文章です。", "other"), (2, None, "other"), (3, "12 !", "other")]
        got = langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).groupBy("lang").count().collect()
        kept = {r.lang: r["count"] for r in got}
        assert all(kept.get(x, 0) >= 0.97 * 60 for x in learned), (left, kept)
        assert kept.get("left", 0) <= 2 and "salad" not in kept and "other" not in kept, (left, kept)


def test_sample_has_min_of_per_lang_and_distinct_texts(spark, monkeypatch):
    got = []
    monkeypatch.setattr(langid, "fit_model", lambda texts, langs, landmarks: got.append(list(zip(texts, langs, strict=True))))
    rows = [(f"text number {k}", "en") for k in range(300)] + [("a copied text", "en")] * 20_000 + [(f"der text {k}", "de") for k in range(12)] * 2 + [(None, "en"), ("x", None)]
    langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(5), per_lang=30)
    langs = [x for _, x in got[0]]
    assert len(set(got[0])) == len(got[0]) and langs.count("en") == 30 and langs.count("de") == 12 and len(langs) == 42


def test_languages_of_other_scripts_are_told_apart():
    rng = random.Random(9)
    # the Latin letters alone fill an alphabet of 62; the others are rare in the sample
    words = {"la": [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0xE0, 0x180) if chr(c).isalpha() and chr(c).islower()], "ru": "абвгдежзиклмн", "uk": "опрстуфхцчшщю", "el": "αβγδεζηθικλμν", "zh": "的一是不了人我在有他这中大"}
    make = lambda x, n: " ".join("".join(rng.choice(words[x]) for _ in range(3)) for _ in range(n))
    train = [(make(x, 400 if x == "la" else 12), x) for x in words for _ in range(20)]
    model = langid.fit_model(*zip(*train, strict=True))
    test = [(make(x, 12), x) for x in words for _ in range(10)]
    got = model.scores([langid.Features()(t) for t, _ in test]).argmax(axis=1)
    assert [model.langs[k] for k in got] == [x for _, x in test]


def test_fit_is_kernel_ridge_regression_in_the_landmarks_map():
    import numpy as np

    rng = random.Random(2)
    vocab = {"en": ["the", "and", "thing", "with", "which"], "de": ["der", "und", "nicht", "schön", "straße"], "fr": ["le", "où", "être", "français", "mais"]}
    make = lambda x: " ".join(rng.choice(vocab[x]) for _ in range(rng.randrange(1, 9)))
    pairs = [(make(x), x) for x in vocab for _ in range({"en": 30, "de": 18, "fr": 9}[x])]
    model = langid.fit_model(*zip(*pairs, strict=True), landmarks=5, ridge=0.5)

    def grams(text):  # what isn't a letter is one symbol
        t = [c if c.isalpha() else " " for c in text.lower()]
        return {tuple(t[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1)}

    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    names = sorted(vocab)
    marks = [grams(t) for x in names for t in [t for t, y in pairs if y == x][:5]]
    within = np.array([[kernel(a, b) for b in marks] for a in marks])
    to = lambda texts: np.array([[kernel(grams(t), m) for m in marks] for t in texts])
    value, vector = np.linalg.eigh(within)
    use = value > 1e-6 * value[-1]
    root = vector[:, use] / np.sqrt(value[use])
    x, y = to([t for t, _ in pairs]) @ root, np.array([[1.0 if z == n else -1.0 for n in names] for _, z in pairs])
    weight = np.array([1 / sum(z == w for _, w in pairs) for _, z in pairs])
    weight /= weight.sum()
    x0, y0 = weight @ x, weight @ y
    gram = (x - x0).T @ ((x - x0) * weight[:, None]) + 0.5 / len(pairs) * np.eye(x.shape[1])
    solved = np.linalg.solve(gram, (x - x0).T @ ((y - y0) * weight[:, None]))
    tests = [make(x) for x in vocab for _ in range(9)] + ["xyz", "1 2 the", "ü"]
    want = (to(tests) @ root - x0) @ solved + y0
    assert np.allclose(model.scores([langid.Features()(t) for t in tests]), want, atol=2e-4)


def test_long_texts_are_taken_last(spark, monkeypatch):
    got = []
    monkeypatch.setattr(langid, "fit_model", lambda texts, langs, landmarks: got.append(list(zip(texts, langs, strict=True))))
    rows = [(f"long {k} " * 50, "en") for k in range(40)] + [(f"short {k}", "en") for k in range(20)] + [(f"lang {k} " * 50, "de") for k in range(9)]
    langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_lang=25, max_bytes=100)
    assert sum(t.startswith("short") for t, _ in got[0]) == 20 and sum(x == "en" for _, x in got[0]) == 25 and sum(x == "de" for _, x in got[0]) == 9


def test_bounded_ranks_are_those_of_all_hashes(spark):
    rng = random.Random(6)
    rows = [("a", rng.randrange(1 << 62)) for _ in range(5000)] * 2 + [("b", rng.randrange(1 << 62)) for _ in range(20)] + [("c", (1 << 62) + rng.randrange(1 << 40)) for _ in range(3000)]
    got = langid._last_hashes(spark.createDataFrame(rows, "lang string, h bigint").repartition(4), 50)
    assert got == {x: sorted({h for y, h in rows if y == x})[:50][-1] for x in "abc"}
