"""License scans against plain TF-IDF cosines and plain walks up the directories."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyverify.llm import licenses

TEXTS = licenses.default_templates()
PROSE = ["the", "of", "river", "and", "stone", "license", "software", "version", "under", "gnu", "public", "2.0", "use", "without", "notice", "copyright"]


def prose(rng, n):
    return " ".join(rng.choice(PROSE) for _ in range(n))


def units(text):
    """Every line, block and the whole, as lists of lines; the plain way."""
    lines = text.split("\n")
    out = [[x] for x in lines]
    block, kinds = [], []
    for x in [*lines, ""]:
        kind = "blank" if not x.strip() else "comment" if re.match(r'\s*(#|//|/\*|\*|--|;|%|<!--|"""|rem\b)', x, re.I) else "other"
        if block and (kind == "blank" or kind != kinds[-1]):
            out.append(block)
            block = []
        if kind != "blank":
            block.append(x)
            kinds.append(kind)
    return [*out, lines]


def plain(files, least):
    words = lambda x: re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", x.lower())
    vocabulary = {t for texts in TEXTS.values() for x in texts for t in words(x)}
    df, n = Counter(t for _, x in files for t in vocabulary & set(words(x or ""))), len(files)

    def vector(x):
        v = {t: (1 + math.log(c)) * (math.log((n + 1) / (df[t] + 1)) + 1 if t in vocabulary else math.log(n + 1) + 1) for t, c in Counter(words(x)).items()}
        norm = math.sqrt(sum(y * y for y in v.values())) or 1.0
        return {t: y / norm for t, y in v.items()}

    templates = [(name, vector(x)) for name in sorted(TEXTS) for x in TEXTS[name]]
    out = []
    for path, text in files:
        best = (None, 0.0)
        for unit in units(text or ""):
            v = vector("\n".join(unit))
            for name, w in templates:
                cos = sum(y * w.get(t, 0.0) for t, y in v.items())
                if cos >= least and cos > best[1] + 1e-12:
                    best = (name, cos)
        out.append((path, *best))
    return out


def made(rng):
    files = []
    for name, texts in TEXTS.items():
        for k, x in enumerate(texts):
            words = x.split(" ")
            some = [w for w in words if rng.random() > 0.1] if len(words) > 12 else words
            files.append((f"t/{name}/{k}/a.txt", x))
            files.append((f"t/{name}/{k}/b.py", "# " + "\n# ".join(" ".join(some[i : i + 9]) for i in range(0, len(some), 9)) + "\nimport os\n" + prose(rng, 20)))
    files += [(f"p/{k}.txt", "\n".join(prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(5)))) for k in range(60)]
    return [*files, ("e/1", ""), ("e/2", None), ("e/3", " \n\n \t"), ("e/4", "x " * 50_000 + "\n" + TEXTS["MIT"][0])]


@pytest.mark.parametrize("least", [0.75, 0.5])
def test_scores_are_plain_cosines(spark, least):
    files = made(random.Random(3))
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "p string, text string").repartition(5), F.col("p"), least=least).where("origin <> 'inherited'").collect()}
    want = plain(files, least)
    found = Counter(name for _, name, _ in want if name)
    assert set(found) == set(TEXTS) and sum(found.values()) > 120
    for path, name, cos in want:
        if path in got:
            assert (got[path].license, got[path].origin) == (name, "own" if name else "none"), path
            assert not name or abs(got[path].score - cos) < 1e-8


def test_whole_texts_headers_and_tags():
    m = licenses.Matcher(TEXTS, {}, 1000, 0.75)
    for name, texts in TEXTS.items():
        for x in texts:
            assert m.text(x)[0] == name or (name, x[:4]) == ("", ""), (name, x[:60])
    for name in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Zlib"):
        filled = TEXTS[name][-1].replace("<year>", "2021").replace("<owner>", "Jo Doe").replace("<copyright holders>", "Jo Doe")
        assert m.text(filled)[0] == name and m.text(filled)[2] == 1.0
    assert m.text("  * " + TEXTS["MIT"][0].upper())[0] == "MIT"
    assert m.text("CC BY-SA 4.0 applies")[0] is None and m.text("This work is licensed under CC BY-SA 4.0.")[0] == "CC-BY-SA-4.0"
    assert m.text("Licensed under the GNU GPL, version 2.")[0] == "GPL-2.0"


def test_inheritance(spark):
    rng = random.Random(2)
    plain_text = lambda: " ".join(rng.choice(["river", "stone", "quiet"]) for _ in range(50))
    mit, gpl, apache = "Released under the MIT License.", TEXTS["GPL-3.0"][-1], TEXTS["Apache-2.0"][0]
    files = [
        ("a/LICENSE", mit, 1, 1.0), ("a/x.py", plain_text(), 1, 1.0), ("a/b/c/y.py", plain_text(), 1, 1.0), ("a/b/COPYING.txt", gpl, 1, 1.0), ("a/d/z.py", "# " + apache + "\n" + plain_text() * 9, 1, 1.0),
        ("a/d/w.py", "", 1, 1.0), ("a/d/w.py", "", 1, 1.0), ("q/v.py", plain_text(), 1, 1.0), (None, plain_text(), 1, 1.0), ("top", None, 1, 1.0), ("ab/n.py", "see the version 2.0 of the river", 1, 1.0),
        ("tie/LICENSE", apache, 1, 1.0), ("tie/COPYING", mit, 1, 1.0), ("tie/x", "", 1, 1.0), ("a/LICENSE", mit, 1, 1.0),
    ]
    rows = licenses.scan(spark.createDataFrame(files, "p string, text string, license int, score double"), F.col("p")).collect()
    assert Counter(r.path for r in rows) == Counter(f[0] for f in files)
    none = (None, "none", None)
    assert {r.path: (r.license, r.origin, r.license_dir) for r in rows} == {
        "a/LICENSE": ("MIT", "own", None), "a/x.py": ("MIT", "inherited", "a"), "a/b/c/y.py": ("GPL-3.0", "inherited", "a/b"), "a/b/COPYING.txt": ("GPL-3.0", "own", None),
        "a/d/z.py": ("Apache-2.0", "own", None), "a/d/w.py": ("MIT", "inherited", "a"), "q/v.py": none, None: none, "top": none, "ab/n.py": none,
        "tie/LICENSE": ("Apache-2.0", "own", None), "tie/COPYING": ("MIT", "own", None), "tie/x": ("Apache-2.0", "inherited", "tie"),
    }
    assert licenses.scan(spark.createDataFrame([], "p string, text string"), F.col("p")).count() == 0
