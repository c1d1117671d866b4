"""Stages of the pipeline against brute force."""

import random
from itertools import combinations

import xxhash

import corpus_pipeline
from skyverify.llm import jaccard, simhash


def shingled(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def test_near_stage_matches_all_pairs(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for size in (60, 90, 140, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(base)
            for _ in range(rng.randrange(4, 14)):
                copy = list(rng.choice([base, texts[-1]]))
                for _ in range(rng.randrange(1, 2 + size // 40)):
                    copy[rng.randrange(len(copy))] = word()
                texts.append(copy[rng.randrange(6) :])
    texts += [[word() for _ in range(rng.randrange(5, 60))] + passage for _ in range(40)] + [["a", "b"], ["A", "b"], ["c"], []]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    hard = 0
    for a, b in combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if 9 * common >= 4 * (len(sets[a]) + len(sets[b])):
            root[find(a)] = find(b)
            hard += 1
    got = [r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert hard > 100 and len(got) == len(set(got))
    assert sorted(find(x) for x in got) == sorted({find(x) for x in range(len(texts))})


def brute_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingled(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_stage_keeps_links_of_fingerprints(spark, tmp_path, monkeypatch):
    """Texts below the similarity whose fingerprints are close go by SimHash alone; a line repeated in different texts joins none."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    alike = lambda a, b: 9 * len(shingled(a) & shingled(b)) >= 4 * (len(shingled(a)) + len(shingled(b)))
    texts = []
    while len(texts) < 6:
        base = [word() for _ in range(60)]
        a, fp = " ".join(base), brute_fingerprint(" ".join(base))
        for _ in range(500):
            b = " ".join([*base[:-9], *(word() for _ in range(9))])
            if (fp ^ brute_fingerprint(b)).bit_count() <= 3 and not alike(a, b):
                texts += [a, b]
                break
    texts += [" ".join(["buy cheap pills online now"] * 45 + [word() for _ in range(240)]) for _ in range(4)] + [texts[0] + " end", " ".join(word() for _ in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    docs, root = spark.read.parquet(str(tmp_path / "d")), list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    fps = [brute_fingerprint(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if alike(texts[a], texts[b]) or (fps[a] ^ fps[b]).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(k) for k in range(len(texts))] == [0, 0, 2, 2, 4, 4, 6, 7, 8, 9, 0, 11]
    roots = {r.node: r.root for r in simhash.near_copies(docs, "doc_id").collect()}
    assert [roots.get(k, k) for k in range(len(texts))] == [find(k) for k in range(len(texts))]
    classes = lambda kept: sorted(find(r.doc_id) for r in kept.collect())
    assert classes(corpus_pipeline.near(spark, docs, "")) == [0, 2, 4, 6, 7, 8, 9, 11]
    none = spark.createDataFrame([], "doc_id bigint, component_id bigint")
    monkeypatch.setattr(simhash, "linked", lambda fps, t: none)
    assert classes(corpus_pipeline.near(spark, docs, "")) == [0, 0, 2, 2, 4, 4, 6, 7, 8, 9, 11]


def test_rest_names_every_pair_of_different_labels(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    h, label = rng.integers(-5, 5, 200), rng.integers(0, 4, 200)
    nr = np.arange(200)
    for chunk in (1, 50, 10**6):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        got = [tuple(sorted(p)) for i, j in jaccard._rest(h, nr, nr, nr, label) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(got) == [(a, b) for a in range(200) for b in range(a + 1, 200) if h[a] == h[b] and label[a] != label[b]]


def test_stages_do_what_their_operators_say(spark, tmp_path):
    """Every stage on what the one before kept: nulls, copies, repeated and null ids, clashing columns, a very long text."""
    from skyverify.llm import langid, packing, quality

    rng = random.Random(11)
    stems = {"en": "th er on an re in ed at en ti es or st is ou ing tion ha le nd".split(), "de": "sch ein ung ich der ver gen lich auf bei zu tz ck ei uf".split()}
    words = {x: ["".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(900)] for x, s in stems.items()}
    prose = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    texts = [(prose(x, rng.randrange(60, 300)), x) for x in stems for _ in range(60)]
    near = [(" ".join([*t.split()[:-2], "endings", "differ"]), x) for t, x in texts[:20]]
    texts += near + texts[30:40] + texts[30:35] + [(prose("en", 40_000), "en"), (prose("en", 9), "en"), (None, "en"), ("", None), (" \n", "de"), ("12 34 !", "en"), ("same words here " * 60, "en")]
    texts += [(" ".join("".join(rng.choice("0123456789abcdef") for _ in range(8)) for _ in range(200)), None) for _ in range(5)]
    rng.shuffle(texts)
    rows = [(None if k % 50 == 7 else k % 120, t, x, "s", k, 1, 2, "r", "root", 3) for k, (t, x) in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, row int, nr int, r string, root string, label int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model, rules, features = langid.fit(docs), quality.Rules(quality.Bands()), langid.Features()

    def known(t):
        if not t or not any(c.isalpha() for c in t):
            return False
        grams = features(t)
        return model.fits(grams, int(model.scores([grams]).argmax()))

    left = [t for t, _ in texts]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        got = [r.text for r in docs.collect()]
        before = left
        if name == "language_id":
            left = [t for t in before if known(t)]
        elif name == "quality_rules":
            left = [t for t in before if rules.row((t or "").encode())[6]]
        elif name == "exact_dedup":
            left = list(set(before))
        if name != "near_dedup":
            assert sorted(got) == sorted(left) and len(left) < len(before), name
            continue
        sets, root = {t: shingled(t) for t in before}, {t: t for t in before}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in combinations(before, 2):
            common = len(sets[a] & sets[b])
            if 9 * common >= 4 * (len(sets[a]) + len(sets[b])):
                root[find(a)] = find(b)
        assert sorted(find(t) for t in got) == sorted({find(t) for t in before}) and len(got) < len(before)
        left = got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    library = packing.library_encoder(corpus_pipeline.VOCABULARY)
    assert sum(r.length for r in packed) == sum(len(library(t)) // 4 + 1 for t in left)
    sizes = {}
    for r in packed:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 1024 and len(sizes) <= -(-sum(sizes.values()) // 1024) + 2
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("start", "length", "ids_crc32").collect()) == sorted((r.start, r.length, r.ids_crc32) for r in packed)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Texts that share much, but less than the limit, are ruled out by what they have left, before pairs are made."""
    import numpy as np

    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(300):
        t = list(base)
        for _ in range(8):
            t[rng.randrange(200)] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(t))
    made = []
    real = jaccard._pairs

    def counted(find):
        run = real(find)

        def wrapped(batches):
            for out in run(batches):
                made.append(out.num_rows)
                yield out

        return wrapped

    sets = [jaccard.shingles(t.encode()) for t in texts]
    df = {}
    for s in sets:
        for h in s.tolist():
            df[h] = df.get(h, 0) + 1
    rows = []
    for nr, s in enumerate(sets):
        shared = sorted((df[h], h) for h in s.tolist() if df[h] > 1)
        n, k = len(s), len(shared)
        if 5 * k >= 4 * n:
            rows += [(h, nr, n, k - at) for at, (_, h) in enumerate(shared[: max(0, k - -(-4 * n // 5) + 1)])]
    h, nr, n, rest = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (h, nr, n, rest, nr)], names=["h", "nr", "n", "rest", "label"])
    pairs = {p for out in counted(jaccard._rest)(iter([batch])) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    linked = {(a, b) for a, b in combinations(range(300), 2) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert linked <= pairs and len(pairs) < 3000
