"""Each operator against a brute-force version, on a fixture with every awkward case."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyverify.llm import bpe, common, components, exact_dedup, langid, licenses, packing, quality, sharding, simhash, suffix_tree, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, fp string, row_key string, name int, part int"


def prose(rng, n, words=("the", "of", "and", "thing", "over", "river", "stone", "garden", "quiet", "morning")):
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing", "ly", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (5, 60, 200, 800, 80, 90)]
    long = prose(rng, 30_000)
    near = texts[3].replace("river", "rivers", 1)
    german = " ".join(rng.choice(["der", "und", "nicht", "schön", "über", "straße"]) for _ in range(70))
    out = [
        (0, texts[0], "en"), (1, texts[1], "en"), (2, texts[2], "en"), (3, texts[3], "en"), (4, near, "en"), (5, texts[3], None), (6, texts[3], "en"),
        (7, None, "en"), (8, "", "en"), (9, "   \n\t ", "en"), (10, "12 34 !!", None), (11, long, "en"), (12, long, "en"), (13, german, "de"), (None, german, "de"),
        (14, texts[4], "en"), (14, texts[4], "en"), (15, "same line\nsame line\nother\n\n\n" + texts[5], "en"), (16, "a  b   c d <|endoftext|> é ß", "de"), (None, None, None),
        (17, "x" * 20_000, "en"), (18, long + "!", "en"), (19, "Ab Cd", "en"), (20, "aB cD", "en"), (21, texts[2] + "\nReleased under the MIT License.", "en"),
    ]
    return [(i, t, x, f"src{k % 3}", "clash", "clash", k, k) for k, (i, t, x) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)].append(r[0])
    want = Counter((r[0], f"{fps[k]:016x}", min(least[find(k)], default=None)) for k, r in enumerate(rows))
    assert multiset(simhash.near_dedup(docs), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("n,t,block", [(3000, 3, 4096), (3000, 3, 64), (800, 5, 4096)])
def test_simhash_links_match_all_pairs(spark, n, t, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(n + block)
    base = rng.integers(0, 2**63, n // 10, dtype=np.int64).view(np.uint64)
    fps = base[rng.integers(0, len(base), n)]
    for _ in range(5):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
    fps = np.unique(fps)
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= t, 1))
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)})).repartition(4)
    got = {(r.u, r.v) for r in simhash.near_edges(df, t).collect()}

    def classes(edges):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for u, v in edges:
            root[find(u)] = find(v)
        out = defaultdict(set)
        for x in list(root):
            out[find(x)].add(x)
        return {frozenset(s) for s in out.values()}

    signed = fps.view(np.int64).tolist()
    assert classes(got) == classes((signed[x], signed[y]) for x, y in zip(a, b, strict=True))
    assert len(got) <= 8 * len(fps)


def test_simhash_other_part_counts():
    for n, m in ((10, 4), (10**7, 3), (10**12, 2)):
        assert simhash.parts_for(n, 3) == m
        groups = simhash.group_bits(np.full((64, 64), n / 4) + np.eye(64) * n / 4, n, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        cells = simhash._cells(groups)
        rng = np.random.default_rng(m)
        fps = rng.integers(-(2**63), 2**63 - 1, 2000)
        counts = [np.bincount(simhash._codes(fps, b), minlength=1 << len(b)) for _, b in cells]
        alloc = simhash.Allocator(groups, counts, len(fps), 3)
        chosen, cost = alloc.thresholds(fps[:50])
        assert (chosen.sum(axis=0) == 3 - m + 1).all() and (chosen >= -1).all()
        # the dynamic programme finds the least total
        from itertools import product

        for k in range(50):
            best = min(sum(cost[p, x + 1, k] for p, x in enumerate(v)) for v in product(range(-1, 4), repeat=m) if sum(v) == 3 - m + 1)
            assert abs(best - sum(cost[p, chosen[p, k] + 1, k] for p in range(m))) < 1e-6


@pytest.mark.parametrize("crowd", [1, 7, 10**6])
def test_crowded_buckets_match_all_pairs(crowd):
    rng = np.random.default_rng(crowd)
    base = rng.integers(0, 2**63, 30, dtype=np.int64).view(np.uint64)
    fps = base[rng.integers(0, 30, 400)]
    for _ in range(6):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) * rng.integers(0, 2, 400).astype(np.uint64)
    fps = np.unique(fps)
    bucket = np.sort(rng.integers(0, 3, len(fps)))
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    want = {(a, b) for a in range(len(fps)) for b in range(a) if bucket[a] == bucket[b] and int(fps[a] ^ fps[b]).bit_count() <= 3}
    for a, b in want:
        root[find(int(fps[a].astype(np.int64)))] = find(int(fps[b].astype(np.int64)))
    u, v = simhash.links_of(bucket, fps.view(np.int64), 3, crowd)
    mine = {}
    seek = lambda x: x if mine.setdefault(x, x) == x else seek(mine[x])
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        mine[seek(a)] = seek(b)
    groups = lambda r, f: sorted(sorted(y for y in r if f(y) == x) for x in {f(y) for y in list(r)})
    assert len(want) > 100 and groups(root, find) == groups(mine, seek)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(500, k) for k in range(501, 700)]
    got = dict(components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_packing(docs, rows):
    got = packing.pack(docs, PATH, size=64).collect()
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seqs[r.sequence_id].append((r.offset, r.length))
    want, total = defaultdict(list), 0
    for r in rows:
        ids = [*library(r[1]), 2]
        total += len(ids)
        starts = [0, *range(len(ids) % 64 or 64, len(ids), 64)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[r[0]].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(seqs) <= -(-total // 64) + 2


def test_packing_plan_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    for n in (1, 50, 5000):
        lengths = np.minimum(1024, rng.geometric(0.003, n))
        plan = packing.plan(dict(Counter(lengths.tolist())), 1024)
        assert Counter(x for k, p in plan for x in p for _ in range(k)) == Counter(lengths.tolist())
        assert all(sum(p) <= 1024 for _, p in plan)
        assert sum(k for k, _ in plan) <= 1.02 * -(-lengths.sum() // 1024) + 2


HARD = ["a  b", "a   b \n\n c", "x\n y", "  lead", "trail  ", "it's we'll DON'T", "tab\tx \t y", "é" * 200, " " * 50, "a<|endoftext|>b", "1234 ５６", "\x1c a\x1fb", "👩‍👩‍👧 z", "", "a\u0085 b", "Z" * 3000 + " " + "ab" * 4000]


def test_bpe(docs, rows):
    enc = bpe.encode(docs, PATH)
    got = Counter((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded) for r in bpe.decode(enc, PATH).collect())
    want = Counter()
    for r in rows:
        ids = library(r[1])
        want[r[0], np.array(ids, "<u4").tobytes(), len(ids), r[1] or ""] += 1
    assert got == want
    v, other = bpe.vocabulary(PATH), packing.library_encoder(PATH)
    t = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    fuzz = ["".join(rng.choice(" \n\tabcDé'sß1！  　-") for _ in range(rng.randrange(60))) for _ in range(300)]
    for x in HARD + fuzz:
        ids = np.array(library(x) if x in HARD else t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        assert v.encode(x) == ids == other(x), x
        assert v.decode(ids) == t.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    assert v.decode(np.array([v.of_byte[0xC3]], "<u4").tobytes()) == "�"


@pytest.mark.parametrize("frequent", [1000, 8])
def test_exact_dedup(docs, rows, frequent, monkeypatch):
    monkeypatch.setattr(common, "FREQUENT", frequent)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(-1 if r[0] is None else r[0])
    for size in (8192, 16):
        got = exact_dedup.exact_dedup(docs, block_bytes=size).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((r[0], max(groups[r[1] or ""]), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
        kept = Counter((r.text_sha256, r.doc_id) for r in got if r.kept)
        assert set(kept.values()) == {1} and {k for k in kept} == {(hashlib.sha256(t.encode()).hexdigest(), max(g)) for t, g in groups.items()}


def test_sharding(docs, rows):
    got = sharding.shard(docs, shards=4).collect()
    raw = [(r[1] or "").encode() for r in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len(t) + 8, zlib.crc32(t)) for r, t in zip(rows, raw, strict=True))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert got == sharding.shard(docs, shards=4).collect() or Counter(got) == Counter(sharding.shard(docs, shards=4).collect())


def test_sharding_is_the_matrix_replayed(docs):
    """Plain permutations of each partition, dealt out by the matrix, and of each shard."""
    h = lambda seed: F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nr"), h(7).alias("h1"), h(8).alias("h2")).collect()
    rng, parts = random.Random(7), sorted({r.part for r in rows})
    sizes = [len(rows) // 5 + (k < len(rows) % 5) for k in range(5)]
    rng.shuffle(sizes)
    matrix = sharding.communication_matrix(rng, [sum(r.part == p for r in rows) for p in parts], sizes)
    assert len(parts) > 1 and [sum(c) for c in zip(*matrix, strict=True)] == sizes
    received = [[] for _ in range(5)]
    for p, line in zip(parts, matrix, strict=True):
        own = iter(sorted((r for r in rows if r.part == p), key=lambda r: (r.h1, r.nr)))
        for k, n in enumerate(line):
            received[k] += [next(own) for _ in range(n)]
    want = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), k, slot) for k, some in enumerate(received) for slot, r in enumerate(sorted(some, key=lambda r: (r.h2, r.nr)))]
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, shards=5).collect()]
    assert Counter(got) == Counter(want)


def test_sharding_in_several_windows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WINDOW_ROWS", 20)
    got = sharding.shard(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), shards=3).collect()
    for k in range(3):
        order = sorted((r.slot, r.doc_id) for r in got if r.shard == k)
        assert [s for s, _ in order] == list(range(len(order))) and abs(len(order) - 333) <= 1
        ids = [d for _, d in order]
        assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.2


def test_hypergeometric_has_the_right_distribution():
    rng = random.Random(4)
    xs = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(xs.mean() - 6) < 0.15 and abs(xs.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    big = sharding.hypergeometric(rng, 10**10, 23 * 10**10, 10**7)
    assert abs(big - 10**7 / 24) < 6 * (10**7 / 24) ** 0.5
    m = sharding.communication_matrix(rng, [5, 0, 17, 3], [9, 8, 8])
    assert [sum(x) for x in m] == [5, 0, 17, 3] and [sum(c) for c in zip(*m, strict=True)] == [9, 8, 8]


def test_quality(docs, rows):
    b = quality.Bands()
    got = {}
    for r in quality.quality(docs).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:8])
    for r in rows:
        text = r[1] or ""
        words, lines, seen, dups = text.encode().split(), text.split("\n"), set(), 0
        for x in lines:
            if x.strip(" \t\n\r\x0b\x0c"):
                dups += x in seen
                seen.add(x)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = Counter(grams)
        inside = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        mine = (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dups, len(inside), failed)
        assert mine in [g[:6] for g in got[r[0]]]
        assert all(not g[6] for g in got[r[0]] if g[5])
    rng = random.Random(6)
    noise = bytes(rng.choices(range(33, 127), k=9000)).decode()
    junk = " ".join(noise[k : k + 9] for k in range(0, 9000, 9))
    rules = quality.Rules(b)
    clean = prose(rng, 900, ["".join(rng.choice("th er on an re in ed at en ti es or st is ou ing tion ha le nd".split()) for _ in range(rng.randrange(1, 4))) for _ in range(3000)])
    assert rules.row(clean.encode())[6] and not rules.row(junk.encode())[6] and not rules.row(("ab cd " * 900).encode())[6]
    assert not rules.row((clean[:4096] + junk[:9000]).encode())[6]


def test_langid(spark):
    rng = random.Random(8)
    vocab = {"en": ["the", "and", "thing", "with", "which"], "de": ["der", "und", "nicht", "schön", "straße"], "fr": ["le", "où", "être", "français", "mais"]}
    make = lambda x, n: " ".join(rng.choice(vocab[x]) for _ in range(n))
    train = spark.createDataFrame([(make(x, 30), x) for x in vocab for _ in range(40)] + [(None, "en"), ("the", None), ("!!", "de")], "text string, lang string")
    model = langid.fit(train, per_lang=30)
    test = [(k, make(x, 20), x) for k, x in enumerate(list(vocab) * 20)] + [(100, None, "en"), (101, "12 !", "en"), (102, "", "de"), (None, make("de", 9), "de"), (103, "日本語", "en")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(test, "doc_id bigint, text string, lang string"), model).collect()}
    assert all(got[k].lang_pred == x for k, _, x in test[:60]) and got[None].lang_pred == "de"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (100, 101, 102)) and got[103].lang_pred in vocab
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(train.where("false")) is None
    assert {r.lang_pred for r in langid.predict(spark.createDataFrame(test, "doc_id bigint, text string, lang string"), None).collect()} == {"und"}


def test_empty_tables(empty):
    assert simhash.near_dedup(empty).count() == 0
    assert suffix_tree.score(empty, F.lit(False)).count() == 0
    assert licenses.scan(empty, F.col("source")).count() == 0
    assert packing.pack(empty, PATH).count() == 0
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert warc.derivatives(warc.responses(empty, "doc_id", "source", "text")).count() == 0


def test_half_of_all_rows_alike(spark, tmp_path):
    """One text, one word and one block in half of all rows."""
    rng = random.Random(3)
    texts = ["the same text again and again " * 3] * 600 + ["the " * rng.randrange(1, 40) + prose(rng, rng.randrange(5, 40)) for _ in range(600)]
    rng.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[t].append(k)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, block_bytes=16).collect()} == {(k, max(g), len(g)) for g in groups.values() for k in g}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_dedup(docs).collect()}
    assert got.keys() == set(range(1200)) and all(got[k][0] == brute_fingerprint(t) for t, g in groups.items() for k in g[:1])
    assert all(len({got[k] for k in g}) == 1 and got[g[0]][1] <= min(g) for g in groups.values())
    roots = {r.node: r.root for r in simhash.near_copies(docs, "doc_id").collect()}
    assert all(roots.get(k, k) == min(roots.get(x, x) for x in g) for g in groups.values() for k in g)
    scores = {r.doc_id: r.score for r in suffix_tree.score(docs, F.col("doc_id") % 10 == 0, bucket_bytes=5000, group_bytes=9000).collect()}
    assert all(len({round(scores[k], 6) for k in g}) == 1 for g in groups.values())
    packed = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in packed) == sum((len(library(t)) + 1) * len(g) for t, g in groups.items())
