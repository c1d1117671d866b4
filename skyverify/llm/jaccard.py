"""Links by the exact Jaccard similarity of word shingles, beside links that are given.

Two texts are linked if their sets A and B of shingles have |A & B| / |A | B| >= 4/5, so each shares
at least four fifths of its own set.  Shingles of a single text are left out first, and with them
all texts of which too little is left.  The rest is ordered by the number of texts with it, rarest
first; two linked texts then share a shingle within the first n - ceil(4n/5) + 1 of both (their
prefixes), so every linked pair meets in a bucket of prefix rows.  At the first shingle that they
share, each has as many left, that one included, as both have in common or more; so a pair counts only
where both have at least 4/9 of their sizes' sum left.

A large group of near copies meets in every bucket.  So each text's pair with its bucket's most
shared text and with its neighbour by size comes first, which is linear; then a text is compared with
all of its bucket that neither this nor the given links have joined to it.  Every pair in question is compared on the whole sets.
What a task holds is one bucket of hashes, whose number grows with the input, or one prefix bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, drop_cut, partitions, raw_texts, release, small_batches
from .components import components

#: The least similarity as a fraction, so that limits are exact.
NUM, DEN = 4, 5
#: Pairs of one Arrow batch, and text bytes for each bucket of shingles.
CHUNK, BUCKET_BYTES = 1 << 16, 4_000_000
_BLOBS = pa.schema([("p", pa.int32()), *((c, pa.large_binary()) for c in ("h", "nr", "n", "df"))])
_BLOBS_SQL = "p int, h binary, nr binary, n binary, df binary"
_SETS = pa.schema([("nr", pa.int64()), ("n", pa.int64()), ("shared", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingles(raw: bytes, width: int = 5) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    words = raw.lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64).view(np.int64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(words) - width + 1).view(np.int64))


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    mixed = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _blobs(p: np.ndarray, h: np.ndarray, nr: np.ndarray, n: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket; numbers of texts and their sizes as differences, which compress."""
    order = np.lexsort((nr, p))
    ends = np.flatnonzero(np.diff(p[order], append=-1)) + 1
    rows: list[list] = [[] for _ in _BLOBS]
    for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
        at = order[a:b]
        for out, x in zip(rows, (p[at[0]], h[at].tobytes(), np.diff(nr[at], prepend=0).tobytes(), np.diff(n[at], prepend=0).tobytes(), df[at].astype(np.int32).tobytes()), strict=True):
            out.append(x)
    if rows[0]:
        yield batch(_BLOBS, rows)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """h, nr, n, df of each bucket, from rows of ``_blobs`` that are sorted by bucket."""
    now, parts = None, []

    def whole():
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    for rows in batches:
        columns = [c.to_pylist() for c in rows.columns]
        for p, h, nr, n, df in zip(*columns, strict=True):
            if p != now and parts:
                yield whole()
                parts = []
            now = p
            parts.append((np.frombuffer(h, np.int64), np.cumsum(np.frombuffer(nr, np.int64)), np.cumsum(np.frombuffer(n, np.int64)), np.frombuffer(df, np.int32)))
    if parts:
        yield whole()


def _spread(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sets = [shingles(raw, width) for raw in raw_texts(rows.column(1))]
            if sets:
                n = np.array([len(s) for s in sets])
                h = np.concatenate(sets)
                yield from _blobs(_bucket(h, buckets), h, np.repeat(rows.column(0).to_numpy(), n), np.repeat(n, n), np.zeros(len(h), np.int32))

    return run


def _shared(buckets: int):
    """Shingles of two texts or more, with their number of texts, dealt out by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, nr, n, _ in _gathered(batches):
            _, at, df = np.unique(h, return_inverse=True, return_counts=True)
            df = df[at]
            some = df > 1
            if some.any():
                yield from _blobs(_bucket(nr[some], buckets), h[some], nr[some], n[some], df[some])
        release()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared shingles of each text that shares enough of its own, rarest first."""
    for h, nr, n, df in _gathered(batches):
        order = np.lexsort((h, df, nr))
        h, nr, n = h[order], nr[order], n[order]
        starts = np.flatnonzero(np.diff(nr, prepend=nr[0] - 1))
        k = np.diff(starts, append=len(nr))
        enough = DEN * k >= NUM * n[starts]
        for a in range(0, len(starts), 1000):
            some = [i for i in range(a, min(a + 1000, len(starts))) if enough[i]]
            if some:
                yield batch(_SETS, [nr[starts[some]], n[starts[some]], [h[starts[i] : starts[i] + k[i]] for i in some]])


def _prefixes(sets: DataFrame) -> DataFrame:
    """``h, nr, n, rest`` for each shingle of a text's prefix; ``rest`` counts the shared ones from it on."""
    length = F.expr(f"cast(size(shared) - (({NUM} * n + {DEN - 1}) div {DEN}) + 1 as int)")
    return sets.select(F.posexplode(F.slice("shared", F.lit(1), length)).alias("at", "h"), "nr", "n", F.size("shared").alias("k")).select("h", "nr", "n", (F.col("k") - F.col("at")).cast("long").alias("rest"))


def _close(n: np.ndarray, rest: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether texts can be similar enough if this is the first shingle that they share."""
    return (NUM + DEN) * np.minimum(rest[i], rest[j]) >= NUM * (n[i] + n[j])


def _first(h: np.ndarray, nr: np.ndarray, n: np.ndarray, rest: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text with the one of its bucket that has the largest share left, and with the next by size."""
    order = np.lexsort((nr, -(rest / n), h))
    starts = np.flatnonzero(np.diff(h[order], prepend=~h[order[0]]))
    lead = np.repeat(order[starts], np.diff(starts, append=len(h)))
    yield lead, order
    order = np.lexsort((nr, n, h))
    same = h[order[1:]] == h[order[:-1]]
    yield order[:-1][same], order[1:][same]


def _rest(h: np.ndarray, nr: np.ndarray, n: np.ndarray, rest: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a bucket with different labels."""
    order = np.lexsort((nr, label, h))
    h, label = h[order], label[order]
    bucket_end = np.searchsorted(h, h, "right")
    turn = np.flatnonzero((np.diff(h, append=~h[-1]) != 0) | (np.diff(label, append=~label[-1]) != 0)) + 1
    run_end = turn[np.searchsorted(turn, np.arange(len(h)), "right")]
    count = bucket_end - run_end
    todo, total = np.flatnonzero(count), np.cumsum(count)
    while len(todo):
        take = max(1, int(np.searchsorted(total[todo], total[todo[0]] - count[todo[0]] + CHUNK, "right")))
        some, todo = todo[:take], todo[take:]
        c = count[some]
        i = np.repeat(some, c)
        j = np.repeat(run_end[some] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        yield order[i], order[j]


def _pairs(find):
    """Distinct pairs (within a batch) of texts that ``find`` names, from rows h, nr, n, rest and label, sorted by h."""

    def of(h, nr, n, rest, label):
        for i, j in find(h, nr, n, rest, label):
            use = (nr[i] != nr[j]) & _close(n, rest, i, j)
            if use.any():
                i, j = i[use], j[use]
                both = np.unique(np.stack([np.minimum(nr[i], nr[j]), np.maximum(nr[i], nr[j])]), axis=1)
                yield batch(_PAIRS, list(both))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        for rows in batches:
            new = [rows.column(k).to_numpy() for k in range(5)]
            keep = new if keep is None else [np.concatenate(x) for x in zip(keep, new, strict=True)]
            change = np.flatnonzero(np.diff(keep[0]))
            if len(change):
                end = change[-1] + 1
                yield from of(*(x[:end] for x in keep))
                keep = [x[end:].copy() for x in keep]
        if keep is not None and len(keep[0]):
            yield from of(*keep)
        release()

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        u, v, n, m = (rows.column(k).to_numpy() for k in range(4))
        keep = []
        for k, (a, b) in enumerate(zip(rows.column(4), rows.column(5), strict=True)):
            common = len(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True))
            if (NUM + DEN) * common >= NUM * (n[k] + m[k]):
                keep.append(k)
        yield batch(_PAIRS, [u[keep], v[keep]])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are similar enough on their whole sets."""
    a = sets.select(F.col("nr").alias("u"), F.col("n").alias("n"), F.col("shared").alias("a"))
    b = sets.select(F.col("nr").alias("v"), F.col("n").alias("m"), F.col("shared").alias("b"))
    return pairs.distinct().join(a, "u").join(b, "v").select("u", "v", "n", "m", "a", "b").mapInArrow(_similar, "u bigint, v bigint")


def near_roots(docs: DataFrame, links: DataFrame, nr_col: str = "nr", text_col: str = "text", width: int = 5) -> DataFrame:
    """``node, root`` for each text that is linked to another; ``root`` is its component's least number.

    ``links`` are pairs of numbers, ``u`` and ``v``, of texts that are linked whatever their
    similarity.  ``nr_col`` numbers the rows and has no null and no number twice.  A null text counts
    as empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tasks = partitions(spark)
    size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    buckets = max(tasks, -(-size // BUCKET_BYTES))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "p").sortWithinPartitions("p")

    texts = docs.select(docs[nr_col].cast("long").alias("nr"), docs[text_col].cast("string").alias("text"))
    shared = dealt(texts.mapInArrow(_spread(width, buckets), _BLOBS_SQL)).mapInArrow(_shared(buckets), _BLOBS_SQL)
    sets = cut(dealt(shared).mapInArrow(_sets, "nr bigint, n bigint, shared array<bigint>"))
    rows = _prefixes(sets)
    by = rows.withColumn("label", F.col("nr")).repartition(tasks, "h").sortWithinPartitions("h")
    first = cut(_verified(by.mapInArrow(_pairs(_first), "u bigint, v bigint"), sets).union(links.select("u", "v")))
    labels = cut(components(first).select(F.col("node").alias("nr"), F.col("root").alias("label")))
    marked = rows.join(labels, "nr", "left").select("h", "nr", "n", "rest", F.coalesce("label", "nr").alias("label"))
    by = marked.repartition(tasks, "h").sortWithinPartitions("h")
    rest = cut(_verified(by.mapInArrow(_pairs(_rest), "u bigint, v bigint"), sets))
    out = components(first.union(rest))
    for x in (sets, first, labels, rest):
        drop_cut(x)
    return out
