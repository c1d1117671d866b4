"""Near-duplicates by SimHash, linked through the generalised pigeonhole principle.

Every text gets a 64-bit fingerprint.  To find fingerprints that differ in at most ``t`` bits the 64
bits are grouped into ``m`` parts, correlated bits together.  If thresholds of the parts sum to
``t - m + 1``, two linked fingerprints are within the threshold in at least one part (a threshold of
-1 leaves a part out).  Each fingerprint gets its own thresholds by dynamic programming over the
candidates it is estimated to meet, which steers it away from crowded part values.  It probes all
values within the threshold, and candidates are verified on all 64 bits.

Only distinct fingerprints take part.  The histograms behind the estimates are of fixed size.  A
bucket that is expected to be large is dealt out as pairs of blocks, each a task of bounded memory;
every pair still meets.  One that is large against expectation is searched by further groups of bits
where it is.  A task joins the links it verifies into stars, so that what leaves it is
linear in what it read, and connectivity is kept exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, drop_cut, join_counted, partitions, raw_texts, small_batches
from .components import components
from .jaccard import near_roots, shingles

BITS = 64
#: Bits of a cell: the widest histogram that estimates use.
CELL = 16
#: A bucket expected to hold more fingerprints than this is dealt out as pairs of blocks.
BLOCK = 4096
#: Candidates that one probed value costs as much as.
PROBE_COST = 1.0
_ONE = np.uint64(1)
_FPS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_ROWS = pa.schema([("part", pa.int32()), ("value", pa.int64()), ("sub", pa.int64()), ("fp", pa.int64())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(raw: bytes, width: int = 3) -> int:
    """SimHash of a text's bytes: shingles of ``width`` words, repeats included; no word: 0."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)), repeat(42))
    n = len(words) - width + 1
    return _majority((np.fromiter(hashes, np.uint64, min(65536, n - at)) for at in range(0, n, 65536)), n)


def set_fingerprint(raw: bytes, width: int = 5) -> int:
    """SimHash of a text's set of shingles, each counted once, so that a line repeated many times doesn't outweigh the rest."""
    h = shingles(raw, width).view(np.uint64)
    return _majority((h[at : at + 65536] for at in range(0, len(h), 65536)), len(h))


def _majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in over half of ``n`` hashes, which come in pieces."""
    counts = np.zeros(BITS, np.int64)
    for some in hashes:
        counts += _bits(some).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int, of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = np.fromiter((of(raw, width) for raw in raw_texts(rows.column(1))), np.uint64, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps.view(np.int64))], schema=_FPS)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, of=fingerprint) -> DataFrame:
    """``doc_id`` (long) and ``fp`` (the 64 bits as a signed long) of every row; ``of`` makes them from a text's bytes and the width."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_fingerprints(width, of), "doc_id bigint, fp bigint")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of bits is set together; the diagonal has single bits."""
    total = np.zeros((BITS, BITS))
    for rows in batches:
        b = _bits(rows.column(0).to_numpy()).astype(np.float32)
        total += b.T @ b
    yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])


def group_bits(moments: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` groups of equal size; each grows from the most correlated free bit by the bits that correlate most with it."""
    p = np.diag(moments) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((moments / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for left in range(m, 0, -1):
        size = -(-len(free) // left)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (corr[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(group)
    return groups


def parts_for(n: int, t: int) -> int:
    """Number of parts: as many, so as few probes, as leave about 64 fingerprints or fewer to a value; at most ``t + 1``."""
    m = t + 1
    while m > 2 and n / 2 ** (BITS // m) > 64:
        m -= 1
    return m


def _codes(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    u, out = fps.view(np.uint64), np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & _ONE) << np.uint64(k)
    return out.view(np.int64)


def _cells(groups: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(part, bits) of each cell; a part is split into the fewest cells of at most CELL bits."""
    out = []
    for part, bits in enumerate(groups):
        k = -(-len(bits) // CELL)
        out += [(part, bits[len(bits) * i // k : len(bits) * (i + 1) // k]) for i in range(k)]
    return out


def _histogram(cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(bits), np.int64) for _, bits in cells]
        for rows in batches:
            fps = rows.column(0).to_numpy()
            for c, (_, bits) in zip(counts, cells, strict=True):
                c += np.bincount(_codes(fps, bits), minlength=len(c))
        for k, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(c[at])], names=["cell", "value", "n"])

    return run


def at_distance(counts: np.ndarray, most: int) -> np.ndarray:
    """[d, v]: how many lie at exactly ``d`` bits from value ``v``, for d up to ``most``."""
    out = np.zeros((most + 1, len(counts)))
    out[0] = counts
    values = np.arange(len(counts))
    for k in range(len(counts).bit_length() - 1):
        out[1:] += out[:-1][:, values ^ (1 << k)]
    return out


class Allocator:
    """Thresholds for fingerprints, from histograms of the cells."""

    def __init__(self, groups: list[list[int]], counts: list[np.ndarray], n: int, t: int):
        self.groups, self.cells, self.n, self.t = groups, _cells(groups), n, t
        self.near = [at_distance(c, t) for c in counts]
        self.masks = [[np.array([sum(1 << b for b in some) for d in range(r + 1) for some in combinations(range(len(bits)), d)], np.int64) for r in range(t + 1)] for bits in groups]

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """[part, threshold + 1, fingerprint]: candidates that a threshold is estimated to give, and its probes."""
        out = np.zeros((len(self.groups), self.t + 2, len(fps)))
        for part, bits in enumerate(self.groups):
            poly = None
            for (owner, cell), near in zip(self.cells, self.near, strict=True):
                if owner == part:
                    own = near[:, _codes(fps, cell)]
                    poly = own if poly is None else np.stack([sum(poly[j] * own[d - j] for j in range(d + 1)) / max(self.n, 1) for d in range(self.t + 1)])
            out[part, 1:] = np.cumsum(poly, axis=0) + PROBE_COST * np.array([len(x) for x in self.masks[part]])[:, None]
        return out

    def thresholds(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[part, fingerprint]: thresholds of least total cost that sum to t - m + 1; and the costs."""
        cost, m = self.costs(fps), len(self.groups)
        goal = self.t - m + 1 + m  # thresholds counted from -1
        best, choice = np.full((goal + 1, len(fps)), np.inf), np.zeros((m, goal + 1, len(fps)), np.int8)
        best[0] = 0
        for part in range(m):
            new = np.full_like(best, np.inf)
            for s in range(goal + 1):
                for x in range(min(s, self.t + 1) + 1):
                    total = best[s - x] + cost[part, x]
                    better = total < new[s]
                    new[s][better], choice[part, s][better] = total[better], x
            best = new
        left, out = np.full(len(fps), goal), np.zeros((m, len(fps)), np.int64)
        for part in range(m - 1, -1, -1):
            x = choice[part, left, np.arange(len(fps))]
            out[part] = x - 1
            left = left - x
        return out, cost


def _prober(model):
    """Rows (part, value, sub, fp): a fingerprint's own values, which index it, and the values that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alloc: Allocator = model.value
        for rows in batches:
            for at in range(0, rows.num_rows, 8192):
                fps = rows.column(0).to_numpy()[at : at + 8192]
                chosen, cost = alloc.thresholds(fps)
                for part, bits in enumerate(alloc.groups):
                    codes = _codes(fps, bits)
                    for r in range(-1, alloc.t + 1):
                        some = np.flatnonzero(chosen[part] == r)
                        masks = alloc.masks[part][max(r, 0)]
                        if len(some):
                            value, fp = (codes[some][:, None] ^ masks).ravel(), np.repeat(fps[some], len(masks))
                            yield from _dealt(part, value, fp, alloc)

    return run


def _dealt(part: int, value: np.ndarray, fp: np.ndarray, alloc: Allocator) -> Iterator[pa.RecordBatch]:
    expected = None
    for (owner, cell), near in zip(alloc.cells, alloc.near, strict=True):
        if owner == part:
            low = alloc.groups[part].index(cell[0])
            own = near[0][(value >> low) & ((1 << len(cell)) - 1)]
            expected = own if expected is None else expected * own / max(alloc.n, 1)
    blocks = np.maximum(1, np.ceil(expected / BLOCK)).astype(np.int64)
    for k in np.unique(blocks):
        some = blocks == k
        v, f = value[some], fp[some]
        block = ((f.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % k
        for other in range(k):
            sub = np.minimum(block, other) * k + np.maximum(block, other)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), part, np.int32)), pa.array(v), pa.array(sub), pa.array(f)], schema=_ROWS)


def link_stars(bucket: np.ndarray, fps: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links of at most ``t`` bits join within each bucket (rows sorted by bucket)."""
    label, n = np.arange(len(fps)), len(fps)
    u, at, lag = fps.view(np.uint64), np.arange(len(fps)), 0
    while len(at):
        lag += 1
        at = at[at + lag < n]
        at = at[bucket[at] == bucket[at + lag]]
        if not len(at):
            break
        i = at[np.bitwise_count(u[at] ^ u[at + lag]) <= t]
        i = i[label[i] != label[i + lag]]
        a, b = i, i + lag
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
            keep = label[a] != label[b]
            a, b = a[keep], b[keep]
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def links_of(bucket: np.ndarray, fps: np.ndarray, t: int, crowd: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """``link_stars``; a bucket of more than ``crowd`` is searched by each of t + 1 groups of bits, one of which two linked ones share."""
    change = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
    large = np.repeat(np.diff(change) > crowd, np.diff(change))
    found = [link_stars(bucket[~large], fps[~large], t)]
    some, owner = fps[large], bucket[large]
    for k in range(t + 1 if len(some) else 0):
        low, high = BITS * k // (t + 1), BITS * (k + 1) // (t + 1)
        key = (some.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << high - low) - 1)
        order = np.lexsort((key, owner))
        turn = (np.diff(key[order], prepend=key[order[0]]) != 0) | (np.diff(owner[order], prepend=owner[order[0]]) != 0)
        found.append(link_stars(np.cumsum(turn), some[order], t))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _verifier(t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        for rows in batches:
            new = [rows.column(k).to_numpy() for k in range(4)]
            keep = new if keep is None else [np.concatenate(x) for x in zip(keep, new, strict=True)]
            part, value, sub, _ = keep
            change = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0) | (np.diff(sub) != 0))
            if not len(change):
                continue
            end = change[-1] + 1
            yield batch(_EDGES, links_of(np.searchsorted(change, np.arange(end)), keep[3][:end], t))
            keep = [x[end:].copy() for x in keep]
        if keep is not None and len(keep[3]):
            yield batch(_EDGES, links_of(np.zeros(len(keep[3]), np.int64), keep[3], t))

    return run


def near_edges(distinct: DataFrame, t: int = 3) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints (column ``fp``) with the same components as all links of at most ``t`` bits."""
    spark = distinct.sparkSession
    own = distinct.select("fp")
    sums = own.mapInArrow(_moments, "sums array<double>").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    n = own.count()
    moments = np.zeros(BITS * BITS)
    for k, x in sums:  # 4,096 numbers
        moments[k] = x
    groups = group_bits(moments.reshape(BITS, BITS), n, parts_for(n, t))
    cells = _cells(groups)
    counts = [np.zeros(1 << len(bits), np.int64) for _, bits in cells]
    for k, v, x in own.mapInArrow(_histogram(cells), "cell int, value bigint, n bigint").groupBy("cell", "value").agg(F.sum("n")).toLocalIterator():
        counts[k][v] = x  # at most 2^16 values for each of at most eight cells
    model = spark.sparkContext.broadcast(Allocator(groups, counts, n, t))
    rows = own.mapInArrow(_prober(model), "part int, value bigint, sub bigint, fp bigint")
    key = ["part", "value", "sub"]
    return rows.repartition(partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(_verifier(t), "u bigint, v bigint")


def linked(fps: DataFrame, t: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of rows of ``fingerprints``: ``component_id`` is the least id reachable over links of at most ``t`` bits.

    A fingerprint or component of many rows gets its result by a bounded broadcast.
    """
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    n, total = distinct.agg(F.count("*"), F.sum("rows")).first()
    roots = cut(components(near_edges(distinct, t)))
    of = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    groups = cut(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    named = cut(join_counted(of, groups, ["root"], "fps", n).select("fp", "rows", "component_id"))
    for x in (distinct, roots, of, groups):
        drop_cut(x)
    return join_counted(fps, named, ["fp"], "rows", total or 0).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, t: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` has 16 lowercase hex digits; texts without a word, null ones too, have zero and
    are linked like any other.  ``component_id`` is the smallest id reachable over links of at most
    ``t`` bits, null only where all of a component's ids are null.  Repeated rows come back as often
    as they are there.  An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    fps = cut(fingerprints(docs, id_col, text_col, width))
    return linked(fps, t).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, nr_col: str = "nr", text_col: str = "text", width: int = 5, t: int = 3) -> DataFrame:
    """``node, root`` of each text that is near another: sets of ``width``-word shingles whose fingerprints differ in at most ``t`` bits, or that have a Jaccard similarity of 0.8 or more.

    ``root`` is the least number of the texts that such links join; ``nr_col`` numbers the rows and has
    no null and no number twice.  A null text counts as empty.  Links of fingerprints stand, also
    below that similarity.  At it fingerprints differ by ten bits on average, more than pigeonholes
    can search, so ``jaccard`` adds all links that have it.
    """
    small_batches(docs.sparkSession)
    of = linked(cut(fingerprints(docs, nr_col, text_col, width, set_fingerprint)), t)
    return near_roots(docs, of.where("doc_id <> component_id").select(F.col("component_id").alias("u"), F.col("doc_id").alias("v")), nr_col, text_col, width)
