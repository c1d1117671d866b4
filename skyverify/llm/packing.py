"""Packing documents into sequences by fitting length patterns to the histogram.

Patterns of up to three lengths that fill a sequence exactly are enumerated.  Non-negative least
squares fits how often each is used to the histogram of lengths, the counts are rounded within what
the histogram holds, and what is left over is packed by best fit, longest first.  All of this sees
only the histogram, so the driver's work is bounded by the sequence length, whatever the corpus.

Pieces then get their places by rank: the r-th piece of a length takes that length's r-th place.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, SpacedEncoder, Vocabulary
from .common import batch, cut, release, small_batches

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
_PIECE_SQL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def patterns(size: int) -> np.ndarray:
    """All multisets of one to three lengths that sum to ``size``, descending, zero where there is none."""
    out = [(size, 0, 0)] + [(size - b, b, 0) for b in range(1, size // 2 + 1)]
    for c in range(1, size // 3 + 1):
        b = np.arange(c, (size - c) // 2 + 1)
        out.append(np.stack([size - c - b, b, np.full(len(b), c)], axis=1))
    return np.concatenate([np.array(out[: size // 2 + 1]), *out[size // 2 + 1 :]])


def nonnegative_fit(pats: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Counts x >= 0 of least squared error of the lengths they use against ``hist``, by accelerated projected gradient."""
    size, flat = len(hist), pats.ravel()
    used = np.bincount(flat, minlength=size)
    used[0] = 0
    # long pieces are hard to place later, so their error weighs more
    weight = 1.0 + np.arange(size) / size
    x = y = np.zeros(len(pats))
    step, t = 1.0 / max(1.0, 3.0 * (used * weight).max()), 1.0
    for _ in range(rounds):
        made = np.bincount(flat, np.repeat(y, 3), minlength=size)
        error = (made - hist) * weight
        error[0] = 0
        new = np.maximum(0.0, y - step * error[pats].sum(axis=1))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def plan(hist: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) of the sequences that hold exactly the pieces of ``hist``, each at most ``size`` long."""
    left = np.zeros(size + 1, np.int64)
    for length, n in hist.items():
        left[length] = n
    out: list[tuple[int, tuple[int, ...]]] = []
    if left[size]:
        out.append((int(left[size]), (size,)))
        left[size] = 0
    pats = patterns(size)
    pats = pats[(pats[:, 0] < size) & ((left[pats] > 0) | (pats == 0)).all(axis=1)]
    if len(pats):
        fit = nonnegative_fit(pats, left.astype(float))
        for k in np.argsort(-fit, kind="stable"):
            if (want := int(fit[k] + 0.5)) < 1:
                break
            some = Counter(int(v) for v in pats[k] if v)
            n = min(want, *(int(left[v]) // c for v, c in some.items()))
            if n > 0:
                out.append((n, tuple(int(v) for v in pats[k] if v)))
                for v, c in some.items():
                    left[v] -= n * c
    # best fit of the rest, longest first; equal sequences are handled together
    room: dict[int, list[list]] = {}

    def put(n: int, lengths: tuple[int, ...], free: int) -> None:
        room.setdefault(free, []).append([n, lengths])

    for length in range(size - 1, 0, -1):
        n = int(left[length])
        while n:
            fitting = [free for free in room if free >= length]
            if not fitting:
                many = max(1, n // max(1, size // length))
                put(many, (length,), size - length)
                n -= many
                continue
            free = min(fitting)
            group = room[free].pop()
            if not room[free]:
                del room[free]
            k = min(n, group[0])
            if k < group[0]:
                put(group[0] - k, group[1], free)
            put(k, (*group[1], length), free - length)
            n -= k
    return out + [(n, lengths) for groups in room.values() for n, lengths in groups]


def places(plan_rows: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Runs of places sorted by (length, first rank): the r-th piece of a length is in sequence ``seq + r - rank``."""
    used: Counter = Counter()
    rows, seq = [], 0
    for n, lengths in plan_rows:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], seq, offset))
            used[length] += n
            offset += length
        seq += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "seq", "offset"), cols, strict=True))


def pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document's ids; ``rank`` counts a partition's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what the worker's earlier tasks left
        encode, end = library_encoder(path), end_id.to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), Counter()
        for rows in batches:
            out = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                starts = [0, *range(n % size or size, n, size)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            yield batch(_PIECES, list(zip(*out, strict=True)) or [[]] * len(_PIECES))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, _PIECE_SQL)


_encoders: dict[str, SpacedEncoder] = {}


def library_encoder(path: str) -> SpacedEncoder:
    """Ids of the tokenizers library as little-endian 32-bit bytes, with results of single words kept.

    Where a vocabulary's ids are in the order of its merges, tiktoken's merge loop gives the same ids
    several times faster and is used; any other file goes through tokenizers itself.
    """
    if path not in _encoders:
        vocab = Vocabulary(path)
        special = list(vocab.special)
        made = [new for _, new in vocab.merges.values()]
        if made == sorted(made) and max(vocab.of_byte) < min(made):
            import tiktoken

            own = set(vocab.special.values())
            ranks = {s: i for i, s in enumerate(vocab.strings) if s and i not in own}
            t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=vocab.special)
            whole = lambda text: array("I", t.encode(text, allowed_special="all")).tobytes()
            plain = lambda text: array("I", t.encode_ordinary(text)).tobytes()
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            plain = whole = lambda text: array("I", t.encode(text, add_special_tokens=False).ids).tobytes()
        _encoders[path] = SpacedEncoder(whole, special, plain)
    return _encoders[path]


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A document's ids are those of its text and ``end_id``; only documents over ``size`` ids are cut,
    the first piece being the shorter one.  A null text counts as empty, which leaves ``end_id``.
    Ids may be null or repeated: each row is packed on its own.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    got = cut(pieces(docs, path, size, end_id, id_col, text_col))
    counts = got.groupBy("part", "length").count()
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``size`` numbers
    runs = spark.sparkContext.broadcast(places(plan(hist, size)))
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        key = (r["length"] << 44) | r["rank"]
        for rows in batches:
            length, rank = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            k = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(r["seq"][k] + rank - r["rank"][k]), pa.array(r["offset"][k])], names=[*rows.schema.names[:5], "sequence_id", "offset"])

    ranked = got.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
