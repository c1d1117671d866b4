"""Quality rules: counts over words and lines, then compression bands.

Text that repeats itself compresses too well, and text without language hardly at all.  The
zstandard ratio (compressed bytes over bytes) of a whole text must lie in a band that depends on its
length, since short texts compress less.  A text of several chunks is also rejected when too many of
its fixed chunks leave the chunk's band, which finds junk beside good text.

The bands are the ratios of the clean documents of sf0.1 (label quality 1, base rules passed), from
the least to the greatest of each range of bytes, with a margin of 0.03; 0.02 above for chunks.  Below
4 kB prose and random hex compress alike.  There, a text with about as many distinct pairs of
neighbouring bytes as its own bytes in random order is salad: clean documents have up to 0.78 of
them, random hex, letters and base64 0.90 or more.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks", "chunks"]
_SQL = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, bad_chunks bigint, chunks bigint"


@dataclass(frozen=True)
class Bands:
    """Limits of ratios.  ``low`` and ``high`` have one limit more than ``sizes``: one for each range of bytes."""

    sizes: tuple[int, ...] = (256, 512, 1024, 2048, 4096, 8192, 16384, 65536)
    low: tuple[float, ...] = (0.45, 0.51, 0.47, 0.43, 0.42, 0.39, 0.38, 0.37, 0.20)
    high: tuple[float, ...] = (1.10, 0.76, 0.72, 0.61, 0.56, 0.505, 0.485, 0.46, 0.46)
    pairs: float = 0.85
    pairs_below: int = 4096
    chunk: int = 4096
    chunk_low: float = 0.41
    chunk_high: float = 0.505
    bad_share: float = 0.25
    level: int = 3


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text's UTF-8 bytes."""
    text, words = raw.decode(), raw.split()
    chars = len(text) - sum(map(text.count, SPACE))
    seen: set[bytes] = set()
    dups = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dups += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times, repeats = Counter(windows), 0
    if len(times) < len(windows):
        twice = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
        cover = np.zeros(len(words), bool)
        for k in range(3):
            cover[k : k + len(windows)] |= twice
        repeats = int(cover.sum())
    return len(words), chars, sum(map(text.count, SYMBOLS)), dups, repeats


def pair_share(raw: bytes) -> float:
    """Distinct pairs of neighbouring bytes over those of the same bytes in random order, the same for equal texts."""
    if len(raw) < 2:
        return 0.0
    x = np.frombuffer(raw.lower(), np.uint8)
    own, mixed = (len(np.unique(y[:-1].astype(np.int32) << 8 | y[1:])) for y in (x, np.random.default_rng(len(x)).permutation(x)))
    return own / mixed


class Rules:
    """The rules with a compressor that a worker keeps."""

    def __init__(self, bands: Bands):
        self.bands, self.compress = bands, zstandard.ZstdCompressor(level=bands.level).compress

    def ratios(self, raw: bytes) -> tuple[float, list[float]]:
        """Of the whole text, and of its chunks; the last chunk ends with the text."""
        size = self.bands.chunk
        starts = [*range(0, len(raw) - size, size), len(raw) - size] if len(raw) > size else []
        return len(self.compress(raw)) / max(len(raw), 1), [len(self.compress(raw[a : a + size])) / size for a in starts]

    def row(self, raw: bytes) -> tuple:
        b, counts = self.bands, base_counts(raw)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        whole, chunks = self.ratios(raw)
        k = bisect_right(b.sizes, len(raw))
        bad = sum(not b.chunk_low <= x <= b.chunk_high for x in chunks)
        kept = not failed and b.low[k] <= whole <= b.high[k] and bad <= b.bad_share * len(chunks)
        kept = kept and (len(raw) >= b.pairs_below or pair_share(raw) <= b.pairs)
        return (*counts, failed, kept, whole, bad, len(chunks))


def measured(text: Column, bands: Bands = Bands()) -> Column:  # noqa: B008
    """A struct of the counts and verdicts of each text; see ``quality``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules = Rules(bands)
        for texts in batches:
            yield pd.DataFrame([rules.row((t or "").encode()) for t in texts], columns=_FIELDS)

    return F.pandas_udf(run, _SQL)(text.cast("string"))


def quality(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """``doc_id``, counts, ``base_failed``, ``kept``, the whole text's ``ratio``, ``bad_chunks`` and ``chunks`` of every row.

    A null or empty text has no words, so it fails.  Rows are judged one by one: ties, repeated rows
    and null ids change nothing.  An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), measured(docs[text_col], bands).alias("r")).select("doc_id", "r.*")


def keep_good(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that the rules keep, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"), measured(docs[text_col], bands).alias("r")).where("r.kept").select("row.*")
