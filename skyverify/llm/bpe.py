"""Byte-pair encoding and decoding with a given byte-level vocabulary.

A pre-token's bytes form a doubly linked list of symbols.  Adjacent pairs that can merge wait in a
priority queue by (merge rank, place); an entry whose symbols have changed meanwhile is stale and is
skipped.  So a pre-token of n bytes takes O(n log n) steps.  Decoding concatenates the vocabulary's
strings.  Results of short pre-tokens are kept by each worker in a table of bounded size.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, small_batches

#: How the library splits text before merges (fixed value of byte-level vocabularies of this kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each of a worker's tables, and the longest text that gets one.
TABLE, LONGEST = 400_000, 48
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary()), ("n_tokens", pa.int64())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary()), ("n_tokens", pa.int64()), ("decoded", pa.large_string())])


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Bounded(dict):
    """A table that fills itself through ``make`` and starts anew when it is full."""

    def __init__(self, make: Callable, size: int = TABLE):
        self.make, self.size = make, size

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value


class SpacedEncoder:
    """Ids of texts as little-endian 32-bit bytes, word by word.

    No pre-token crosses the place before a space that follows a non-space, so what stands between
    two such places is encoded on its own and looked up when it returns.  ``whole`` encodes any text;
    texts with white space before a space, and those with a special token, go to it at once.
    """

    def __init__(self, whole: Callable[[str], bytes], special: list[str], plain: Callable[[str], bytes] | None = None, size: int = TABLE):
        """``plain`` encodes a text without special tokens, if that is faster; ``size`` bounds the table of words."""
        self.whole, plain = whole, plain or whole
        self.odd = re.compile("|".join([r"\s ", *map(re.escape, special)]))
        self.spaced = Bounded(lambda word: plain(" " + word), size)

    def __call__(self, text: str) -> bytes:
        if self.odd.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        return self.whole(first) + b"".join(map(self.spaced.__getitem__, words))


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.strings = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in ids.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.of_byte = [ids[c] for c in letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.split = regex.compile(PATTERN).findall
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = Bounded(self.encode_word)
        self.encode = SpacedEncoder(self.encode_whole, list(self.special))

    def merge(self, symbols: list[int]) -> list[int]:
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(m[0], i, m[1], a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (m := merges.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # stale
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(queue, (m[0], i, m[1], new, symbols[k]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(queue, (m[0], h, m[1], symbols[h], new))
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> bytes:
        return array("I", self.merge([self.of_byte[b] for b in word.encode()])).tobytes()

    def encode_whole(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.cut_special.finditer(text) if self.cut_special else ():
            out += map(self.words.__getitem__, self.split(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += map(self.words.__getitem__, self.split(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens`` of every row; ``ids`` are little-endian unsigned 32-bit integers.

    Ids are those of the tokenizers library for the file at ``path``, which every executor must have.
    A null text counts as empty and has no ids.  Repeated rows and null ids come back as they are.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for rows in batches:
            ids = [v.encode(t or "") for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.large_binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], schema=_ENCODED)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids binary, n_tokens bigint")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (of ``encode``) with ``decoded``, the text; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for rows in batches:
            yield batch(_DECODED, [*(c.cast(f.type) for c, f in zip(rows.columns, _ENCODED, strict=True)), [v.decode(x.as_py()) for x in rows.column(1)]])

    return encoded.mapInArrow(run, "doc_id bigint, ids binary, n_tokens bigint, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``decode``'s rows."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
