"""Language-model scores from a probabilistic suffix tree over words.

A text is its words in lower case and an end.  The tree's contexts are the last words before a place,
from none (the root) to ``depth``; the place before the first word is the end's.  The tree is grown
level by level.  Every word of the training texts is a candidate of depth one; a longer context is a
candidate if it occurs ``least`` times there, the context without its first word is retained, and that
without its last is a candidate.  A candidate is retained if the divergence of what follows it from
what follows its suffix, the empirical Kullback-Leibler divergence times its count, is at least
``gain`` nats.  All these limits are absolute, so the tree grows with the corpus and has no cap.

A state's next-word distribution is smoothed with its suffix's: (n(s, w) + m P(w | suffix)) / (n(s) + m).
The root's is (c + 0.1) / (N + 0.1 (V + 1)), where all unseen words share one symbol.  Each place is
scored in the state of its longest retained suffix.

The tree is a distributed table.  Texts stay together in groups of bounded bytes, as streams of word
numbers.  For each depth a group asks once for each distinct pair of context and next word that it
has, with its own count of it in training texts; a bucket of contexts sums the counts, tests the
contexts and answers each group in the order that it asked.  A context with more than a bucket's
share of all places is dealt out over several buckets by next word, and the groups add up its
divergence.  So neither a frequent word nor the tree ever meets in one place, and nothing but three
totals reaches the driver.  Words go by 64-bit hashes, contexts by their
bucket and 48 bits, and both are taken to be distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import pack, unpack
from .common import batch, cut, drop_cut, release, small_batches, text_of

#: Text bytes of a group, and for each bucket; buckets of a task.
GROUP_BYTES, BUCKET_BYTES, BUCKETS = 8_000_000, 4_000_000, 8
#: Bits that tell a bucket's contexts apart, and the steps of a nat in which groups send their sums.
NAME, STEPS = (1 << 48) - 1, 1024
#: Kinds of messages: a group's stream, a depth's answers (from 1 on, for words), and totals.
STREAM, TOTALS = 0, -1
_MESSAGES = pa.schema([("grp", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("data", pa.large_binary()), ("a", pa.int64()), ("b", pa.int64())])
_MESSAGES_SQL = "grp bigint, kind int, part bigint, data binary, a bigint, b bigint"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hashes of numbers, or of pairs."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _logs(n: np.ndarray) -> np.ndarray:
    return np.log(n, out=np.zeros(len(n)), where=n > 0)


def _rows(kind: int, grp, parts, data) -> pa.RecordBatch:
    return batch(_MESSAGES, [grp, [kind] * len(data), parts, data, [None] * len(data), [None] * len(data)])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts after each other, the number of words of each, and the words by number."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(coded.dictionary, "").as_py()  # a text without a word splits into an empty one
    if blank >= 0:
        some = at != blank
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[some], minlength=len(lengths))
        at = at[some]
    return at, lengths, coded.dictionary


def _encoder(buckets: int, group_bytes: int):
    """Streams of groups, and their words for each bucket."""

    def group(number: int, ids: pa.Array, held: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        at, lengths, words = tokens(texts)
        words = words.to_pylist()
        if "" not in words:  # the end counts as the empty word
            words.append("")
        end = words.index("")
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
        part = (hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((hashes, part))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes, part = hashes[order], part[order]
        stream = rank[np.insert(at, np.cumsum(lengths), end)]
        n = np.bincount(stream[np.repeat(~held, lengths + 1)], minlength=len(order))
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.r_[starts[1:], len(part)]
        null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        yield _rows(STREAM, [number], [0], [pack(ids.fill_null(0).to_numpy(), null, held.astype(np.int64), lengths + 1, stream, np.array([rank[end], len(order)]))])
        yield _rows(1, [number] * len(starts), part[starts], [pack(hashes[a:b], n[a:b]) for a, b in zip(starts, ends, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for rows in batches:
            ends, done = np.cumsum(pc.binary_length(rows.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 64), 0
            while done < rows.num_rows:
                before = ends[done - 1] if done else 0
                to = min(int(np.searchsorted(ends, before + group_bytes - size)) + 1, rows.num_rows)
                held.append(rows.slice(done, to - done))
                size, done = size + int(ends[to - 1] - before), to
                if size >= group_bytes:
                    yield from whole(number, held)
                    release()
                    number, held, size = number + 1, [], 0
        if held:
            yield from whole(number, held)

    def whole(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, texts = (pa.concat_arrays([r.column(k) for r in held]) for k in range(3))
        return group(number, ids, out.to_numpy(zero_copy_only=False), texts.cast(pa.large_string()))

    return run


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[tuple]]:
    """(grp, kind, part, data) of all rows with the same ``column``, which come one after the other."""
    now, held = None, []
    for rows in batches:
        keys = rows.column(column).to_pylist()
        for key, *row in zip(keys, *(rows.column(c).to_pylist() for c in ("grp", "kind", "part", "data")), strict=True):
            if held and key != now:
                yield held
                held = []
            now = key
            held.append(tuple(row))
    if held:
        yield held


def _words(buckets: int):
    """Numbers and counts of words; and how many words and tokens a bucket has in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked in _runs(batches, "part"):
            part = asked[0][2]
            got = [unpack(data) for *_, data in asked]
            distinct, at = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True)
            total = np.bincount(at, np.concatenate([n for _, n in got]), len(distinct)).astype(np.int64)
            ends = np.cumsum([len(h) for h, _ in got])
            for (grp, *_), a, b in zip(asked, np.r_[0, ends[:-1]], ends, strict=True):
                yield _rows(1, [grp], [part], [pack(at[a:b] * buckets + part, total[at[a:b]])])
            yield batch(_MESSAGES, [[-1], [TOTALS], [part], [b""], [int((total > 0).sum())], [int(total.sum())]])

    return run


def _tested(depth: int, gain: float):
    """Sums of asked pairs over all groups, and whether their contexts are retained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked in _runs(batches, "part"):
            got = [unpack(data) for *_, data in asked]
            for g in got:
                g[0] = np.cumsum(g[0])
            context, pairs, split, sums, word, n = (np.concatenate(x) for x in zip(*got, strict=True))
            contexts, entry = np.unique(context, return_inverse=True)
            of = np.repeat(entry, pairs)
            if len(contexts) * (int(word.max(initial=0)) + 1) >= 1 << 62:
                word = np.unique(word, return_inverse=True)[1]
            base = int(word.max(initial=0)) + 1
            distinct, at = np.unique(of * base + word, return_inverse=True)
            total = np.bincount(at, n, len(distinct))
            owner = distinct // base
            have = np.bincount(owner, total, len(contexts))
            excess = np.bincount(owner, total * _logs(total), len(contexts)) + np.bincount(entry, sums, len(contexts)) / STEPS
            kept = (excess - have * _logs(have) >= gain) & (have > 0)
            total = total.astype(np.int64)[at]
            entries, ends = np.cumsum([len(x[0]) for x in got]), np.cumsum([len(x[4]) for x in got])
            for (grp, _, part, _), a, b, c, d in zip(asked, np.r_[0, entries[:-1]], entries, np.r_[0, ends[:-1]], ends, strict=True):
                e = entry[a:b]
                yield _rows(depth + 1, [grp], [part], [pack(kept[e].astype(np.int64), excess[e[split[a:b] > 0]], total[c:d])])

    return run


class Group:
    """The texts of a group on their way down the tree."""

    def __init__(self, rows: list[tuple], tokens: int, distinct: int, buckets: int, least: int, gain: float, prior: tuple[float, ...]):
        self.tokens, self.buckets, self.gain, self.prior, self.least = tokens, buckets, gain, prior, least
        self.answers = {(kind, part): data for _, kind, part, data in rows if kind > STREAM}
        ids, null, held, self.lengths, word, (end, size) = unpack(next(data for _, kind, _, data in rows if kind == STREAM))
        self.word = word.astype(np.int32)
        self.ids, self.held = np.where(null > 0, None, ids), held > 0
        self.first = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.train = np.repeat(~self.held, self.lengths)
        self.number, self.count = (np.zeros(size, np.int64) for _ in range(2))
        at = 0
        for part in sorted(p for kind, p in self.answers if kind == 1):
            number, n = unpack(self.answers[1, part])
            self.number[at : at + len(number)], self.count[at : at + len(number)] = number, n
            at += len(number)
        self.root = (self.count + 0.1) / (tokens + 0.1 * (distinct + 1))
        self.p, self.log_suffix = self.root[self.word], (_logs(self.count) - np.log(max(tokens, 1)))[self.word].astype(np.float32)
        # the pair of each place at the last depth, and each pair's hash and count: at depth zero, the words
        self.pair, self.hash, self.total = self.word, self.number, self.count
        self.able, self.start, self.depth = np.ones(len(self.word), bool), end, 0

    def deepen(self) -> None:
        """Places whose context of the next depth is a candidate, with its number among the group's contexts."""
        self.depth += 1
        context = np.r_[np.int32(self.start), self.pair[:-1]]
        able = self.able & np.r_[True, self.known[:-1] if self.depth > 1 else np.ones(len(self.word) - 1, bool)]
        if self.depth == 1:
            context[self.first] = self.start
        else:
            able[self.first] = False
        able[able] = self.total[context[able]] >= (1 if self.depth == 1 else self.least)
        self.places = np.flatnonzero(able).astype(np.int32)
        used = np.zeros(len(self.total), bool)
        used[context[self.places]] = True
        contexts = np.flatnonzero(used)
        # a context of more than a bucket's share of all places has several entries
        parts = np.minimum(self.buckets, -(-self.total[contexts] * self.buckets // max(self.tokens, 1)))
        self.several = parts > 1
        owner, first = np.repeat(np.arange(len(parts)), parts), np.cumsum(parts) - parts
        bucket = (_mixed(self.hash[contexts]).view(np.uint64) >> np.uint64(1)).astype(np.int64)[owner] % self.buckets
        if len(owner) > len(parts):
            bucket = (bucket + np.arange(len(owner)) - first[owner]) % self.buckets
        name = (self.hash[contexts] & NAME)[owner]  # contexts of a bucket go by so many bits
        order = np.argsort(bucket << 48 | name) if self.buckets < 1 << 15 else np.lexsort((name, bucket))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.owner, self.bucket, self.name = owner[order], bucket[order], name[order]
        self.starts = np.flatnonzero(np.diff(self.bucket, prepend=-1))  # where a bucket's entries begin
        self.ends = np.r_[self.starts, len(self.bucket)][1:].astype(np.int64)
        relabel = (np.cumsum(used) - 1).astype(np.int32)
        self.context = relabel[context[self.places]]
        word = self.word[self.places]
        if len(owner) > len(parts):
            turn = np.zeros(len(word), np.int32)
            wide = np.flatnonzero(self.several[self.context])
            turn[wide] = self.number[word[wide]] % parts[self.context[wide]]
            self.entry = rank[first[self.context] + turn]
        else:
            self.entry = rank[self.context]
        bits = max(len(self.number) - 1, 1).bit_length()
        pairs, at = np.unique(self.entry.astype(np.int64) << bits | word, return_inverse=True)
        self.at = at.astype(np.int32)
        of = pairs >> bits
        self.pairs, self.pair_word = np.bincount(of, minlength=len(self.bucket)), self.number[pairs & (1 << bits) - 1]
        self.contexts_hash, self.contexts_total = self.hash[contexts], self.total[contexts]
        self.pair_hash = _mixed(self.contexts_hash[self.owner[of]], self.pair_word)
        self.split = self.several[self.owner]

    def ask(self, grp: int) -> Iterator[pa.RecordBatch]:
        """What the group asks each bucket at this depth."""
        train = self.train[self.places]
        n = np.bincount(self.at[train], minlength=len(self.pair_word))
        sums = np.bincount(self.entry[train], self.log_suffix[self.places[train]], len(self.bucket))
        sums = np.rint(-STEPS * sums).astype(np.int64)
        ends, split = np.r_[0, np.cumsum(self.pairs)], self.split.astype(np.int64)
        data = []
        for a, b in zip(self.starts, self.ends, strict=True):
            some = slice(ends[a], ends[b])
            data.append(pack(np.diff(self.name[a:b], prepend=0), self.pairs[a:b], split[a:b], sums[a:b], self.pair_word[some], n[some]))
        if data:
            yield _rows(self.depth + 1, [grp] * len(data), self.bucket[self.starts], data)

    def told(self) -> None:
        """Take in the answers of this depth: probabilities of places in retained contexts."""
        got = [unpack(self.answers.pop((self.depth + 1, int(b)))) for b in self.bucket[self.starts]]
        flags, more, total = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(3))
        excess = np.zeros(len(self.bucket))
        excess[self.split] = more
        have = self.contexts_total
        retained = np.zeros(len(have), bool)
        retained[self.owner[~self.split]] = flags[~self.split] > 0
        if self.several.any():
            divergence = np.bincount(self.owner, excess, len(have)) - have * _logs(have)
            retained = np.where(self.several, divergence >= self.gain, retained)
        use = retained[self.context]
        places, n, have = self.places[use], total[self.at[use]], have[self.context[use]]
        m = self.prior[min(self.depth, len(self.prior)) - 1]
        self.p[places] = (n + m * self.p[places]) / (have + m)
        self.log_suffix[places] = _logs(n) - np.log(have)
        self.able, self.known = (np.zeros(len(self.word), bool) for _ in range(2))
        self.able[places], self.known[self.places] = True, True
        self.pair = np.zeros(len(self.word), np.int32)
        self.pair[self.places] = self.at
        self.hash, self.total = self.pair_hash, total

    def scores(self) -> pa.RecordBatch:
        known = self.count[self.word] > 0
        sums = [np.add.reduceat(x, self.first) for x in (known.astype(np.int64), np.log10(self.root)[self.word], np.log10(self.p))]
        return batch(_SCORES, [self.ids.tolist(), self.held, self.lengths, sums[0], [self.tokens] * len(self.ids), *sums[1:]])


def _asker(depth: int, *model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "grp"):
            group = Group(rows, *model)
            group.deepen()
            while group.depth < depth:
                group.told()
                group.deepen()
            yield from group.ask(rows[0][0])
            del group
            release()

    return run


def _scorer(depth: int, *model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "grp"):
            group = Group(rows, *model)
            while group.depth < depth:
                group.deepen()
                group.told()
            yield group.scores()
            del group
            release()

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, least: int = 2, gain: float = 3.0, prior: tuple[float, ...] = (150.0, 10.0), group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from the rows where ``held_out`` is false.  A null text counts as empty: its only token is
    the end.  Repeated rows count and come back as often as they are there; null ids are kept.
    Without any training text all counts are zero and every score is that of the root alone.  An
    empty table gives an empty result.  ``prior`` is m of each depth, the last one for all below.
    Other columns are ignored.  ``docs`` must give the same rows each time, as a table does.
    """
    small_batches(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(docs, text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    made = cut(own.mapInArrow(_encoder(buckets, group_bytes), _MESSAGES_SQL), "kind")
    streams = made.where(F.col("kind") == STREAM)
    tasks = (made.agg(F.max(F.shiftright("grp", 32))).first()[0] or 0) + 1  # groups stay in as many tasks as wrote them

    turns = -(-buckets // BUCKETS)  # a task takes its buckets one after the other

    def by_bucket(asked: DataFrame) -> DataFrame:
        return asked.repartitionById(turns, (F.col("part") % turns).cast("int")).sortWithinPartitions("part")

    def by_group(answers: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.union, answers, streams)
        return every.repartitionById(tasks, F.shiftright("grp", 32).cast("int")).sortWithinPartitions("grp")

    numbered = cut(by_bucket(made.where("kind = 1")).mapInArrow(_words(buckets), _MESSAGES_SQL))
    drop_cut(made, "kind=1")
    distinct, tokens = numbered.where(F.col("kind") == TOTALS).agg(F.sum("a"), F.sum("b")).first()
    model = (tokens or 0, distinct or 0, buckets, least, gain, prior)
    answers = [numbered.where("kind = 1")]
    for d in range(1, depth + 1):
        asked = by_group(answers).mapInArrow(_asker(d, *model), _MESSAGES_SQL)
        answers.append(cut(by_bucket(asked).mapInArrow(_tested(d, gain), _MESSAGES_SQL)))
    out = cut(by_group(answers).mapInArrow(_scorer(depth, *model), _SCORES_SQL))
    for x in (made, numbered, *answers[1:]):
        drop_cut(x)
    return out
