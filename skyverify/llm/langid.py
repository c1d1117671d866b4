"""Language identification by string kernels.

Two texts are compared by the n-grams they both have, for n from 1 to 3 together, whatever their
counts: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|).  Landmark texts give the Nystroem map of this
kernel, and one-versus-rest ridge regression is fitted in it.  As the kernel is linear in presence
vectors, map and weights multiply into one matrix with a row for each n-gram, and a batch of texts
is scored by one sparse product.

N-grams are of lower-case code points, where all characters that aren't letters are one; the matrix
has those of the landmarks, so it grows with the fixed sample only, whatever the scripts.

One-versus-rest scores sum to a constant, so the best one says nothing about texts of no learned
language.  That is judged by the share of a text's 3-grams that are common in the language it would
get.  The limit of each language is calibrated on texts of the sample that were held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Bits of a code point, so an n-gram is one number.
POINT = 21
#: A 3-gram is common in a language if it is in so many texts of the sample: a share, and a number.
COMMON, TIMES = 0.02, 2
#: The share of held-out texts that may be under a language's level, the margin under it, and the standard deviations for texts with few 3-grams.
UNDER, MARGIN, DEVIATIONS = 0.02, 0.12, 3.0
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


class Features:
    """Distinct n-grams of texts, as sorted numbers; letters outside ``alphabet``, if there is one, are all the same."""

    def __init__(self, alphabet: list[int] | None = None):
        self.classes = np.where(letters(), np.arange(2, 2 + len(letters())), 0)
        if alphabet is not None:
            self.classes[letters()] = 1
            self.classes[alphabet] = np.arange(2, 2 + len(alphabet))

    def __call__(self, text: str) -> np.ndarray:
        c = self.classes[points(text)]
        two = c[:-1] << POINT | c[1:] | 1 << 3 * POINT - 1
        three = c[:-2] << 2 * POINT | c[1:-1] << POINT | c[2:]
        return np.unique(np.concatenate([c, two, -1 - three]))


def threes(grams: np.ndarray) -> np.ndarray:
    """The 3-grams with a letter among ``grams``."""
    return grams[grams < -1]


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # sorted
    weights: np.ndarray  # [n-gram, language]; the last row is for all others
    bias: np.ndarray
    common: list[np.ndarray]  # sorted 3-grams of each language
    level: np.ndarray  # share of common 3-grams that clean texts of each language have

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """[text, language] of texts that all have an n-gram: the sparse presence matrix times the weights."""
        n = np.array([len(g) for g in grams])
        sums = np.add.reduceat(self.weights[_places(self.grams, np.concatenate(grams))], np.r_[0, np.cumsum(n)[:-1]], axis=0)
        return sums / np.sqrt(n)[:, None] + self.bias

    def fits(self, grams: np.ndarray, lang: int) -> bool:
        """Whether a text has as many common 3-grams of a language as its texts have."""
        n, level = len(three := threes(grams)), self.level[lang]
        least = level - MARGIN - DEVIATIONS * (level * (1 - level) / max(n, 1)) ** 0.5
        return not n or _share(three, self.common[lang]) >= least


def _places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where sorted ``table`` has each value; its length for those that it lacks."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, len(table)) if len(table) else at


def _share(three: np.ndarray, common: np.ndarray) -> float:
    return float((_places(common, three) < len(common)).mean())


def _common(three: list[np.ndarray]) -> np.ndarray:
    values, times = np.unique(np.concatenate(three), return_counts=True)
    return values[times >= max(min(TIMES, len(three)), COMMON * len(three))]


def calibrated(three: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Common 3-grams of a language's texts, and the level that all but UNDER of held-out texts reach; of fewer than two texts none."""
    parts = min(4, len(three))
    shares = [_share(x, common) for k in range(parts) if parts > 1 for common in [_common([y for i, y in enumerate(three) if i % parts != k])] for x in three[k::parts] if len(x)]
    return _common(three), float(np.quantile(shares, UNDER)) if shares else 0.0


def fit_model(texts: list[str], langs: list[str], landmarks: int = 64, ridge: float = 1e-2) -> Model | None:
    """Fit on texts that have letters; ``landmarks`` of each language, the first ones, span the map."""
    pairs = [(t, x) for t, x in zip(texts, langs, strict=True) if letters()[points(t)].any()]
    if not pairs:
        return None
    names = sorted({x for _, x in pairs})
    grams = [*map(Features(), (t for t, _ in pairs))]
    marks = [g for x in names for g in [g for g, (_, y) in zip(grams, pairs, strict=True) if y == x][:landmarks]]
    known = np.unique(np.concatenate(marks))
    marked = np.zeros((len(marks), len(known)), np.float32)
    for row, g in zip(marked, marks, strict=True):
        row[_places(known, g)] = len(g) ** -0.5
    kernel = np.stack([marked[:, (k := _places(known, g))[k < len(known)]].sum(axis=1) * len(g) ** -0.5 for g in grams]).astype(float)
    value, vector = np.linalg.eigh((marked @ marked.T).astype(float))
    use = value > 1e-6 * value[-1]
    root = vector[:, use] / np.sqrt(value[use])
    mapped = kernel @ root
    target = np.where(np.array([y for _, y in pairs])[:, None] == np.array(names), 1.0, -1.0)
    # every language weighs the same, however many texts it has
    weight = 1.0 / np.maximum((target > 0).sum(axis=0), 1)[np.array([names.index(y) for _, y in pairs])]
    weight /= weight.sum()
    center, middle = weight @ mapped, weight @ target
    x, y = (mapped - center) * np.sqrt(weight)[:, None], (target - middle) * np.sqrt(weight)[:, None]
    solved = np.linalg.solve(x.T @ x + ridge / len(pairs) * np.eye(x.shape[1]), x.T @ y)
    table = np.zeros((len(known) + 1, len(names)), np.float32)
    table[:-1] = marked.T @ (root @ solved)
    common, level = zip(*(calibrated([threes(g) for g, (_, y) in zip(grams, pairs, strict=True) if y == x]) for x in names), strict=True)
    return Model(names, known, table, middle - center @ solved, list(common), np.array(level))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, landmarks: int = 64, seed: int = 3, max_bytes: int = 100_000) -> Model | None:
    """Fit on a sample of ``per_lang`` distinct texts of each language, or all that it has: those of least hash.

    The sample is all that reaches the driver.  Texts of more than ``max_bytes`` are taken only where
    a language has too few others.  Rows without text or language aren't used, equal texts count
    once, and None comes back if nothing is left.
    """
    rows = train.select(train[text_col].cast("string").alias("text"), train[lang_col].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # a language's order: texts of moderate size by hash, then the others by hash
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "text"), 2) + F.when(F.octet_length("text") > max_bytes, F.lit(1 << 62)).otherwise(F.lit(0)))
    last = _last_hashes(rows.select("lang", "h"), per_lang)
    if not last:
        return None
    limit = F.create_map(*[F.lit(v) for x, h in last.items() for v in (x, h)])
    sample = rows.where(F.col("h") <= limit[F.col("lang")]).dropDuplicates(["text", "lang"]).select("text", "lang", F.xxhash64(F.lit(seed + 1), "text").alias("order"))
    got = sorted(sample.collect(), key=lambda r: (r["order"], r["text"], r["lang"]))
    return fit_model([r["text"] for r in got], [r["lang"] for r in got], landmarks)


def _last_hashes(rows: DataFrame, per_lang: int) -> dict[str, int]:
    """The ``per_lang``-th distinct ``h`` of each ``lang``, or its last one.

    Only hashes under a bound meet by language: one that leaves a few times ``per_lang`` of them, by
    an estimate of how many there are.  Languages that it leaves too few of take part without it.
    """
    counts = {r["lang"]: (r["n"], r["high"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.max("h").alias("high")).collect()}  # a row for each language
    bounds = {x: int(min(3 * per_lang / n, 1.0) * (1 << 62)) if n > 3 * per_lang else high for x, (n, high) in counts.items()}
    out: dict[str, int] = {}
    for whole in (False, True):
        left = {x: counts[x][1] if whole else b for x, b in bounds.items() if x not in out}
        if not left:
            break
        limit = F.create_map(*[F.lit(v) for x, b in left.items() for v in (x, b)])
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # limited to per_lang within each task first
        some = rows.where(F.col("lang").isin(list(left)) & (F.col("h") <= limit[F.col("lang")])).distinct().withColumn("rank", rank).where(F.col("rank") <= per_lang)
        for r in some.groupBy("lang").agg(F.max("h").alias("h"), F.count("*").alias("n")).collect():
            if whole or r["n"] == per_lang or left[r["lang"]] >= counts[r["lang"]][1]:
                out[r["lang"]] = r["h"]
    return out


def prediction(text: Column, model: Model | None, spark: SparkSession) -> Column:
    """A struct ``lang_pred, score, known`` for each text; see ``predict`` and ``keep_known``."""
    shared = spark.sparkContext.broadcast(model)  # of fixed size for each language

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m: Model | None = shared.value
        features = Features()
        for texts in batches:
            texts = list(texts)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            known = np.zeros(len(texts), bool)
            some = [i for i, t in enumerate(texts) if t and m and letters()[points(t)].any()]
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                grams = [features(texts[i]) for i in part]
                f = m.scores(grams)
                score[part] = (np.clip(f.max(axis=1), -1, 1) + 1) / 2
                pred[part] = np.array(m.langs, object)[f.argmax(axis=1)]
                known[part] = [m.fits(g, k) for g, k in zip(grams, f.argmax(axis=1), strict=True)]
            yield pd.DataFrame({"lang_pred": pred, "score": score, "known": known})

    return F.pandas_udf(run, "lang_pred string, score double, known boolean")(text.cast("string"))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    ``score`` maps the best language's regression value from -1..1 to 0..1.  A text that is null or
    has no letter gets ``und`` and 0, and so does every text without a model.  Equal texts get equal
    results; repeated rows and null ids come back as they are.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), prediction(docs[text_col], model, docs.sparkSession).alias("r")).select("doc_id", "r.lang_pred", "r.score")


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with all their columns.

    A text of another language, or of none, has fewer of the common 3-grams of the language that it
    would get than held-out texts of that language.  A language learned from one text has no limit.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), prediction(docs[text_col], model, docs.sparkSession).alias("r"))
    return rows.where((F.col("r.lang_pred") != "und") & F.col("r.known")).select("row.*")
