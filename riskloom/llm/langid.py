"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: character n-grams (``ORDERS``) of the whole lower-cased text, hashed to ``SLOTS``; their share of the
text's n-grams times the inverse document frequency, counted over all documents of the learning fold.
Training: follow-the-regularised-leader with per-coordinate steps and an elastic net (L1 and L2), on a bounded
sample of labelled rows (``SAMPLE`` in all, the same number for each language, chosen by a hash of doc_id; a corpus with
more languages than that gives one row for each of the SAMPLE commonest); one tenth of the sample is kept back to fit the
temperature of the final softmax.
Prediction is a lookup and a segmented sum per n-gram, for texts of any length.  Beside the score there is its
``confidence``: where the score stands between that of a guess (one in so many languages, 0) and certainty (1), times the share
of the text's letters that at least ``LEAST`` documents of the learning fold have (hashed as n-grams are): one odd text must not
teach its script to a language.

Learning uses text and non-null lang of documents whose crc32(doc_id as text) modulo 4 is not 2; a null doc_id
is held out.  ``und`` with score 0 is given to a null text or one without any letter, and where nothing was
learned.  Only the model (SLOTS x languages numbers) and the bounded sample's features reach the driver.

Repeated rows, ties and other columns change nothing (each row is predicted on its own; equal scores go to the
language first in order).  Empty tables give empty results.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import tune

ORDERS = (1, 2, 3)
SLOTS = 1 << 15
SAMPLE = 3200
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Features are shares of a text: this brings them near one.
SCALE = 16.0
#: Documents of the learning fold that have a letter before it counts as known.
LEAST = 2


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: slots of all n-grams of the texts one after the other, and each text's first n-gram (len(texts) + 1)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = codes_of(texts)
    edges = np.r_[0, np.cumsum(lengths)]
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            yield np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
            continue
        h = codes[:n] * np.uint32(0x9E3779B1)
        for k in range(1, order):
            h = (h ^ codes[k : k + n]) * np.uint32(0x85EBCA6B + 2 * k)
        h ^= h >> np.uint32(15)
        slots = ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int64)
        if order > 1:
            inside = np.ones(n, dtype=bool)
            for b in range(1, order):  # n-grams over the border of two texts are none
                at = edges[1:-1] - b
                inside[at[(at >= 0) & (at < n)]] = False
            slots = slots[inside]
        yield slots, np.r_[0, np.cumsum(np.maximum(lengths - order + 1, 0))]


def codes_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@functools.cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([LETTER.match(chr(c)) is not None for c in range(sys.maxunicode + 1)])


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and their shares of its n-grams."""
    slots = np.concatenate([s for s, _ in grams([text.lower()])])
    ids, n = np.unique(slots, return_counts=True)
    return ids, (n / max(1, len(slots))).astype(np.float32)


def _learning() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2, F.lit(False))


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of the learning fold with each slot, with a single character of each slot, and all documents of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(2 * SLOTS + 1, dtype=np.int64), 0
        for b in batches:
            for chunk in K.chunks(b):
                texts = [t.lower() for t in chunk.column(0).to_pylist()]
                n += len(texts)
                each = list(grams(texts))
                for i in range(len(texts)):
                    seen = np.zeros(SLOTS, dtype=bool)
                    for order, (slots, at) in enumerate(each):
                        seen[slots[at[i] : at[i + 1]]] = True
                        if not order:
                            df[SLOTS:-1] += seen
                    df[:SLOTS] += seen
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["slot", "n"])

    rows = docs.where(_learning() & F.col("text").isNotNull()).select("text").mapInArrow(K.lean(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # 2 * SLOTS + 1 rows at most
    df = np.zeros(2 * SLOTS + 1, dtype=np.int64)
    df[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return df[:SLOTS], df[SLOTS:-1], int(df[-1])


def sample(docs: DataFrame, rows: int = SAMPLE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, slots, shares) of a bounded, balanced sample of the learning fold."""
    known = docs.where(_learning() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not counts:
        return []
    each = max(1, rows // len(counts))
    # a share of the hash space that holds the wanted rows and a few more; the ranks below are exact
    shares_ = {r["lang"]: min(1.0, (each + 4 * each**0.5) / r["count"]) for r in counts}
    share = known.sparkSession.createDataFrame(list(shares_.items()), "lang string, share double")  # as many rows as languages, SAMPLE at most
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    some = known.withColumn("place", place).join(F.broadcast(share), "lang").where(F.col("place") < F.col("share") * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shares(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(np.uint16).tobytes() for x, _ in got], pa.binary()), pa.array([y.tobytes() for _, y in got], pa.binary())], ["place", "lang", "slots", "shares"])

    made = some.select("place", "lang", "text").mapInArrow(K.lean(run), "place long, lang string, slots binary, shares binary")
    first = Window.partitionBy("lang").orderBy("place", "slots", "shares")
    taken = made.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= each).drop("rank").collect()
    taken.sort(key=lambda r: (r["place"], r["lang"], bytes(r["slots"]), bytes(r["shares"])))
    return [(r["lang"], np.frombuffer(r["slots"], dtype=np.uint16).astype(np.int64), np.frombuffer(r["shares"], dtype=np.float32)) for r in taken]


class Ftrl:
    """Follow-the-regularised-leader (proximal) for multinomial logistic regression."""

    def __init__(self, classes: int, slots: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((classes, slots)), np.zeros((classes, slots))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[y] -= 1.0
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """langs, one row of float32 weights (idf, scale and temperature folded in) for each, and the slots of known characters (all, unless told)."""

    def __init__(self, langs: list[str], weights: np.ndarray, known: np.ndarray | None = None):
        self.langs, self.weights, self.known = langs, weights, np.ones(SLOTS, dtype=bool) if known is None else known

    def confidence(self, score: float) -> float:
        """0 for a guess among the languages, 1 for certainty; with one language there is no other to guess."""
        n = len(self.langs)
        return max(0.0, (n * score - 1) / (n - 1)) if n > 1 else score

    def familiar(self, texts: list[str | None]) -> np.ndarray:
        """The share of each text's letters that are known."""
        lower = [(t or "").lower() for t in texts]
        slots, at = next(grams(lower))
        is_ = letters()[codes_of(lower)]
        # sums up to each text's end, as reduceat has none for empty texts
        upto = lambda x: np.r_[0, np.cumsum(x)][at]
        return np.diff(upto(is_ & self.known[slots])) / np.maximum(np.diff(upto(is_)), 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lower = [(t or "").lower() for t in texts]
        score = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        for slots, at in grams(lower) if self.langs else []:
            some = np.flatnonzero(at[1:] > at[:-1])
            total += np.diff(at)
            if len(some):
                for c, w in enumerate(self.weights):
                    score[some, c] += np.add.reduceat(w[slots], at[some], dtype=np.float64)
        p = softmax(score / np.maximum(total, 1)[:, None]) if self.langs else score
        letters = [bool(self.langs) and LETTER.search(t) is not None for t in lower]
        best = p.argmax(axis=1) if self.langs else np.zeros(len(texts), dtype=int)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], [min(1.0, float(p[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, letters, strict=True))]


def train(docs: DataFrame, rows: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text, lang)."""
    got = sample(docs, rows)
    if not got:
        return Model([], np.zeros((0, SLOTS), dtype=np.float32), np.zeros(SLOTS, dtype=bool))
    df, single, n = document_frequency(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    langs = sorted({x[0] for x in got})
    index = {lang: i for i, lang in enumerate(langs)}
    kept = [x for i, x in enumerate(got) if i % 10 == 9]
    learn = [x for i, x in enumerate(got) if i % 10 != 9]
    model = Ftrl(len(langs), SLOTS)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(learn)):
            lang, at, x = learn[i]
            model.step(at, x * idf[at] * SCALE, index[lang])
    w = model.weights(np.arange(SLOTS)) * idf * SCALE
    logits = np.array([w[:, at] @ x for _, at, x in kept]) if kept else np.zeros((0, len(langs)))
    truth = np.array([index[lang] for lang, _, _ in kept], dtype=int)
    # targets as Platt smooths them: a sample without an error does not call for certainty
    aim = np.full((len(truth), len(langs)), 1 / (len(truth) + len(langs)))
    aim[np.arange(len(truth)), truth] += len(truth) / (len(truth) + len(langs))
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.1, 50.0, 100) if len(kept) else []:
        loss = -(aim * np.log(np.maximum(softmax(logits / t), 1e-12))).sum(axis=1).mean()
        if loss < best - 1e-9:
            best, temperature = loss, t
    return Model(langs, (w / temperature).astype(np.float32), single >= LEAST)


def language_id(docs: DataFrame, train_on: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",), rows: int = SAMPLE) -> DataFrame:
    """The kept columns and held_out, lang_pred, score, confidence for each row of docs (doc_id, text; lang to learn from, unless train_on has it)."""
    tune(docs.sparkSession)
    base = docs if train_on is None else train_on
    model = train(base.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), rows)
    docs = docs.select(*keep, (~_learning()).alias("held_out"), F.col("text").cast("string").alias("_scanned"))
    out = T.StructType([*docs.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in K.chunks(b, b.num_columns - 1):
                texts = chunk.column(chunk.num_columns - 1).to_pylist()
                lang, score = model.predict(texts)
                sure = [model.confidence(x) * float(k) if y != UNKNOWN else 0.0 for x, y, k in zip(score, lang, model.familiar(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())], [*keep, "held_out", "lang_pred", "score", "confidence"])

    return docs.mapInArrow(K.lean(run), out)
