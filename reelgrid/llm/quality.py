"""Text quality from positives and unlabelled text.

A logistic model over style features minimises the non-negative unbiased risk: trusted positives stand for
the positive class, unlabelled web text for the mixture, and the class prior ties them. The risk of the
negative class is the mixture's less the prior's share of the positives'; when the estimate of it falls
below zero, the model has begun to fit the sample and the step goes the other way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, plainly, slices

PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
FOLDS = 5


@dataclass(frozen=True)
class Fit:
    """positives, unlabelled: most rows of each that the model is fitted on (smallest hashes of the ids).

    Both bounds concern the fit only; every text is scored.
    """

    positives: int = 20_000
    unlabelled: int = 40_000
    steps: int = 500
    rate: float = 0.05
    decay: float = 1e-4


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(features), 0.5)
        return sigmoid(standard(features, self.mean, self.scale) @ self.weights + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def standard(features: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((features.astype(np.float64) - mean) / scale, -8, 8)


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes and of each punctuation mark, and the shape of words and lines of the whole text."""
    text = text or ""
    raw = text.encode()
    size = max(1, len(raw))
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digits = int(bytes_[97:123].sum()), int(bytes_[65:91].sum()), int(bytes_[48:58].sum())
    high, space = int(bytes_[128:].sum()), int(bytes_[32] + bytes_[9] + bytes_[13])
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    different = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    count = max(1, len(lines))
    marked = sum(k for w, k in different.items() if not w[-1].isalnum())
    shouted = sum(k for w, k in different.items() if len(w) > 1 and w.isupper())
    plain = sum(k for w, k in different.items() if w.isalpha())
    commonest = max(different.values(), default=0)
    shape = [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), lower / size, upper / size, digits / size, high / size, space / size,
        bytes_[10] / size, int(bytes_[PUNCTUATION].sum()) / size, int((bytes_[:9].sum() + bytes_[14:32].sum())) / size,
        upper / max(1, upper + lower), lengths.mean() if len(words) else 0, lengths.std() if len(words) else 0,
        np.log1p(lengths.max() if len(words) else 0), marked / n, shouted / n, plain / n, len(different) / n, np.log1p(len(different)) / np.log1p(n),
        commonest / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / count, np.log1p(len(words) / count), len(bytes_.nonzero()[0]) / 256,
    ]
    marks = np.sqrt(bytes_[PUNCTUATION] / size)
    return np.concatenate([np.array(shape, np.float64), marks]).astype(np.float32)


WIDTH = len(features(""))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from. A null id has no label: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learned(positive: np.ndarray, unlabelled: np.ndarray, prior: float, how: Fit) -> Model:
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-9] = 1.0
    p, u = standard(positive, mean, scale), standard(unlabelled, mean, scale)
    w, b = np.zeros(WIDTH), np.log(prior / (1 - prior))
    moment, spread = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, how.steps + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        at_p, at_u = sigmoid(zp), sigmoid(zu)
        pull = np.r_[u.T @ at_u / len(u) - prior * (p.T @ at_p) / len(p), at_u.mean() - prior * at_p.mean()]
        push = -prior * np.r_[p.T @ (1 - at_p) / len(p), (1 - at_p).mean()]
        step = push + pull if negative >= 0 else -pull
        step[:-1] += how.decay * w
        moment = 0.9 * moment + 0.1 * step
        spread = 0.99 * spread + 0.01 * step**2
        change = how.rate * (moment / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return Model(mean, scale, w, float(b), prior)


def sampled(docs: DataFrame, wanted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the positives and of the unlabelled texts among ``docs``; wanted: ``doc_id, positive, unlabelled``.

    An id that stands in several rows gives one text, that of the smallest hash, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own = pa.array([features(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("positive"), part.column("unlabelled"), own], ["positive", "unlabelled", "features"])

    # At most as many rows as the two bounds of the fit, so it may be broadcast.
    # Every map task sends one text an id at most, whatever the number of its rows.
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    found = docs.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "positive", "unlabelled").agg(least)
    rows = found.select("positive", "unlabelled", F.col("least.text").alias("text"))
    got = rows.mapInArrow(run, "positive boolean, unlabelled boolean, features binary").toArrow()
    values = np.frombuffer(b"".join(got.column("features").to_pylist()), np.float32).reshape(-1, WIDTH)
    # Sums depend on the order of rows: one order for all partitionings.
    positive, unlabelled = (values[got.column(c).to_numpy()] for c in ("positive", "unlabelled"))
    return positive[np.lexsort(positive.T)], unlabelled[np.lexsort(unlabelled.T)]


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model:
    """Fit on trusted positives and unlabelled text of the training folds.

    docs: ``doc_id, text``; labels: ``doc_id, quality``. The class prior is estimated as the share of
    positives among the training labels. A document labelled twice counts as the worse. Without positives
    or text the model scores everything 0.5.
    """
    marks = pick(labels, doc_id="doc_id", quality="quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    marks = marks.withColumn("doc_id", F.col("doc_id").cast("long")).filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total, good = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    first = [F.xxhash64(F.lit(5), "doc_id"), "doc_id"]
    positive = marks.filter("quality = 1").select("doc_id").join(ids, "doc_id", "left_semi").orderBy(*first).limit(how.positives)
    unlabelled = ids.orderBy(*first).limit(how.unlabelled)
    wanted = (
        positive.select("doc_id", F.lit(True).alias("p"), F.lit(False).alias("u")).unionAll(unlabelled.select("doc_id", F.lit(False), F.lit(True)))
        .groupBy("doc_id").agg(F.max("p").alias("positive"), F.max("u").alias("unlabelled"))
    )
    p, u = sampled(docs, wanted)
    if not len(p) or not len(u):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(0), 0.0, 0.5)
    return learned(p, u, min(max(good / total, 0.02), 0.98), how)


def scored(docs: DataFrame, model: Model, kept: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``kept`` and ``score`` of every row; the text need not be among them."""
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            values = np.stack([features(t) for t in part.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(model.score(values), pa.float64())], [*kept, "score"])

    return docs.mapInArrow(run, f"{schema}score double")


def classify(df: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Fit = Fit()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Only the text enters a score; equal texts have equal scores. A null or empty text is scored as a text
    without words. Rows without id are scored and not held out; repeated rows give repeated results; other
    columns are left out; an empty table gives an empty one.
    """
    docs = pick(df, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = scored(docs, train(docs, labels, how), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(df: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Fit = Fit()) -> DataFrame:
    """All columns of the rows that are not rejected; ``df`` has ``doc_id`` and ``text``."""
    rows, back = plainly(df, doc_id="doc_id", text="text")
    docs = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return back(scored(rows, train(docs, labels, how), rows.columns).filter(F.col("score") >= threshold).drop("score"))
