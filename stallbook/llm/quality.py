"""Document quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text: rates of neighbouring character classes, word length, repeated and
distinct words, words in a line. The weights maximise the likelihood of preference pairs: in each, a document labelled 1 beats one
labelled 0, with the logistic probability of their score difference. Pairs are drawn from a bounded sample of labelled
rows, `PARTNERS` for each document, never all of them. With these weights every labelled row that may be learned from is scored: the base
rate is theirs, the threshold is the exact quantile of their scores that it names, and the slope fits them all; the final score is the
logistic function of the distance to the threshold.

Defined cases: null or empty texts have all features 0 and get a score like any other. Without labels of both classes every score
is the base rate (0.5 without labels). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.functions.ranks import exact_quantiles
from stallbook.llm.learning import once_labelled, sampled, sampled_texts
from stallbook.llm.tokens import buffers, chunks, split_words
from stallbook.scratch import stored

#: Bounds of the sample: examples of each class, and partners of each in preference pairs.
EXAMPLES, PARTNERS = 4000, 8
#: A feature counts up to its mean and this many standard deviations, so that no rare mark decides alone.
CAP = 3.0

# Character classes of bytes: marks that texts are littered with have one each.
_MARKS = b" \n.,!?|#$%&*@/:;-_()<>=\"'"
_CLASSES = len(_MARKS) + 5
_CLASS = np.full(256, len(_MARKS), np.uint8)
for _i, _mark in enumerate(_MARKS):
    _CLASS[_mark] = _i
_CLASS[ord("A") : ord("Z") + 1] = len(_MARKS) + 1
_CLASS[ord("a") : ord("z") + 1] = len(_MARKS) + 2
_CLASS[ord("0") : ord("9") + 1] = len(_MARKS) + 3
_CLASS[0x80:] = len(_MARKS) + 4
FEATURES = _CLASSES * _CLASSES + 6


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text of a binary column."""
    n = len(texts)
    data, bounds = buffers(texts)
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(n), lengths)
    kind = _CLASS[data].astype(np.int64)
    pairs = kind[:-1] * _CLASSES + kind[1:]
    inside = owner[:-1] == owner[1:]
    counts = np.bincount((owner[:-1] * _CLASSES**2 + pairs)[inside], minlength=n * _CLASSES**2).reshape(n, -1)
    rates = np.log1p(1000.0 * counts / np.maximum(lengths, 1)[:, None])

    words = split_words(texts)
    n_words = np.diff(words.starts)
    word_owner = np.repeat(np.arange(n), n_words)
    per_word = 1.0 / np.maximum(n_words, 1)
    vocabulary = max(1, len(words.terms))
    distinct = np.bincount(np.unique(word_owner * vocabulary + words.codes) // vocabulary, minlength=n)
    again = np.bincount(word_owner[1:][(words.codes[1:] == words.codes[:-1]) & (word_owner[1:] == word_owner[:-1])], minlength=n)
    lines = np.bincount(owner[data == ord("\n")], minlength=n) + 1
    more = [
        np.log1p(n_words),
        np.log1p(lengths * per_word),
        distinct * per_word,
        again * per_word,
        np.log1p(n_words / lines),
        distinct / np.sqrt(np.maximum(n_words, 1)) / 10.0,
    ]
    return np.column_stack([rates, *more])


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            rows = features(part.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "y", "share")), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "y", "share", "x"])


@dataclass
class Model:
    weights: np.ndarray
    most: np.ndarray
    threshold: float
    slope: float
    base: float


def _pairs(n1: int, n0: int, partners: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of preferred and other documents: every document gets `partners` of the other class, evenly."""
    rng = np.random.default_rng(3)
    better = np.concatenate([np.repeat(np.arange(n1), partners), rng.integers(0, n1, n0 * partners)])
    worse = np.concatenate([rng.integers(0, n0, n1 * partners), np.repeat(np.arange(n0), partners)])
    return better, worse


def rank(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = 1.0, steps: int = 25, block: int = 4096) -> np.ndarray:
    """Bradley-Terry weights by Newton steps: row better[i] of x beats row worse[i]. Differences exist for one block of pairs at a time."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        values = x @ w
        p = 1 / (1 + np.exp(-np.clip(values[better] - values[worse], -30, 30)))
        pull = np.bincount(better, weights=1 - p, minlength=len(x)) - np.bincount(worse, weights=1 - p, minlength=len(x))
        curve = ridge * np.eye(len(w))
        for low in range(0, len(better), block):
            part = slice(low, low + block)
            gaps = x[better[part]] - x[worse[part]]
            curve += (gaps * (p[part] * (1 - p[part]))[:, None]).T @ gaps
        step = np.linalg.solve(curve, x.T @ pull - ridge * w)
        moved = x @ step
        size = np.abs(moved[better] - moved[worse]).max(initial=0.0)
        w += step * min(1.0, 4.0 / max(size, 1e-9))  # one step moves no difference by more than 4
        if size < 1e-6:
            break
    return w


def _calibrated(values: DataFrame) -> tuple[float, float, float]:
    """Base rate, threshold and slope from the values of all labelled rows (y, value): the threshold is the middle of the gap below which
    as many rows lie as are labelled 0."""
    counts = values.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    n0 = counts["n"] - counts["n1"]
    threshold = exact_quantiles(values, [], "value", [(n0 - 0.5) / (counts["n"] - 1)]).first()["q"][0]
    slope, away = 1.0, F.col("value") - threshold
    sign = 2 * F.col("y") - 1
    for _ in range(25):  # the slope that fits the labels best at this threshold
        margin = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sign * away * slope))
        miss = 1 / (1 + F.exp(margin))
        sums = values.agg(F.sum(miss * sign * away).alias("pull"), F.sum(miss * (1 - miss) * away * away).alias("curve")).first()
        before, slope = slope, min(max(slope + (sums["pull"] - slope) / (sums["curve"] + 1), 0.05), 10.0)
        if abs(slope - before) < 1e-9:
            break
    return counts["n1"] / counts["n"], threshold, slope


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", examples: int = EXAMPLES, partners: int = PARTNERS) -> Model:
    """Learn from rows of `labels` (doc_id and the label): weights from at most `examples` of each class, base rate, threshold and slope from all."""
    texts = sampled_texts(docs, sampled(labels, label, examples)).dropDuplicates(["doc_id"])
    rows = texts.select("doc_id", "y", "share", "text").mapInArrow(_sampled_features, "doc_id long, y int, share double, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        base = float(y.mean()) if rows else 0.5
        return Model(np.zeros(FEATURES), np.full(FEATURES, np.inf), 0.0, 0.0, base)
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), -1)
    used = np.flatnonzero(x.max(axis=0) > x.min(axis=0))  # constant features get no weight
    spread = x[:, used].std(axis=0, dtype=np.float64)
    most = np.full(FEATURES, np.inf)
    most[used] = x[:, used].mean(axis=0) + CAP * spread
    scaled = np.minimum(x[:, used], most[used]) / spread
    one, zero = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    better, worse = _pairs(len(one), len(zero), partners)
    weights = rank(scaled, one[better], zero[worse])
    full = np.zeros(FEATURES)
    full[used] = weights / spread
    # Every labelled row is valued, not the sample alone. Texts are valued where they are read; two numbers a row meet the labels.
    valued = _valued(docs, Model(full, most, 0.0, 1.0, 0.5)).groupBy("doc_id").agg(F.min("value").alias("value"))
    values = stored(valued.join(once_labelled(labels, label), "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), "value"), "values")
    base, threshold, slope = _calibrated(values)
    return Model(full, most, threshold, slope, base)


def _values(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = given.value
        for batch in batches:
            for part in chunks(batch):
                values = np.minimum(features(part.column("text")), model.most) @ model.weights
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values)], ["doc_id", "value"])

    return run


def _valued(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and value for each row: its features times the weights."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_values(given), "doc_id long, value double")


def _score(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = given.value
        for batch in batches:
            for part in chunks(batch):
                values = np.minimum(features(part.column("text")), model.most) @ model.weights
                scores = 1 / (1 + np.exp(-np.clip((values - model.threshold) * model.slope, -500, 500))) if model.slope else np.full(len(values), model.base)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_score(given), "doc_id long, score double")
