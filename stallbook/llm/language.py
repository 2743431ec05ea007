"""Languages of the words of a text by a linear-chain conditional random field.

The states of the chain are the learned languages. A word's features are its form (the lexicon), its affixes of 2 to 4 bytes and
the byte n-grams of 2 to 4 inside it, hashed to `BUCKETS` weights for each language; neighbouring words share learned transition weights.
Training maximises the likelihood of word labels on stretches of words from a bounded sample of documents; every second stretch is joined
from two documents, so switching is learned. Labelling runs forward-backward over stretches of up to `STRETCH` words of the whole
text. A document's language is the one with the highest mean probability over the words that have a letter, and that mean is its score.

Defined cases: a null text, or one without letters, is `und` with score 0. Null languages are not learned; without any language
all texts are `und`. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.tokens import Words, chunks, split_words

BUCKETS = 1 << 16
STRETCH = 64
#: Bounds of the sample: documents of each language (about), stretches of a document, words of a stretch.
DOCUMENTS, STRETCHES, LENGTH = 500, 4, 24
NGRAMS = (2, 3, 4)


def term_features(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term number, bucket) of every feature of the terms of a binary array."""
    lengths = np.array([len(t) for t in terms.to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(terms.to_pylist()), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    numbers, buckets = [], []

    def add(who: np.ndarray, hashed: np.ndarray, family: int) -> None:
        mixed = (hashed + np.uint64(family * 0x9E3779B1)) * np.uint64(0x9E3779B97F4A7C15)
        numbers.append(who)
        buckets.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS)

    rolled = flat.copy()
    for n in range(2, max(NGRAMS) + 1):
        # Hash of the n bytes from each place on.
        rolled = rolled[:-1] * np.uint64(1099511628211) + flat[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n not in NGRAMS:
            continue
        at = np.arange(len(rolled))
        inside = owner[at] == owner[at + n - 1]
        add(owner[at[inside]], rolled[inside], n)
        long = np.flatnonzero(lengths >= n)
        add(long, rolled[begins[long]], 10 + n)
        add(long, rolled[ends[long] - n], 20 + n)
    if len(lengths):
        place = (np.arange(len(flat)) - begins[owner]).astype(np.uint64)
        whole = np.add.reduceat((flat + place * np.uint64(257)) * (flat * np.uint64(0xD6E8FEB86659FD93) + place * np.uint64(0xA0761D6478BD642F) + np.uint64(1)), begins)
        add(np.arange(len(lengths)), whole, 30)
    return np.concatenate(numbers) if numbers else np.zeros(0, np.int64), np.concatenate(buckets) if buckets else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language
    steps: np.ndarray  # language x next language
    first: np.ndarray

    def emissions(self, terms: pa.Array) -> np.ndarray:
        """Sum of the weights of a term's features for each language."""
        who, bucket = term_features(terms)
        return np.column_stack([np.bincount(who, weights=self.weights[bucket, c], minlength=len(terms)) for c in range(len(self.languages))])


def marginals(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward on stretches (stretch, word, language) of the given lengths.

    Returns the probability of each language at each word, the expected number of each step, and the log partition functions.
    """
    n, width, _ = scores.shape
    top = scores.max(axis=2)
    local = np.exp(scores - top[:, :, None])
    move = np.exp(steps - steps.max())
    forward, scale = np.empty_like(local), np.ones((n, width))
    state = local[:, 0] * np.exp(first - first.max())
    for t in range(width):
        if t:
            state = np.where((t < lengths)[:, None], (forward[:, t - 1] @ move) * local[:, t], forward[:, t - 1])
        scale[:, t] = state.sum(axis=1)
        forward[:, t] = state / scale[:, t, None]
        state = forward[:, t]
    inside = np.arange(width) < lengths[:, None]
    log_z = (np.where(inside, np.log(scale) + top, 0.0)).sum(axis=1) + (lengths - 1) * steps.max() + first.max()
    backward = np.ones_like(local)
    expected = np.zeros_like(steps)
    for t in range(width - 2, -1, -1):
        ahead = local[:, t + 1] * backward[:, t + 1]
        there = (t + 1 < lengths)[:, None]
        expected += (forward[:, t, :, None] * move * (ahead * there / scale[:, t + 1, None])[:, None, :]).sum(axis=0)
        backward[:, t] = np.where(there, (ahead @ move.T) / scale[:, t + 1, None], 1.0)
    both = forward * backward
    return both / both.sum(axis=2, keepdims=True), expected, log_z


def train(stretches: list[tuple[list[bytes], list[int]]], languages: list[str], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """Adaptive gradient ascent on the log likelihood of word labels."""
    c = len(languages)
    terms = pa.array([w for words, _ in stretches for w in words], pa.binary()).dictionary_encode()
    codes, vocabulary = terms.indices.to_numpy().astype(np.int64), terms.dictionary
    who, bucket = term_features(vocabulary)
    lengths = np.array([len(words) for words, _ in stretches])
    width = lengths.max()
    inside = np.arange(width) < lengths[:, None]
    grid, gold = np.zeros((len(stretches), width), np.int64), np.zeros((len(stretches), width), np.int64)
    grid[inside] = codes
    gold[inside] = [y for _, labels in stretches for y in labels]
    hot = np.eye(c)[gold] * inside[:, :, None]
    seen_steps = np.einsum("ntc,ntd->cd", hot[:, :-1], hot[:, 1:])
    weights, steps, first = np.zeros((BUCKETS, c)), np.zeros((c, c)), np.zeros(c)
    squares = [np.full_like(x, 1e-6) for x in (weights, steps, first)]
    for _ in range(rounds):
        emitted = np.column_stack([np.bincount(who, weights=weights[bucket, k], minlength=len(vocabulary)) for k in range(c)])
        own, expected, _ = marginals(emitted[grid], lengths, steps, first)
        miss = (hot - own * inside[:, :, None]) / len(codes)
        by_term = np.column_stack([np.bincount(codes, weights=miss[inside][:, k], minlength=len(vocabulary)) for k in range(c)])
        slopes = [
            np.column_stack([np.bincount(bucket, weights=by_term[who, k], minlength=BUCKETS) for k in range(c)]) - ridge * weights / len(languages) / 100,
            (seen_steps - expected) / len(codes),
            (hot[:, 0] - own[:, 0]).sum(axis=0) / len(codes),
        ]
        for value, slope, square in zip((weights, steps, first), slopes, squares, strict=True):
            square += slope**2
            value += rate * slope / np.sqrt(square)
    return Model(languages, weights, steps, first)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to STRETCHES stretches of LENGTH words, spread evenly over each text."""
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"))
            terms = words.terms.to_pylist()
            ids, langs, out = [], [], []
            for i, (doc, lang) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), strict=True)):
                a, b = words.starts[i], words.starts[i + 1]
                places = range(a, b, LENGTH)
                for p in {places[k * len(places) // STRETCHES] for k in range(STRETCHES)} if len(places) else ():
                    ids.append(doc)
                    langs.append(lang)
                    out.append([terms[c] for c in words.codes[p : min(p + LENGTH, b)]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.binary()))], ["doc_id", "lang", "words"])


def fit(docs: DataFrame, documents: int = DOCUMENTS) -> Model:
    """Learn from text and lang of the given documents."""
    known = docs.filter("lang is not null and doc_id is not null").select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    # One row for each language, as the model has a column for each. The hash threshold keeps about `documents` rows of each.
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    sample = known.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.col("n")) < documents)
    rows = sample.select("doc_id", "lang", "text").mapInArrow(_stretches, "doc_id long, lang string, words array<binary>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], [bytes(w) for w in r["words"]]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(languages)}
    plain = [([bytes(w) for w in r["words"]], [number[r["lang"]]] * len(r["words"])) for r in rows]
    other = np.random.default_rng(9).permutation(len(plain))
    joined = [
        (words + plain[o][0], labels + plain[o][1]) if i % 2 else (words, labels) for i, ((words, labels), o) in enumerate(zip(plain, other, strict=True))
    ]
    return train(joined, languages)


def _letters(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((any(map(str.isalpha, t.decode("utf-8", "replace"))) if not t.isdigit() else False for t in terms), bool, len(terms))


def word_probabilities(words: Words, model: Model) -> np.ndarray:
    """Probability of each language for each word; stretches do not cross texts."""
    n = np.diff(words.starts)
    parts = -(-n // STRETCH)
    owner = np.repeat(np.arange(len(n)), parts)
    begin = words.starts[:-1][owner] + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
    lengths = np.minimum(words.starts[1:][owner] - begin, STRETCH)
    out = np.empty((len(words.codes), len(model.languages)))
    emitted = model.emissions(words.terms)
    for low in range(0, len(begin), 2048):
        at, size = begin[low : low + 2048], lengths[low : low + 2048]
        inside = np.arange(STRETCH) < size[:, None]
        places = np.minimum(at[:, None] + np.arange(STRETCH), len(words.codes) - 1)
        own, _, _ = marginals(emitted[words.codes[places]], size, model.steps, model.first)
        out[places[inside]] = own[inside]
    return out


def _label(given, runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = given.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column("text"))
                best, score = np.full(part.num_rows, len(model.languages)), np.zeros(part.num_rows)
                switches: list[list[dict]] = [[] for _ in range(part.num_rows)]
                if len(words.codes) and model.languages:
                    own = word_probabilities(words, model)
                    letters = _letters(words.terms.to_pylist())[words.codes]
                    owner = np.repeat(np.arange(part.num_rows), np.diff(words.starts))
                    total = np.bincount(owner[letters], minlength=part.num_rows)
                    sums = np.column_stack([np.bincount(owner[letters], weights=own[letters, c], minlength=part.num_rows) for c in range(len(model.languages))])
                    some = total > 0
                    best[some] = sums[some].argmax(axis=1)
                    score[some] = np.clip(sums[some].max(axis=1) / total[some], 0.0, 1.0)
                    if runs:
                        label = np.where(letters, own.argmax(axis=1), len(model.languages))
                        turn = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])]))
                        for a, b in zip(turn, np.append(turn[1:], len(label)), strict=True):
                            base = words.starts[owner[a]]
                            switches[owner[a]].append({"start": int(a - base), "end": int(b - base), "lang": names[label[a]]})
                columns = [part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score)]
                if runs:
                    columns.append(pa.array(switches, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "runs"][: len(columns)])

    return run


def label(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for each row; with `runs` also the runs of words (start, end, lang) of code-switched text."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    schema = "doc_id long, lang_pred string, score double" + (", runs array<struct<start:int,end:int,lang:string>>" if runs else "")
    return rows.mapInArrow(_label(given, runs), schema)
