"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Learning, on a bounded sample of labelled documents: terms are words and the first `PREFIX` characters of words. A term is kept if its
distinct contexts (the word before it) are at least `lift` times as frequent in toxic texts, beyond what chance gives the best
of all terms; copies of one text count once. Every text also has one constant term with the middle IDF, so that a single kept term is nearer to texts without
any than to texts with many. The examples' TF-IDF vectors over these terms form an inverted index in blocks with the highest weight of each
term and block.

Scoring: a document's vector visits blocks in the order of their upper bounds and stops where no block can hold a nearer
example than the `k` found: the neighbours are exact. Each neighbour votes with its squared cosine divided by the sampled share of its
class; a prior of the base rate is added, so weak similarity cannot decide. A monotone map, fitted to the examples' votes without
themselves, turns votes into rates.

Defined cases: null or empty texts have no terms. Without labels of both classes all scores are the base rate (0.5 without labels).
Equal cosines are ordered by example number. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.learning import sampled, sampled_texts
from stallbook.llm.tokens import Words, chunks, split_words
from stallbook.scratch import stored

PREFIX = 4
#: Bounds of the learned model: examples of each class and kept terms.
EXAMPLES, TERMS = 3000, 4000
BLOCK = 64


def _forms(words: Words) -> tuple[list[bytes], list[bytes]]:
    """Each distinct word as a term, and its prefix as one."""
    full = words.terms.to_pylist()
    return full, [b"^" + t.decode("utf-8", "replace")[:PREFIX].encode() for t in full]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct y, term, word before it of each chunk of examples."""
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"))
            full, prefixes = _forms(words)
            y = np.repeat(np.asarray(part.column("y").to_pylist(), np.int64), np.diff(words.starts))
            before = np.concatenate([[-1], words.codes[:-1]]) if len(words.codes) else np.zeros(0, np.int64)
            before[words.starts[:-1][np.diff(words.starts) > 0]] = -1
            seen = np.unique(np.stack([words.codes.astype(np.int64), before.astype(np.int64), y]), axis=1)
            names = [b"", *full]
            for form in (full, prefixes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([form[c] for c in seen[0]], pa.binary()), pa.array([names[b + 1] for b in seen[1]], pa.binary()), pa.array(seen[2].astype(np.int32))], ["term", "before", "y"]
                )


def choose_terms(texts: DataFrame, limit: int = TERMS, lift: float = 5.0, margin: float = -4.0) -> list[bytes]:
    """Terms that are at least `lift` times as frequent in the contexts of toxic texts, the clearest first.

    The likelihood ratio statistic must exceed what the best of all tested terms reaches by chance, plus `margin`.
    """
    contexts = texts.select("y", "text").mapInArrow(_contexts, "term binary, before binary, y int").distinct()
    counts = contexts.groupBy("term").agg(F.count(F.when(F.col("y") == 1, 1)).alias("a"), F.count(F.when(F.col("y") == 0, 1)).alias("b"))
    counts = stored(counts, "term_contexts")
    total = counts.agg(F.count("*").alias("terms"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not total["a"] or not total["b"]:
        return []
    part = total["a"] / (total["a"] + total["b"])
    n = F.col("a") + F.col("b")
    side = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (n * share))).otherwise(0.0)
    ratio = 2 * (side(F.col("a"), part) + side(F.col("b"), 1 - part))
    scored = counts.withColumn("ratio", ratio).filter((F.col("ratio") >= 2 * math.log(total["terms"]) + margin) & (F.col("a") * (1 - part) >= lift * F.col("b") * part))
    return [bytes(r["term"]) for r in scored.orderBy(F.col("ratio").desc(), "term").limit(limit).collect()]


@dataclass
class Model:
    """Inverted index of the examples' unit vectors. Postings of term t: `ptr[t]` to `ptr[t + 1]`, ordered by example."""

    terms: dict[bytes, int]
    idf: np.ndarray
    ptr: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    block_max: np.ndarray
    y: np.ndarray
    vote: np.ndarray
    ids: np.ndarray
    base: float
    k: int
    prior: float
    vote_at: np.ndarray
    rate_at: np.ndarray

    def vote_of(self, terms: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[float, np.ndarray]:
        """Share of the toxic votes, and the nearest examples; `without` leaves one example out."""
        own = np.append(terms, len(self.terms)).astype(np.int64)
        found, cosines = nearest(self, own, _unit(own, np.append(counts, 1), self.idf), self.k + (without >= 0))
        other = found != without
        found, cosines = found[other][: self.k], cosines[other][: self.k]
        votes = cosines**2 * self.vote[found]
        return float(((votes * self.y[found]).sum() + self.prior * self.base) / (votes.sum() + self.prior)), found

    def judge(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Score and the doc_ids of the nearest examples."""
        if not len(self.ids):
            return self.base, []
        share, found = self.vote_of(terms, counts)
        return float(np.interp(share, self.vote_at, self.rate_at)), self.ids[found].tolist()


def term_counts(words: Words, terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the kept terms in all texts, sorted by text."""
    full, prefixes = _forms(words)
    owner = np.repeat(np.arange(len(words.starts) - 1), np.diff(words.starts))
    keys = []
    for form in (full, prefixes):
        ids = np.fromiter((terms.get(t, -1) for t in form), np.int64, len(form))
        own = ids[words.codes] if len(form) else np.zeros(0, np.int64)
        there = own >= 0
        keys.append(owner[there] * len(terms) + own[there])
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return found // max(1, len(terms)), found % max(1, len(terms)), counts


def _unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(counts)) * idf[terms]
    return weights / np.sqrt((weights**2).sum())


def _vectors(terms: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text, term, count = term_counts(split_words(part.column("text")), terms)
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "y", "share")), *lists], ["doc_id", "y", "share", "terms", "counts"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, k: int = 15, prior: float = 0.1) -> Model:
    """Learn from rows of `labels` (doc_id and the label); at most `examples` of each class."""
    texts = stored(sampled_texts(docs, sampled(labels, label, examples)).dropDuplicates(["doc_id"]), "examples")
    names = choose_terms(texts)
    terms = {t: i for i, t in enumerate(names)}
    # Bounded: the sample times the kept terms of a text.
    rows = texts.mapInArrow(_vectors(terms), "doc_id long, y int, share double, terms array<int>, counts array<int>").collect()
    # Neighbouring examples share their rarest term, which makes the blocks' bounds tight.
    rows.sort(key=lambda r: (not r["terms"], min(r["terms"], default=0), sorted(r["terms"]), r["doc_id"]))
    classes = Counter()
    for r in rows:
        classes[r["y"]] += 1 / r["share"]
    base = classes[1] / sum(classes.values()) if rows else 0.5
    known = rows if len(classes) == 2 else []
    df = np.bincount(np.concatenate([r["terms"] for r in known]).astype(np.int64), minlength=len(terms)) if known else np.ones(len(terms))
    idf = np.log((1 + len(known)) / (1 + df)) + 1
    idf = np.append(idf, np.median(idf) if len(idf) else 1.0)
    blocks = -(-len(known) // BLOCK)
    block_max = np.zeros((len(idf), blocks), np.float64)
    postings: list[tuple[int, int, float]] = []
    for e, r in enumerate(known):
        own = np.append(r["terms"], len(terms)).astype(np.int64)
        for t, w in zip(own.tolist(), _unit(own, np.append(r["counts"], 1), idf).tolist(), strict=True):
            postings.append((t, e, w))
            block_max[t, e // BLOCK] = max(block_max[t, e // BLOCK], w)
    postings.sort()
    table = np.array(postings, np.float64).reshape(-1, 3)
    model = Model(
        terms=terms,
        idf=idf,
        ptr=np.searchsorted(table[:, 0], np.arange(len(idf) + 1)),
        example=table[:, 1].astype(np.int64),
        weight=table[:, 2],
        block_max=block_max,
        y=np.array([r["y"] for r in known], np.float64),
        vote=np.array([1 / r["share"] for r in known]) / min((1 / r["share"] for r in known), default=1.0),
        ids=np.array([r["doc_id"] for r in known], np.int64),
        base=base,
        k=k,
        prior=prior,
        vote_at=np.array([0.0, 1.0]),
        rate_at=np.array([0.0, 1.0]),
    )
    if known:
        own = np.array([model.vote_of(np.array(r["terms"]), np.array(r["counts"]), e)[0] for e, r in enumerate(known)])
        model.vote_at, model.rate_at = monotone(own, model.y, model.vote, base)
    return model


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising rates of y along x: neighbouring values are pooled as long as a rate falls. One base observation is added to each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted y, weighted x
    for w, ones, at in zip(weight[order], y[order], x[order], strict=True):
        pools.append([w, w * ones, w * at])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0] or pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0] - 1e-9):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    rates = np.array([(ones + base) / (w + 1) for w, ones, _ in pools])
    return np.array([at / w for w, _, at in pools]), np.maximum.accumulate(rates)


def nearest(model: Model, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k examples of highest cosine, exactly, with it; only those above 0."""
    bounds = weights @ model.block_max[terms]
    order = np.argsort(-bounds, kind="stable")
    found, cosines = np.zeros(0, np.int64), np.zeros(0)
    lists = [(model.example[a:b], model.weight[a:b] * w) for a, b, w in zip(model.ptr[terms], model.ptr[terms + 1], weights, strict=True)]
    for at in order:
        # 1e-12: bounds and cosines are sums in different orders.
        if bounds[at] <= 0 or (len(found) >= k and bounds[at] + 1e-12 < cosines[k - 1]):
            break
        first = at * BLOCK
        scores = np.zeros(BLOCK)
        for examples, parts in lists:
            a, b = np.searchsorted(examples, (first, first + BLOCK))
            scores[examples[a:b] - first] += parts[a:b]
        hit = np.flatnonzero(scores > 0)
        found, cosines = np.append(found, hit + first), np.append(cosines, scores[hit])
        best = np.lexsort((found, -cosines))[:k]
        found, cosines = found[best], cosines[best]
    return found, cosines


def _judged(model: Model, texts: pa.Array, bare: tuple[float, list[int]]) -> tuple[np.ndarray, list[list[int]]]:
    """Scores and evidence of some texts; `bare` is that of all texts without terms."""
    text, term, count = term_counts(split_words(texts), model.terms)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    scores, evidence = np.empty(len(texts)), []
    for i in range(len(texts)):
        if cuts[i] == cuts[i + 1]:
            scores[i], found = bare
        else:
            scores[i], found = model.judge(term[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]])
        evidence.append(found)
    return scores, evidence


def _bare(model: Model) -> tuple[float, list[int]]:
    return model.judge(np.zeros(0, np.int64), np.zeros(0, np.int64))


def _score(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = given.value
        bare = _bare(model)
        for batch in batches:
            for part in chunks(batch):
                scores, evidence = _judged(model, part.column("text"), bare)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "row", "score", "evidence"])

    return run


def _below(given, threshold: float):
    """The rows of a batch, with all their columns, whose text scores below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = given.value
        bare = _bare(model)
        for batch in batches:
            kind = pa.large_binary() if pa.types.is_large_string(batch.column("text").type) else pa.binary()
            texts = pa.RecordBatch.from_arrays([batch.column("text").cast(kind).fill_null(b"")], ["text"])
            scores = [_judged(model, part.column("text"), bare)[0] for part in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < threshold))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row (hash of the text), score and evidence (doc_ids of the neighbours, the nearest first) for each row."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES and TERMS
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_score(given), "doc_id long, row long, score double, evidence array<long>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with all their columns. One map: no text is shuffled."""
    given = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # bounded by EXAMPLES and TERMS
    return docs.mapInArrow(_below(given, threshold), docs.schema)
