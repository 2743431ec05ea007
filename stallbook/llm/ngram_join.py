"""Documents whose sets of word n-grams have a Jaccard similarity of at least `threshold`.

1. Documents with the same words are one class; one representative goes on.
2. MinHash bands of the representatives give buckets. Of buckets with the same members only one stays.
3. Members of a bucket compare their MinHash values step by step, and a pair is dropped once the posterior probability of reaching the
   threshold (uniform prior) falls below `tolerance`. Buckets are cut into blocks of bounded size; only the bands' own values, two bytes
   each, are sent. Members that pairs already connect are not compared again; a task returns which member each one hangs on.
4. What these pairs connect is a candidate group: texts that only share a template share buckets, but form no group. A group is cut into
   blocks of bounded size. Each pair of blocks is a task: pairs of bounded length ratio are judged on further MinHash values in the
   same way, and the rest is verified exactly on the n-gram sets.
5. A task returns a row for each representative: its number of linked documents and the smallest representative that
   links reach within the task. Pairs are never written, however large a group is.

Rows and bands follow from the threshold: a pair at it shares no bucket with probability (1 - threshold^rows)^bands, at most `MISS`;
each comparison step loses at most `tolerance`. The values of step 3 include those that agree in the bucket, which only keeps more. Nothing is capped: large groups only have more tasks.

Defined cases: null or empty texts and texts without words link with nothing. A text of fewer than `n` words has one n-gram, all its
words. A null doc_id takes no part and has null class_id and copy_of. Rows that share a doc_id are one node and end up in one class.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.tokens import chunks, split_words
from stallbook.operators.components import connected_components
from stallbook.scratch import stored

#: Probability that a pair at the threshold shares no bucket, and MinHash values of all bands (more where one row a band needs them).
MISS, VALUES = 6e-5, 192
#: MinHash values compared one step after the other, and values in a step.
SKETCH, STEP = 256, 32
#: Documents and n-grams of a block.
BLOCK_DOCS, BLOCK_GRAMS = 512, 1 << 20
#: Members of a block of a bucket, and rows that small buckets put in one task.
BUCKET_BLOCK, TASK_ROWS = 2048, 8192


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _grams(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of all texts, and where each text starts in them."""
    hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    counts = np.diff(words.starts)
    sizes = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first = np.repeat(words.starts[:-1], sizes) + np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    end = np.repeat(words.starts[1:], sizes)
    out = np.zeros(starts[-1], np.uint64)
    for j, factor in enumerate(_odd(11, n)):
        at = first + j
        inside = at < end
        out += np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))] * factor, np.uint64(0)) if len(hashes) else out
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out, starts


def rows_and_bands(threshold: float) -> tuple[int, int]:
    """The most rows of a band, and the bands they need, within `VALUES`."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold} is not in (0, 1]")
    needed = lambda rows: max(1, math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))) if threshold**rows < 1 else 1
    rows = 1
    while rows < VALUES and (rows + 1) * needed(rows + 1) <= VALUES:
        rows += 1
    return rows, needed(rows)


def _signatures(n: int, threshold: float):
    per_band, n_bands = rows_and_bands(threshold)
    factors, mix = _odd(5, per_band * n_bands), _odd(7, per_band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column("text"))
                order = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
                same = [xxhash.xxh3_128_digest(order[a:b].tobytes()) if b > a else None for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)]
                grams, starts = _grams(words, n)
                full = np.flatnonzero(np.diff(starts))
                bands = np.zeros((len(full), n_bands), np.uint64)
                hashed, values = np.empty_like(grams), np.empty((len(full), len(factors)), np.uint16)
                for k, factor in enumerate(factors if len(full) else ()):
                    np.multiply(grams, factor, out=hashed)
                    least = np.minimum.reduceat(hashed, starts[full]) >> np.uint64(32)
                    bands[:, k // per_band] += least * mix[k % per_band]
                    values[:, k] = least & np.uint64(0xFFFF)
                bands += np.arange(n_bands, dtype=np.uint64)  # a key belongs to one band
                bands ^= bands >> np.uint64(31)
                bands *= np.uint64(0x94D049BB133111EB)
                offsets = np.zeros(part.num_rows + 1, np.int32)
                offsets[full + 1] = n_bands
                sketch: list[bytes | None] = [None] * part.num_rows
                for i, row in zip(full.tolist(), values, strict=True):
                    sketch[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum(offsets).astype(np.int32)), pa.array(bands.ravel().view(np.int64))), pa.array(sketch, pa.binary())],
                    ["doc_id", "words", "bands", "sketch"],
                )

    return run


def _gram_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                grams, starts = _grams(split_words(part.column("text")), n)
                sets = [np.unique(grams[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("rep", "group", "copies")), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["rep", "group", "copies", "n_grams", "grams"],
                )

    return run


def least_matches(threshold: float, tolerance: float, values: int = SKETCH) -> dict[int, int]:
    """For n compared MinHash values, the fewest equal ones that leave a pair its chance.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m equal values of n, so it reaches the threshold with the
    probability that n + 1 draws of that chance have at most m successes.
    """
    out = {}
    for n in range(STEP, values + 1, STEP):
        below = 0.0
        for m in range(n + 2):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def _alive(sketch: np.ndarray, at: int, others: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Those of `others` that may reach the threshold with row `at`, after all steps."""
    equal = np.zeros(len(others), np.int32)
    for seen, fewest in least.items():
        if not len(others):
            break
        equal += (sketch[others, seen - STEP : seen] == sketch[at, seen - STEP : seen]).sum(axis=1, dtype=np.int32)
        keep = equal >= fewest
        others, equal = others[keep], equal[keep]
    return others


def _connect(threshold: float, tolerance: float):
    """rep, root of the members of buckets that pairs with a chance connect."""

    def run(table: pa.Table) -> pa.Table:
        key, rep, block, low, high = (table[c].to_numpy() for c in ("key", "rep", "block", "low", "high"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(len(rep), -1)
        least = least_matches(threshold, tolerance, sketch.shape[1])
        out: dict[str, list] = {"rep": [], "root": []}
        order = np.lexsort((rep, key))
        for members in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            first = members[0]
            rows, part = sketch[members], block[members]
            if low[first] == high[first]:
                left = right = np.arange(len(members))
            else:
                left, right = np.flatnonzero(part == low[first]), np.flatnonzero(part == high[first])
            root = np.arange(len(members))
            for place, a in enumerate(left):
                others = right[place + 1 :] if left is right else right
                found = _alive(rows, a, others[root[others] != root[a]], least)
                if len(found):
                    touched = np.unique(root[np.append(found, a)])
                    root[np.isin(root, touched)] = touched[0]
            moved = rep[members] != rep[members[root]]
            out["rep"].append(rep[members][moved])
            out["root"].append(rep[members[root]][moved])
        return pa.table({k: pa.array(np.concatenate(v), pa.int64()) for k, v in out.items()})

    return run


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, least: dict[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each place of `left`, the places of `right` it links with; of two places in both, the pair is met once."""
    exact = Fraction(str(threshold)).limit_denominator(10**9)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    own = [ids[e - s : e] for s, e in zip(sizes, ends, strict=True)]
    factors = _odd(13, SKETCH)
    sketch = np.empty((len(sets), SKETCH), np.uint32)
    for k, factor in enumerate(factors):
        sketch[:, k] = np.minimum.reduceat(flat * factor, ends - sizes) >> np.uint64(32)
    marked = np.zeros(ids.max() + 1, bool)
    same = left is right
    for at, a in enumerate(left):
        others = right[at + 1 :] if same else right
        others = others[np.minimum(sizes[others], sizes[a]) >= threshold * np.maximum(sizes[others], sizes[a]) - 1e-9]
        others = _alive(sketch, a, others, least)
        if not len(others):
            continue
        marked[own[a]] = True
        common = np.add.reduceat(marked[np.concatenate([own[b] for b in others])].astype(np.int32), np.cumsum(sizes[others]) - sizes[others])
        marked[own[a]] = False
        # Whole numbers on both sides: common / union >= threshold, the decimal fraction as written.
        union = sizes[others] + sizes[a] - common
        yield a, others[common.astype(np.int64) * exact.denominator >= union * exact.numerator]


def _verify(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(table: pa.Table) -> pa.Table:
        rep, group, copies, block, low, high = (table[c].to_numpy() for c in ("rep", "group", "copies", "block", "low", "high"))
        out = {"rep": [], "links": [], "root": []}
        order = np.lexsort((rep, group))
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for members in np.split(order, cuts):
            members = members[np.concatenate([[True], np.diff(rep[members]) != 0])]  # rows that share a doc_id are one node
            if len(members) < 2:
                continue
            sets = [np.frombuffer(table["grams"][int(i)].as_buffer(), np.uint64) for i in members]
            ids, weight, part = rep[members], copies[members], block[members]
            if low[members[0]] == high[members[0]]:
                left = right = np.arange(len(members))
            else:
                left, right = np.flatnonzero(part == low[members[0]]), np.flatnonzero(part == high[members[0]])
            links, root = np.zeros(len(members), np.int64), np.arange(len(members))
            for a, found in _linked(sets, left, right, threshold, least) if len(left) and len(right) else ():
                links[a] += weight[found].sum()
                links[found] += weight[a]
                touched = np.unique(root[np.append(found, a)])
                if len(touched) > 1:
                    root[np.isin(root, touched)] = touched[0]
            out["rep"].append(ids)
            out["links"].append(links)
            out["root"].append(ids[root])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in out.items()})

    return run


def candidate_groups(signed: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Classes of equal words (words, rep, copies), and node, component of the representatives that pairs with a chance connect."""
    classes = signed.filter("words is not null and doc_id is not null").groupBy("words").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("first"), F.count("*").alias("copies"))
    classes = stored(classes.select("words", F.col("first.doc_id").alias("rep"), "copies", F.col("first.bands").alias("bands"), F.col("first.sketch").alias("sketch")), "word_classes")
    named = [F.xxhash64(F.lit(i), "rep", "words").alias(f"h{i}") for i in (1, 2)]
    places = classes.select("rep", *named, F.explode("bands").alias("key"))
    buckets = places.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("first"), F.max("rep").alias("last"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    different = buckets.filter("first < last").groupBy("members", "first", "last", "x1", "x2").agg(F.min("key").alias("key"))
    blocks = different.select("key", F.ceil(F.col("members") / BUCKET_BLOCK).cast("int").alias("blocks"))
    met = stored(places.join(blocks, "key").select("key", "rep", "h1", "blocks"), "buckets")
    shared = max(1, met.count() // TASK_ROWS)
    visits = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(shared))).otherwise(F.xxhash64("key", low, high))
    tasks = visits.select("key", "rep", "h1", "block", low.alias("low"), high.alias("high"), task.alias("task"))
    sketches = classes.select(F.col("rep").alias("r"), named[0].alias("h"), "sketch")
    sent = tasks.join(sketches, (F.col("rep") == F.col("r")) & (F.col("h1") == F.col("h"))).select("task", "key", "rep", "block", "low", "high", "sketch")
    edges = stored(sent.groupBy("task").applyInArrow(_connect(threshold, tolerance), "rep long, root long").distinct(), "chances")
    return classes.drop("bands", "sketch"), connected_components(edges.select(F.col("rep").alias("u"), F.col("root").alias("v")))


def similar_documents(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id (smallest doc_id that links reach), copy_of (smallest doc_id with the same words), n_links for each row."""
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    signed = stored(docs.select(F.col("doc_id").cast("long"), binary).mapInArrow(_signatures(n, threshold), "doc_id long, words binary, bands array<long>, sketch binary"), "signatures")
    classes, nodes = candidate_groups(signed, threshold, tolerance)

    wanted = nodes.join(classes.select(F.col("rep").alias("node"), "copies"), "node").select(F.col("node").alias("doc_id"), F.col("component").alias("group"), "copies")
    texts = docs.select(F.col("doc_id").cast("long"), binary).join(wanted, "doc_id").select(F.col("doc_id").alias("rep"), "group", "copies", "text")
    sets = stored(texts.mapInArrow(_gram_sets(n), "rep long, group long, copies long, n_grams long, grams binary"), "gram_sets")

    sizes = sets.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    small = F.col("blocks") == 1
    total, n_sets = sets.agg(F.coalesce(F.sum("n_grams"), F.lit(0)), F.count("*")).first()
    shared = max(1, int(total // BLOCK_GRAMS), n_sets // BLOCK_DOCS)  # groups of one block share tasks
    blocked = sets.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tasks = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep",
        "group",
        "copies",
        "grams",
        "block",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        F.when(small, F.pmod(F.xxhash64("group"), F.lit(shared))).otherwise(F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))).alias("task"),
    )
    found = stored(tasks.groupBy("task").applyInArrow(_verify(threshold, tolerance), "rep long, links long, root long"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).filter("u <> v")).select(F.col("node").alias("rep"), "component")
    per_class = classes.join(links, "rep", "left").join(joined, "rep", "left")
    answers = per_class.select(
        "words", F.col("rep").alias("copy_of"), F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    lone = F.col("words").isNull()
    return (
        signed.select("doc_id", "words")
        .join(answers, "words", "left")
        .select(
            "doc_id",
            F.when(lone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
            F.when(lone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("copy_of")).alias("copy_of"),
            F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        )
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """One document of each class, the smallest doc_id, with all columns; documents without doc_id stay."""
    gone = similar_documents(docs, threshold, n).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("d"))
    return rows.join(gone, F.col("d.doc_id") == F.col("gone"), "left_anti").select("d.*")
