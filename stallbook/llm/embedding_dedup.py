"""Near-duplicate embeddings by binary codes of randomly rotated vectors.

1. Equal vectors of a label are one class; one representative goes on.
2. A vector is padded and rotated at random; the signs are its code, and the inner product of the vector with its code is stored as the
   correction factor. A rotated query's inner product with a code, divided by that factor, is an unbiased estimate of the cosine,
   with a known error bound.
3. Buckets hold vectors on the same side of each direction of a key. The number of directions of a key follows the logarithm of the
   largest label, and the number of keys is chosen so that a pair at the threshold shares a bucket with probability `recall`. All
   directions of all keys are independent Gaussian ones, so keys fail independently and the probability holds at any size. A pair is
   compared in the first bucket it shares, so no pair is formed twice, and buckets are cut into blocks of bounded size.
4. In a task, pairs whose estimate plus error bound stays below the threshold are dropped. All others are recomputed exactly in double
   precision. A task returns for each representative the number of linked vectors and the smallest representative that links
   reach there; pairs are never written.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label, link with nothing and
are their own component, as do vectors of another length. A null vec_id takes no part and has a null component. Rows that share a
vec_id are one node. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.operators.components import connected_components
from stallbook.scratch import stored

CODE_BITS = 256
#: Bits of a bucket key beyond the logarithm of the largest label's size: two unrelated vectors rarely meet.
EXTRA_BITS = 6
#: Width of the confidence interval of an estimate, in standard deviations of the code's error.
EPSILON = 5.0
#: Members of a block of a bucket, and rows that small buckets put in one task.
BLOCK, TASK_ROWS = 1024, 8192


@lru_cache(8)
def rotation(dims: int) -> np.ndarray:
    """dims x bits matrix with orthonormal rows, the same everywhere."""
    bits = max(CODE_BITS, -(-dims // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dims]


def bands(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a bucket key and number of keys."""
    bits = min(max(8, math.ceil(math.log2(max(largest, 2))) + EXTRA_BITS), 56)
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


@lru_cache(2)
def directions(dims: int, bits: int, keys: int) -> np.ndarray:
    """keys x dims x bits independent Gaussian directions, the same everywhere; each serves one key."""
    return np.random.default_rng(21).standard_normal((keys, dims, bits), np.float32)


def _keys(unit: np.ndarray, bits: int, keys: int, label: np.ndarray) -> np.ndarray:
    """Bucket keys (row x key) of unit vectors; a key belongs to one label and one set of directions."""
    powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    rows, out = unit.astype(np.float32), np.empty((len(unit), keys), np.uint64)
    for i, drawn in enumerate(directions(unit.shape[1], bits, keys)):
        out[:, i] = (rows @ drawn >= 0) @ powers + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15)
    out ^= label.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x94D049BB133111EB)


def _unit(vectors: list) -> np.ndarray:
    rows = np.asarray(vectors, np.float64)
    return rows / np.linalg.norm(rows / np.abs(rows).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(rows).max(axis=1, keepdims=True)


def _code(threshold: float, largest: int, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dims").to_pylist())
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                unit = _unit(part.column("embedding").to_pylist())
                turned = unit @ rotation(int(d))
                signs = turned >= 0
                factor = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
                keys = _keys(unit, *bands(largest, threshold, recall), part.column("label").to_numpy() * 4096 + d)
                codes = np.packbits(signs, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("rep", "copies", "embedding")),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(factor),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["rep", "copies", "embedding", "code", "factor", "keys"],
                )

    return run


def estimates(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of rotated queries (rows) with coded vectors (columns), and the half width of each column's interval."""
    bits = signs.shape[1]
    estimate = turned @ (2.0 * signs - 1).T / math.sqrt(bits) / factor
    return estimate, np.sqrt(np.maximum(1 - factor**2, 0.0)) / factor * epsilon / math.sqrt(bits - 1)


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"rep": [], "links": [], "root": []}
        dims = pc.list_value_length(table["embedding"]).to_numpy()
        for d in np.unique(dims):  # a key belongs to one length
            _compare(table.take(pa.array(np.flatnonzero(dims == d))).combine_chunks(), int(d), threshold, out)
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in out.items()})

    return run


def _compare(table: pa.Table, dims: int, threshold: float, out: dict[str, list]) -> None:
    """Links of all buckets of one task, appended to `out`."""
    key, rep, copies, band, block, low, high, factor = (table[c].to_numpy() for c in ("key", "rep", "copies", "band", "block", "low", "high", "factor"))
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
    unit, keys = _unit(flat("embedding")), flat("keys")
    turned = unit @ rotation(dims)
    signs = np.unpackbits(np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(rep), -1), axis=1)
    order = np.lexsort((rep, key))
    for members in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        members = members[np.concatenate([[True], np.diff(rep[members]) != 0])]
        if len(members) < 2:
            continue
        first = members[0]
        weight, here = copies[members], band[first]
        if low[first] == high[first]:
            left = right = np.arange(len(members))
        else:
            left, right = (np.flatnonzero(block[members] == x) for x in (low[first], high[first]))
        links, root = np.zeros(len(members), np.int64), np.arange(len(members))
        for place, a in enumerate(left):
            others = right[place + 1 :] if left is right else right
            # Pairs that share an earlier key are compared there.
            me, them = members[a], members[others]
            if here:
                fresh = ~(keys[them, :here] == keys[me, :here]).any(axis=1)
                others, them = others[fresh], them[fresh]
            guess, width = estimates(turned[me : me + 1], signs[them], factor[them])
            near = guess[0] + width >= threshold
            others, them = others[near], them[near]
            found = others[unit[them] @ unit[me] >= threshold]
            if not len(found):
                continue
            links[a] += weight[found].sum()
            links[found] += weight[a]
            touched = np.unique(root[np.append(found, a)])
            if len(touched) > 1:
                root[np.isin(root, touched)] = touched[0]
        some = links > 0
        out["rep"].append(rep[members][some])
        out["links"].append(links[some])
        out["root"].append(rep[members][root[some]])


def _comparable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def similar_vectors(embeddings: DataFrame, threshold: float = 0.93, recall: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vec_id, embedding, label."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), vector.alias("embedding"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _comparable(F.col("embedding"))
    same = [F.when(sound, F.xxhash64(F.lit(i), F.col("label"), F.size("embedding"), F.col("embedding"))).alias(f"h{i}") for i in (1, 2)]
    keyed = rows.select("vec_id", "label", "embedding", *same)
    classes = keyed.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("dims", F.size("embedding")), "vector_classes")
    largest = classes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 1

    schema = "rep long, copies long, embedding array<double>, code binary, factor double, keys array<long>"
    codes = stored(classes.select("rep", "copies", "label", "dims", "embedding").mapInArrow(_code(threshold, largest, recall), schema), "vector_codes")
    places = codes.select("rep", F.posexplode("keys").alias("band", "key"))
    buckets = places.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last").select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    met = stored(places.join(buckets, "key"), "vector_buckets")
    shared = max(1, met.count() // TASK_ROWS)
    other = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tasks = other.select(
        "key",
        "rep",
        "band",
        "block",
        low.alias("low"),
        high.alias("high"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(shared))).otherwise(F.xxhash64("key", low, high)).alias("task"),
    )
    found = stored(tasks.join(codes, "rep").groupBy("task").applyInArrow(_verify(threshold), "rep long, links long, root long"), "vector_links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).filter("u <> v")).select(F.col("node").alias("rep"), "component")
    answers = (
        classes.select("h1", "h2", "rep", "copies")
        .join(links, "rep", "left")
        .join(joined, "rep", "left")
        .select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    )
    out = keyed.select("vec_id", "h1", "h2").join(answers, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
