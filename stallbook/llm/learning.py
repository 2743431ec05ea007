"""Labelled rows for the learned operators: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo `folds`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def held_out(folds: int, out: int) -> Column:
    """Rows whose labels may not be learned from; a null doc_id is never learned from."""
    return F.coalesce(fold(folds) == out, F.lit(True))


def once_labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of labelled rows; labels other than 0 and 1 and repeated doc_ids with different labels are left out."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most")).filter("y = most").select("doc_id", "y")


def sampled(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, y, share of at most `limit` labelled rows of each class in hash order; `share` is the sampled part of its class.

    Labels other than 0 and 1 and repeated doc_ids with different labels are left out.
    """
    once = once_labelled(labels, label)
    totals = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [
        once.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", F.col("y").cast("int").alias("y"), F.lit(min(1.0, limit / n)).alias("share"))
        for y, n in sorted(totals.items())
    ]
    if not parts:
        return once.select("doc_id", F.col("y").cast("int").alias("y"), F.lit(1.0).alias("share")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, y, share, text (binary) of the sampled rows. The sample is bounded by its limit, so it may be broadcast."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")
