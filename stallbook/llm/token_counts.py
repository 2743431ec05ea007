"""Exact token counts: a histogram of encoded lengths and its suffix sums.

Every whole text is encoded with a byte-pair vocabulary file. The documents are then counted by length, and sums over the histogram from
the longest length down answer totals, quantiles and truncated totals for every context limit without another look at the texts.

Defined cases: a null or empty text has no tokens and counts as a document of length 0. Marks of special tokens are ordinary text.
Repeated rows count each. An empty table has an empty histogram. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallbook.llm.tokens import chunks
from stallbook.scratch import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern of the vocabulary, which cuts a text before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in one bucket of the suffix sums.
BUCKET = 1024

_ENCODERS: dict[int, object] = {}


def _encoder(file: bytes, pattern: str):
    """One encoder for each vocabulary and Python worker."""
    import tiktoken

    key = hash((file, pattern))
    if key not in _ENCODERS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def _count(file, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file.value, pattern)
        for batch in batches:
            for part in chunks(batch):
                sizes = [len(encoder.encode_ordinary(t.decode("utf-8", "replace"))) if t else 0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(sizes, np.int64))], ["doc_id", "n_tokens"])

    return run


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id and n_tokens for each row. The vocabulary file is read on the driver and broadcast; its size does not follow the data."""
    with open(vocabulary, "rb") as file:
        given = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_count(given, pattern), "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length: documents and tokens of documents at least that long, and totals over all documents cut at that length.

    Sums run inside buckets of lengths, and the buckets' totals are added from a table of one row for each bucket.
    """
    # The histogram is read three times; written, the texts are encoded once.
    hist = stored(hist, "lengths")
    placed = hist.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = placed.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    longer = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    beyond = totals.select(
        "bucket",
        F.coalesce(F.sum("b_docs").over(longer), F.lit(0)).alias("more_docs"),
        F.coalesce(F.sum("b_tokens").over(longer), F.lit(0)).alias("more_tokens"),
        F.sum("b_docs").over(whole).alias("all_docs"),
        F.sum("b_tokens").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = F.sum("n_docs").over(inside) + F.col("more_docs")
    tokens = F.sum("tokens").over(inside) + F.col("more_tokens")
    return (
        placed.join(beyond, "bucket")
        .withColumn("docs_at_least", docs)
        .withColumn("tokens_at_least", tokens)
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
            ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"),
        )
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens of all documents cut at `limit`: between two lengths the total rises by the number of longer documents."""
    below = sums.filter(F.col("n_tokens") < limit).agg(F.sum(F.col("n_tokens") * F.col("n_docs"))).first()[0] or 0
    longer = sums.filter(F.col("n_tokens") >= limit).agg(F.max("docs_at_least")).first()[0] or 0
    return below + longer * limit


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least `share` of the documents do not exceed."""
    return sums.filter(F.col("share_at_most") >= share).agg(F.min("n_tokens")).first()[0]
