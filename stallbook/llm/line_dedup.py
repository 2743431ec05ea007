"""Line deduplication over whole documents: the first document that holds a line keeps it.

Hashes of lines are range-partitioned by (key, document, line) and sorted inside the partitions. A stream over each
partition then sees every key's smallest document first. A key that fills several partitions needs no special
treatment: only the first run of a partition can have begun in an earlier one, and two rows for each partition (first
and last key with the smallest document seen there) settle these. The result is a compressed bitmap for each document,
not text.

Defined cases: a null or empty text is one empty line. Keys under `min_chars` code points never drop. Lines of a null
doc_id neither drop nor count as an occurrence. Rows that share a doc_id are one document for the comparison, and each
row is answered; identical rows have the same answer. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from stallbook.scratch import stored

_HASHED = "hi long, lo long, doc_id long, row long, line int"
_DROP, _HEAD, _EDGE = 0, 1, 2


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, rows, texts = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy(), batch.column("text")
            for at in range(batch.num_rows):
                # ASCII rules on bytes: only A-Z are lower-cased and only \x20 and \x09-\x0D are stripped.
                keys = [line.strip() for line in texts[at].as_py().lower().split(b"\n")]
                kept = [i for i, k in enumerate(keys) if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars)]
                if kept:
                    both = np.frombuffer(b"".join([digest(keys[i]) for i in kept]), ">i8").astype(np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(kept), ids[at])), pa.array(np.full(len(kept), rows[at])), pa.array(kept, pa.int32())],
                        ["hi", "lo", "doc_id", "row", "line"],
                    )

    return run


def _together(run, size: int = 1 << 16):
    """Join many small batches of a stage before they cross to the JVM."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def _first_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decisions of one sorted partition: rows to drop, rows of the first run that stay open, and the two edges."""

    def out(kind: int, hi, lo, doc, row, line) -> pa.RecordBatch:
        n = len(hi)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(hi), pa.array(lo), pa.array(doc), pa.array(row), pa.array(line)], ["kind", "hi", "lo", "doc_id", "row", "line"]
        )

    def edge(hi: int, lo: int, doc: int) -> pa.RecordBatch:
        return out(_EDGE, *(np.array([x], np.int64) for x in (hi, lo, doc, 0)), np.array([0], np.int32))

    head = run = None  # (hi, lo, smallest document) of the partition's first key, and of the key at hand
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc, row, line = (batch.column(c).to_numpy() for c in ("hi", "lo", "doc_id", "row", "line"))
        fresh = np.ones(len(hi), bool)
        fresh[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        goes_on = run is not None and run[:2] == (hi[0], lo[0])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hi)), 0))
        smallest = doc[begin]
        if goes_on:
            smallest[begin == 0] = run[2]
        if head is None:
            head = (hi[0], lo[0], doc[0])
            yield edge(*head)
        later = doc != smallest
        yield out(_DROP, hi[later], lo[later], doc[later], row[later], line[later])
        if (hi[0], lo[0]) == head[:2]:
            unsure = ~later & (hi == head[0]) & (lo == head[1])
            yield out(_HEAD, hi[unsure], lo[unsure], doc[unsure], row[unsure], line[unsure])
        run = (hi[-1], lo[-1], smallest[-1])
    if run is not None and run[:2] != head[:2]:
        yield edge(*run)


@F.pandas_udf(BinaryType())
def _pack(lines: pd.Series) -> pd.Series:
    def bitmap(dropped) -> bytes:
        keep = np.ones(max(dropped) // 8 * 8 + 8, np.uint8)
        keep[np.asarray(dropped)] = 0
        return zlib.compress(np.packbits(keep).tobytes())

    return lines.map(bitmap)


def row_key(text: str = "text") -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, row (see `row_key`) and keep (see `kept_lines`) of the documents that lose a line; all others keep every line."""
    lines = docs.filter("doc_id is not null").select("doc_id", row_key().alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    hashed = stored(lines.mapInArrow(_together(_hash_lines(min_chars)), _HASHED), "line_hashes")
    ordered = hashed.repartitionByRange("hi", "lo", "doc_id", "line").sortWithinPartitions("hi", "lo", "doc_id", "line")
    decided = stored(ordered.mapInArrow(_together(_first_documents), "kind int, " + _HASHED), "line_decisions")
    # Two rows for each partition at most, whatever the input holds.
    edges = decided.filter(F.col("kind") == _EDGE).groupBy("hi", "lo").agg(F.min("doc_id").alias("smallest"))
    open_rows = decided.filter(F.col("kind") == _HEAD).join(F.broadcast(edges), ["hi", "lo"]).filter("doc_id > smallest")
    drops = decided.filter(F.col("kind") == _DROP).select("doc_id", "row", "line").unionByName(open_rows.select("doc_id", "row", "line"))
    return drops.groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines")).select("doc_id", "row", _pack("lines").alias("keep"))


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[str], int]:
    """Lines that stay, and the number of all lines. keep: packed bits, compressed; lines beyond its end stay, as do all without it."""
    lines = (text or "").split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


@F.pandas_udf(StructType().add("n_lines", LongType()).add("n_dropped", LongType()).add("kept_sha256", StringType()))
def kept_digest(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    out = []
    for t, k in zip(text, keep, strict=True):
        lines, n = kept_lines(t, k)
        out.append((n, n - len(lines), hashlib.sha256("\n".join(lines).encode("utf-8", "replace")).hexdigest()))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_sha256"])


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(kept_lines(t, k)[0]) if k is not None else t for t, k in zip(text, keep, strict=True)], dtype=object)


def with_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """`row`: the row as a struct, `keep`: its bitmap or null."""
    bitmaps = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias("b_doc"), F.col("row").alias("b_row"), "keep")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("r_doc"), row_key().alias("r_row"))
    return rows.join(bitmaps, (rows.r_doc == bitmaps.b_doc) & (rows.r_row == bitmaps.b_row), "left").select("row", "keep")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The documents without the lines that an earlier document holds; n_chars follows the text."""
    joined = with_bitmaps(docs, min_chars)
    cut = F.col("row").withField("text", kept_text("row.text", "keep"))
    out = joined.select(cut.alias("row")).select("row.*")
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
