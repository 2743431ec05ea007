"""Exact deduplication by an extendible-hash index on shared files.

1. Every normalised text has a 64-bit key. A directory of one bucket doubles, one key bit at a time, as long as a bucket holds more
   than its share of text or rows (`SHARE`, `BUCKET_BYTES`, `BUCKET_ROWS`); only the overfull ones split. Doubling ends a few bits after an even spread would fit. A
   bucket that stays overfull then holds copies, which no further bit can part: it becomes a chain of pages.
2. The directory is a written table; it has a few entries for each bucket of 64 MB, and a copy is sent to every task.
3. Owner tasks process ranges of keys: the directory deals buckets and pages to owners in key order, so every owner has about one
   bucket of text. Inside an owner rows are sorted by key and streamed: rows with one key form a chain of distinct texts, and
   each row is compared with them byte by byte. Copies within a batch of documents travel once.
4. The pages of a chained bucket are settled by a second walk over their distinct texts only.

The written index has one row per document: key, bucket, page, place in the key's chain, digest, and the row that stays.

Defined cases: null texts count as empty, and empty texts are equal to each other but not to a single space. The row with the smallest
doc_id stays, a null doc_id comes last; among equal rows with that doc_id exactly one stays. A very long text is compared whole. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from stallbook.scratch import fresh_dir, stored

#: Text and rows that an owner task takes at once: a share of the corpus within these bounds.
SHARE = 200
BUCKET_BYTES, BUCKET_ROWS = (1 << 20, 64 << 20), (1 << 10, 1 << 17)
#: Bits beyond those of an even spread; a bucket that is still overfull is chained.
EXTRA_BITS = 3

_SPACE = b" \t\n\x0b\x0c\r"
_ROUTED = pa.schema(
    [("owner", pa.int32()), ("bucket", pa.int32()), ("page", pa.int32()), ("hash", pa.int64()), ("text", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]
)
_INDEXED = pa.schema(
    [("bucket", pa.int32()), ("page", pa.int32()), ("hash", pa.int64()), ("chain", pa.int32()), ("doc_id", pa.int64()), ("first", pa.bool_())]
    + [("keep_id", pa.int64()), ("group_size", pa.int64()), ("sha256", pa.binary()), ("n_bytes", pa.int64()), ("text", pa.binary())]
)


def normalised(text: bytes) -> bytes:
    """The text with a single space for every run of ASCII white space."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    return (b" " if text[0] in _SPACE else b"") + body + (b" " if text[-1] in _SPACE else b"")


def _digest(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalised(t or b"") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_signed(_digest(t)) for t in texts], pa.int64()), pa.array(map(len, texts), pa.int64())], ["hash", "n_bytes"])


@dataclass
class Directory:
    """Slot i stands for the keys that begin with the `depth` bits of i."""

    depth: int
    bucket: np.ndarray
    local_depth: np.ndarray
    #: By bucket, in key order.
    pages: np.ndarray
    owner: np.ndarray
    n_owners: int

    def slot(self, key: int) -> int:
        return key >> (64 - self.depth) if self.depth else 0


def split_buckets(depth: int, rows: np.ndarray, size: np.ndarray, most_rows: float, most_bytes: float) -> Directory:
    """Directory over the counts of all prefixes of `depth` bits: it doubles while a bucket is overfull."""
    full = lambda r, s: (s > most_bytes) | (r > most_rows)
    local, used = np.zeros(1, np.int8), 0
    while used < depth:
        r, s = (x.reshape(1 << used, -1).sum(axis=1) for x in (rows, size))
        # Slots of a bucket that stopped splitting earlier are part of it, and small.
        splits = full(r, s) & (local == used)
        if not splits.any():
            break
        local = np.repeat(np.where(splits, used + 1, local), 2)
        used += 1
    slots = np.arange(1 << used)
    first = (slots & ((1 << (used - local.astype(np.int64))) - 1)) == 0
    bucket = np.cumsum(first) - 1
    r, s = (np.bincount(bucket, x.reshape(1 << used, -1).sum(axis=1)) for x in (rows, size))
    pages = np.where(full(r, s), np.maximum(-(-r // most_rows), -(-s // most_bytes)), 1).astype(np.int64)
    # Buckets go to owners in key order; one owner takes neighbours up to the size of a bucket, a chain has an owner per page.
    owner = np.zeros(len(pages), np.int64)
    at, held, held_rows = -1, 0.0, 0.0
    for b in range(len(pages)):
        fits = pages[b] == 1 and at >= 0 and held + s[b] <= most_bytes and held_rows + r[b] <= most_rows
        if not fits:
            at, held, held_rows = at + 1, 0.0, 0.0
        owner[b] = at
        held, held_rows = held + s[b], held_rows + r[b]
        if pages[b] > 1:
            at, held = at + int(pages[b]) - 1, float("inf")
    return Directory(used, bucket, local, pages, owner, at + 1)


def _directory(keys: DataFrame) -> Directory:
    """Counts come to the driver for prefixes of a length that follows from the size of the corpus: some tens for each bucket."""
    total = keys.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("size")).first()
    most_bytes, most_rows = float(np.clip(total["size"] / SHARE, *BUCKET_BYTES)), float(np.clip(total["rows"] / SHARE, *BUCKET_ROWS))
    even = max(total["size"] / most_bytes, total["rows"] / most_rows, 1.0)
    depth = min(int(np.ceil(np.log2(even))) + EXTRA_BITS, 30)
    prefix = F.shiftrightunsigned("hash", 64 - depth).cast("long")
    counts = keys.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("size")).toPandas()
    rows, size = np.zeros(1 << depth), np.zeros(1 << depth)
    rows[counts["prefix"]], size[counts["prefix"]] = counts["rows"], counts["size"]
    return split_buckets(depth, rows, size, most_rows, most_bytes)


def _route(shared):
    """Rows to their owners; rows of a batch with the same text travel as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory: Directory = shared.value
        for batch in batches:
            held: dict[bytes, list] = {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(normalised(text or b""), []).append(doc)
            rows = []
            for text, docs in held.items():
                key = _digest(text)
                b = int(directory.bucket[directory.slot(key)])
                page = _digest(str(docs[0]).encode()) % int(directory.pages[b])
                rows.append((int(directory.owner[b]) + page, b, page, _signed(key), text, docs))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUTED.types, strict=True)], schema=_ROUTED)

    return run


def _least(doc_ids: list) -> int:
    """Where the smallest id stands; null comes last."""
    return min(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))


class _Output:
    def __init__(self):
        self.rows, self.weight = [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.weight += 100 + len(row[-1] or b"")

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _INDEXED, strict=True)]
        self.rows, self.weight = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=_INDEXED)


def _chains(shared):
    """The index rows of one owner: its stream is sorted by key, so a key's chain is walked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = shared.value.pages
        out = _Output()
        key, chain = None, []  # of the key at hand: [text, doc_ids] of each distinct text

        def settle() -> None:
            bucket, page, digest = key
            for place, (text, docs) in enumerate(chain):
                first = _least(docs)
                sha = hashlib.sha256(text).digest()
                # Only the pages of a chained bucket have to meet again with their texts.
                later = text if pages[bucket] > 1 else None
                for at, doc in enumerate(docs):
                    stays = at == first
                    out.add((bucket, page, digest, place, doc, stays, docs[first], len(docs), sha, len(text), later if stays else None))

        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in ("bucket", "page", "hash")), strict=True)
            texts, ids = batch.column("text"), batch.column("doc_ids")
            for at, name in enumerate(names):
                if name != key:
                    if key is not None:
                        settle()
                    key, chain = name, []
                text, docs = texts[at].as_py(), ids[at].as_py()
                for place in chain:
                    if place[0] == text:
                        place[1].extend(docs)
                        break
                else:
                    chain.append([text, docs])
                if out.weight > 4 << 20:
                    yield out.batch()
        if key is not None:
            settle()
        if out.rows:
            yield out.batch()

    return run


def _chain_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts of all pages of chained buckets, sorted by key: keep_id, group_size and which page has the row that stays."""
    name, chain = None, []  # of the key at hand: [text, [(page, chain, keep_id, group_size)]] of each distinct text
    rows: list[tuple] = []

    def settle() -> None:
        for _, members in chain:
            first = _least([m[2] for m in members])
            total = sum(m[3] for m in members)
            rows.extend((*name, page, place, at == first, members[first][2], total) for at, (page, place, _, _) in enumerate(members))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "hash", "page", "chain", "keep_id", "group_size", "text")]
        for bucket, digest, page, place, keep, size, text in zip(*columns, strict=True):
            if name != (bucket, digest):
                settle()
                name, chain = (bucket, digest), []
            for known in chain:
                if known[0] == text:
                    known[1].append((page, place, keep, size))
                    break
            else:
                chain.append([text, [(page, place, keep, size)]])
    settle()
    if rows:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        names = ["bucket", "hash", "page", "chain", "wins", "all_keep", "all_size"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def build_index(docs: DataFrame) -> DataFrame:
    """The written index: a row per document with key (`hash`), bucket, page, chain (place among the texts of the key), doc_id, keep_id,
    group_size, kept, sha256 and n_bytes of the normalised text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    directory = _directory(stored(texts.select("text").mapInArrow(_sizes, "hash long, n_bytes long"), "keys"))
    shared = spark.sparkContext.broadcast(directory)
    routed = texts.mapInArrow(_route(shared), from_arrow_schema(_ROUTED)).repartitionById(max(directory.n_owners, 1), F.col("owner"))
    sorted_rows = routed.sortWithinPartitions("bucket", "page", "hash").drop("owner")
    found = stored(sorted_rows.mapInArrow(_chains(shared), from_arrow_schema(_INDEXED)), "buckets")
    chained = np.flatnonzero(directory.pages > 1)
    columns = ["hash", "bucket", "page", "chain", "doc_id", "keep_id", "group_size", "kept", "sha256", "n_bytes"]
    if not len(chained):
        return found.withColumn("kept", F.col("first")).select(columns)
    met = found.filter("text is not null").select("bucket", "hash", "page", "chain", "keep_id", "group_size", "text")
    walk = met.repartition("bucket", "hash").sortWithinPartitions("bucket", "hash")
    settled = walk.mapInArrow(_chain_pages, "bucket int, hash long, page int, chain int, wins boolean, all_keep long, all_size long")
    joined = found.drop("text").join(settled, ["bucket", "hash", "page", "chain"], "left")
    return joined.select(
        "hash", "bucket", "page", "chain", "doc_id",
        F.when(F.col("wins").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("first") & F.coalesce("wins", F.lit(True))).alias("kept"),
        "sha256", "n_bytes",
    )


def write_index(docs: DataFrame, path: str | None = None) -> str:
    """Write the index of the documents to shared files, one folder per range of buckets, and return its path."""
    path = path or fresh_dir(docs.sparkSession, "exact_index")
    build_index(docs).write.parquet(path)
    return path


def find_copies(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and keep_id (null: none) of documents whose normalised text the written index holds: key, length and digest are equal."""
    keep = docs.sparkSession.read.parquet(path).filter("kept").select("hash", "n_bytes", "sha256", "keep_id")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t or b"") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([_signed(_digest(t)) for t in texts], pa.int64()),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                ],
                ["doc_id", "hash", "n_bytes", "sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(keyed, "doc_id long, hash long, n_bytes long, sha256 binary").join(keep, ["hash", "n_bytes", "sha256"], "left").select("doc_id", "keep_id")


def equal_texts(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (lowercase hex) of every document."""
    return build_index(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"), "bucket", "chain")
