"""Words of whole texts as dictionary-coded arrays, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Text bytes that are worked on at once; one longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20

# A word is a run of 0-9, a-z and every character beyond ASCII; A-Z count as a-z. Other bytes map to 0.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _first, _last in ((b"0", b"9"), (b"a", b"z")):
    _FOLD[_first[0] : _last[0] + 1] = np.arange(_first[0], _last[0] + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

#: Rows of documents that cross between Spark and Python at once. Texts can be long, and every task holds such a batch on both sides.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size to BATCH_ROWS; a smaller one stays."""
    now = int(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@dataclass
class Words:
    """Words of some texts: `codes` point into `terms`; text i has the words `starts[i]` to `starts[i + 1]`."""

    codes: np.ndarray
    terms: pa.Array
    starts: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct term."""
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in self.terms.to_pylist()), np.uint64, len(self.terms))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and where each text starts in them, with the end as a last entry."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` text bytes each; whole rows only."""
    _, bounds = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def split_words(texts: pa.Array) -> Words:
    """All words of a binary column; null has none."""
    data, bounds = buffers(texts)
    low = _FOLD[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # texts lie side by side without a separator
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin = np.flatnonzero(first)
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - begin, out=offsets[1:])
    starts = np.searchsorted(begin, bounds)
    coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
    return Words(coded.indices.to_numpy(), coded.dictionary, starts)
