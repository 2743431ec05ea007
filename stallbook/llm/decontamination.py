"""Benchmark passages in documents, found with a distributed positional inverted index.

`build_index` splits whole documents into shards (about `tokens.CHUNK_BYTES` of text, one longer document alone) and stores for every
term of a shard its word positions. `matches` takes the windows of the benchmark items in blocks of bounded size, reads
the postings of their terms, and intersects offset-adjusted position lists in each shard from the rarest term on. A
match is an exact phrase, or with `slop` all words of a window within that many extra words, in any order.

Defined cases: null or empty texts have no words and are never hit. Items with null id or without words are left out;
rows that repeat an item_id are one item. Documents are answered row by row, so repeated rows and null doc_ids are fine.
An empty benchmark hits nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.tokens import chunks, split_words
from stallbook.scratch import stored

_INDEX = "shard long, term binary, positions binary, doc_ids array<long>, doc_rows array<long>, doc_words array<int>"
_SPANS = "array<struct<start:int,end:int>>"
_FOUND = f"shard long, place int, doc_id long, row long, n_words int, spans {_SPANS}, items array<string>"
#: Windows that are compared in one pass over the index; this also bounds what is broadcast.
BLOCK_WINDOWS = 50_000


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"))
            counts = np.diff(words.starts)
            # Positions run through the shard and leave one out between documents, so that no phrase crosses them.
            positions = (np.arange(len(words.codes)) + np.repeat(np.arange(part.num_rows), counts)).astype(np.int32)
            order = np.argsort(words.codes, kind="stable")
            ends = np.cumsum(np.bincount(words.codes, minlength=len(words.terms)))
            gaps = np.diff(positions[order], prepend=0).astype(np.int32)
            first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
            gaps[first] = positions[order][first]
            packed = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64) * 4), pa.py_buffer(gaps)])
            n = len(ends) + 1
            one = lambda values, kind: pa.array([None] * (n - 1) + [values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard)),
                    pa.concat_arrays([words.terms.cast(pa.binary()), pa.nulls(1, pa.binary())]),
                    pa.concat_arrays([packed.cast(pa.binary()), pa.nulls(1, pa.binary())]),
                    one(part.column("doc_id").to_pylist(), pa.int64()),
                    one(part.column("row").to_pylist(), pa.int64()),
                    one(counts.tolist(), pa.int32()),
                ],
                ["shard", "term", "positions", "doc_ids", "doc_rows", "doc_words"],
            )
            shard += 1


def build_index(docs: DataFrame) -> DataFrame:
    """Stored index: a row for each shard and term with its positions (gaps as int32), and one without term that lists the shard's documents."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return stored(rows.mapInArrow(_postings, _INDEX), "postings")


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column("text"))
                terms = words.terms.to_pylist()
                ids, grams = [], []
                for i, item in enumerate(part.column("item_id").to_pylist()):
                    own = [terms[c] for c in words.codes[words.starts[i] : words.starts[i + 1]]]
                    for at in range(max(1, len(own) - length + 1) if own else 0):
                        ids.append(item)
                        grams.append(own[at : at + length])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(grams, pa.list_(pa.binary()))], ["item", "words"])

    return run


def item_windows(items: DataFrame, length: int = 10) -> DataFrame:
    """Distinct item, words: `length` consecutive words, or all of a shorter item."""
    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_windows(length), "item string, words array<binary>").distinct()


class _Block:
    """Windows as rows of term numbers, -1 where a window is shorter."""

    def __init__(self, rows: list):
        by_words: dict[tuple, list[str]] = {}
        for row in rows:
            by_words.setdefault(tuple(bytes(w) for w in row.words), []).append(row.item)
        self.terms = {t: i for i, t in enumerate(sorted({w for g in by_words for w in g}))}
        width = max(map(len, by_words), default=0)
        self.windows = np.full((len(by_words), width), -1, np.int32)
        for i, g in enumerate(by_words):
            self.windows[i, : len(g)] = [self.terms[w] for w in g]
        self.items = list(by_words.values())


def _phrase(lists: list, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Starts of a phrase: offset-adjusted lists, the rarest term first."""
    order = np.argsort(sizes[terms], kind="stable")
    starts = lists[terms[order[0]]] - order[0]
    for at in order[1:]:
        target = lists[terms[at]]
        sought = starts + at
        near = np.minimum(np.searchsorted(target, sought), len(target) - 1)
        starts = starts[target[near] == sought]
        if not len(starts):
            break
    return starts


def _near(lists: list, terms: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest stretches of at most `span` words that hold all terms, searched around the rarest term."""
    terms = np.unique(terms)
    terms = terms[np.argsort(sizes[terms], kind="stable")]
    rarest = lists[terms[0]]
    starts = np.unique(np.concatenate([lists[t] for t in terms]))
    after = np.searchsorted(rarest, starts)
    starts = starts[(after < len(rarest)) & (rarest[np.minimum(after, len(rarest) - 1)] - starts < span)]
    ends = starts + 1
    for t in terms:
        at = np.searchsorted(lists[t], starts)
        found = at < len(lists[t])
        reach = np.where(found, lists[t][np.minimum(at, len(lists[t]) - 1)] + 1, starts + span + 1)
        ends = np.maximum(ends, reach)
    good = ends - starts <= span
    return starts[good], ends[good]


def _intersect(block, slop: int):
    def run(table: pa.Table) -> pa.Table:
        given: _Block = block.value
        lists: list = [np.zeros(0, np.int64)] * (len(given.terms) + 1)
        for term, packed in zip(table["term"].to_pylist(), table["positions"].to_pylist(), strict=True):
            if term is None:
                continue
            lists[given.terms[term]] = np.cumsum(np.frombuffer(packed, np.int32), dtype=np.int64)
        listed = table.filter(pc.is_null(table["term"]))
        counts = np.array(listed["doc_words"][0].as_py(), np.int64)
        n_docs = len(counts)
        begin = np.cumsum(counts) - counts + np.arange(n_docs)
        sizes = np.array([len(x) for x in lists], np.int64)
        sizes[-1] = 1  # of the filler
        edge = np.zeros(int(begin[-1] + counts[-1]) + 2, np.int64)
        found_docs, found_items = [], []
        for at in np.flatnonzero((sizes[given.windows] > 0).all(axis=1)):
            terms = given.windows[at]
            terms = terms[terms >= 0]
            if slop:
                starts, ends = _near(lists, terms, sizes, len(terms) + slop)
                inside = np.searchsorted(begin, starts, side="right") == np.searchsorted(begin, ends - 1, side="right")
                starts, ends = starts[inside], ends[inside]
            else:
                starts = _phrase(lists, terms, sizes)
                ends = starts + len(terms)
            if len(starts):
                np.add.at(edge, starts, 1)
                np.add.at(edge, ends, -1)
                docs = np.unique(np.searchsorted(begin, starts, side="right") - 1)
                for item in given.items[at]:
                    found_docs.append(docs)
                    found_items += [item] * len(docs)
        hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])
        turns = np.diff(hit)
        first, last = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        # A stretch can run over the place between two documents only if both sides are hit; the place itself never is.
        owner = np.searchsorted(begin, first, side="right") - 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(n_docs + 1)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array((first - begin[owner]).astype(np.int32)), pa.array((last - begin[owner]).astype(np.int32))], ["start", "end"]),
        )
        by_doc: dict[int, set[str]] = {}
        for doc, item in zip(np.concatenate(found_docs).tolist() if found_docs else [], found_items, strict=True):
            by_doc.setdefault(doc, set()).add(item)
        return pa.table(
            {
                "shard": pa.array([listed["shard"][0].as_py()] * n_docs, pa.int64()),
                "place": pa.array(np.arange(n_docs, dtype=np.int32)),
                "doc_id": listed["doc_ids"].combine_chunks().flatten(),
                "row": listed["doc_rows"].combine_chunks().flatten(),
                "n_words": pa.array(counts.astype(np.int32)),
                "spans": spans,
                "items": pa.array([sorted(by_doc.get(i, ())) for i in range(n_docs)], pa.list_(pa.string())),
            }
        )

    return run


def _union_spans(spans):
    """Sorted spans with overlaps and touching ones merged."""
    empty = F.array().cast(_SPANS)

    def add(done, span):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.coalesce(last["end"], F.lit(-1)) >= span["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(F.array_sort(spans), empty, add)


def matches(index: DataFrame, items: DataFrame, length: int = 10, slop: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row for each indexed document: shard, place, doc_id, row, n_words, spans (word positions hit, merged), items (ids found, sorted)."""
    spark = index.sparkSession
    windows = stored(item_windows(items, length), "windows")
    n_blocks = max(1, -(-windows.count() // block_windows))
    found = None
    for b in range(n_blocks):
        rows = windows.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == b).collect()
        block = spark.sparkContext.broadcast(_Block(rows))
        # The terms of one block: at most `length` for each of its windows.
        terms = spark.createDataFrame([(bytearray(t),) for t in block.value.terms], "term binary")
        needed = index.filter("term is null").unionByName(index.filter("term is not null").join(F.broadcast(terms), "term", "left_semi"))
        part = needed.groupBy("shard").applyInArrow(_intersect(block, slop), _FOUND)
        found = part if found is None else found.unionByName(part)
    if n_blocks == 1:
        return found
    merged = found.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("row").alias("row"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.withColumn("spans", _union_spans(F.col("spans")))


def n_hit():
    """Number of words inside the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """The documents without any hit, with all their columns."""
    bad = matches(build_index(docs), items, length).filter(F.size("spans") > 0).select(F.col("doc_id").alias("bad_doc"), F.col("row").alias("bad_row")).distinct()
    rows = docs.select(F.struct("*").alias("d"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row"))
    return rows.join(bad, F.col("d.doc_id").eqNullSafe(F.col("bad_doc")) & (F.col("row") == F.col("bad_row")), "left_anti").select("d.*")
