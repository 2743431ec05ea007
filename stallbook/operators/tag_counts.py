"""Counts of right, wrong and missed token ranges of the dictionary tagger, made where a text is matched.

The matches of a text meet its own gold spans inside its row, so no match leaves the task; only texts that share a key with another one,
which count as one text, send theirs through a shuffle.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallbook.functions.text import pieces_of, spread
from stallbook.operators import evaluation
from stallbook.operators.alignment import Ranges, contract_spans, contracted, span_field, span_lists, span_tokens, usable
from stallbook.operators.tagging import dictionary_match, entities_of, lowered, tag_entities
from stallbook.operators.token_trie import Matches, with_matches
from stallbook.scratch import stored

_COUNTS = "label string, tp long, fp long, fn long, misaligned long, spans long"
_NAMES = [field.split()[0] for field in _COUNTS.split(", ")]


def _items(first: np.ndarray, last: np.ndarray, label: pa.Array, labels: pa.Array, size: int) -> np.ndarray:
    """Distinct (label, first, last) as sorted numbers; tokens are below `size`."""
    code = pc.index_in(label, value_set=labels).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique((code * size + first) * size + last)


def _counted(docs: DataFrame, patterns: DataFrame, key: list[str], contract: bool, entities: bool) -> DataFrame:
    """_COUNTS of the texts of each slice, every text for itself; a row with `spans` has the numbers of gold spans instead."""
    text = F.col("text")
    rows = spread(docs.select(*key, "text", "spans")).select(
        "text", "spans", F.coalesce(pieces_of(text), F.array().cast("array<string>")).alias("pieces"), lowered(text).alias("words")
    )

    def run(batch: pa.RecordBatch, found: Matches) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(batch)
        if entities:
            first, last, label = entities_of(batch, found)
        else:
            first, last, label = found.first, found.first + found.n - 1, found.names()
        row, _, spans = span_lists(batch.column("spans"))
        edges = (span_field(spans, "start"), span_field(spans, "end"))
        g_first, g_last = contracted(ranges, row, *edges) if contract else ranges.ranged(row, *edges)
        ok = g_first <= g_last if contract else usable(g_first, g_last)
        used = np.flatnonzero(ok)
        g_label = spans.field("label").take(pa.array(used)).cast(pa.string())
        labels = pc.unique(pa.concat_arrays([label.cast(pa.string()), g_label]))
        size = len(ranges.tokens.row) + 1
        base = ranges.begin[row[used]]
        predicted = _items(first, last, label, labels, size)
        gold = _items(base + g_first[used], base + g_last[used], g_label, labels, size)
        right = np.intersect1d(predicted, gold, assume_unique=True)
        p, g, tp = (np.bincount(x // (size * size), minlength=len(labels)) for x in (predicted, gold, right))
        columns = [labels, *(pa.array(x.astype(np.int64)) for x in (tp, p - tp, g - tp)), *(pa.nulls(len(labels), pa.int64()) for _ in range(2))]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)
        numbers = [None, None, None, len(row) - len(used), len(row)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *(pa.array([x], pa.int64()) for x in numbers)], _NAMES)

    return with_matches(rows, patterns, entities, run, T.StructType.fromDDL(_COUNTS))


def tag_counts(docs: DataFrame, patterns: DataFrame, key: list[str], contract: bool, entities: bool) -> tuple[DataFrame, DataFrame]:
    """Per label tp, fp, fn of the dictionary matches of (key, text, spans), or of the `entities` without overlap; and the share of gold
    spans without tokens, as one row. Gold spans are as `span_tokens` or, contracted, as `contract_spans` has them.

    The same range of texts with the same key is one item, as in `evaluation.label_counts`.
    """
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"a.{k}")) for k in key]
    again = stored(docs.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "repeated_keys")
    once, shared = docs, None
    if not again.isEmpty():
        once = docs.alias("d").join(again.alias("a"), same, "left_anti")
        shared = stored(docs.alias("d").join(again.alias("a"), same, "left_semi").select(*key, "text", "spans"), "repeated_texts")
    counted = stored(_counted(once, patterns, key, contract, entities), "tag_counts")
    counts = counted.filter("spans IS NULL").select("label", "tp", "fp", "fn")
    spans = counted.filter("spans IS NOT NULL").select("misaligned", "spans")
    if shared is not None:
        found = tag_entities(shared, patterns, key) if entities else dictionary_match(shared, patterns, key)
        every = (contract_spans(shared, key) if contract else span_tokens(shared, key)).withColumn("fits", F.col("aligned" if contract else "ok"))
        every = stored(every, "gold")
        more = stored(evaluation.label_counts(found, every.filter("fits"), [*key, "first", "last"]), "shared_counts")
        counts = counts.unionByName(more)
        spans = spans.unionByName(every.agg(F.count_if(~F.col("fits")).alias("misaligned"), F.count("*").alias("spans")))
    counts = counts.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return counts, spans.agg(F.try_divide(F.sum("misaligned"), F.sum("spans")).alias("misaligned"))
