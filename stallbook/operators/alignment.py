"""Spans, tags and relations of a text as token numbers, found inside the row of the text.

The tokens of a text are a sorted array of ends, and every span edge is a binary search in it; the texts of a batch are searched together.
No token row meets a span row, and nothing is shuffled.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallbook.functions.text import Tokens, cut_pieces, pieces_of, spread, token_slices

# Positions of different rows of a batch lie this far apart on one line.
_ROW = 1 << 32


def span_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Row and place in its row of every element of a list column, and the elements."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts), column.flatten()


class Ranges:
    """Tokens of a batch, and the token ranges of spans in it."""

    def __init__(self, batch: pa.RecordBatch):
        self.texts = batch.column("text").to_pylist()
        self.tokens: Tokens = cut_pieces(batch.column("pieces"))
        self.begin = np.searchsorted(self.tokens.row, np.arange(batch.num_rows + 1))
        self._starts = self.tokens.row * _ROW + self.tokens.start
        self._ends = self.tokens.row * _ROW + self.tokens.end

    def _token_at(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Token that covers a position, -1 for none; one on the boundary of two tokens belongs to the earlier."""
        found = np.searchsorted(self._ends, row * _ROW + np.maximum(at, 0))
        inside = found < self.begin[row + 1]
        known = np.where(inside, found, 0)
        covers = inside & (self.tokens.start[known] <= at) if len(self._ends) else inside
        return np.where(covers, found - self.begin[row], -1)

    def ranged(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last token of spans, -1 for none. Blanks at the edges are trimmed; an end beyond all tokens belongs to the last."""
        left, right = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for i, (r, a, b) in enumerate(zip(row.tolist(), start.tolist(), end.tolist(), strict=True)):
            part = (self.texts[r] or "")[a:b]
            left[i] = len(part) - len(part.lstrip(" "))
            right[i] = len(part) - len(part.rstrip(" ")) if part.strip(" ") else 0
        first, last = self._token_at(row, start + left), self._token_at(row, end - right)
        final = self.begin[row + 1] - self.begin[row] - 1
        return first, np.where(last < 0, final, last)

    def inside(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last token fully inside spans; none is if first > last."""
        first = np.searchsorted(self._starts, row * _ROW + np.maximum(start, 0)) - self.begin[row]
        last = np.searchsorted(self._ends, row * _ROW + np.maximum(end, 0), "right") - 1 - self.begin[row]
        return first, last


def _numbers(values: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=None if known is None else ~known)


def span_field(spans: pa.StructArray, name: str) -> np.ndarray:
    return spans.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _mapped(docs: DataFrame, key: list[str], lists: list[str], run: Callable, fields: str) -> DataFrame:
    """Rows that `run` (batch, ranges) makes of the texts: key, then the columns of `fields`."""
    rows = spread(docs.select(*key, "text", *lists)).withColumn("pieces", F.coalesce(pieces_of(F.col("text")), F.array().cast("array<string>")))
    schema = T.StructType([docs.schema[k] for k in key] + T.StructType.fromDDL(fields).fields)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in token_slices(batches):
            owner, columns = run(batch, Ranges(batch))
            keys = [batch.column(k).take(pa.array(owner)) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, *columns.values()], [*key, *columns])

    return rows.mapInArrow(stage, schema)


def usable(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first >= 0) & (last >= 0) & (first <= last)


def span_tokens(docs: DataFrame, key: list[str]) -> DataFrame:
    """Spans with the tokens they start and end in: key, pos, start, end, label, first, last, ok.

    Blanks at the edges are trimmed. A position on the boundary of two tokens belongs to the earlier one, and an end beyond all tokens to
    the last one. Spans without a token range have ok = false.
    """

    def run(batch: pa.RecordBatch, ranges: Ranges):
        row, pos, spans = span_lists(batch.column("spans"))
        start, end = span_field(spans, "start"), span_field(spans, "end")
        first, last = ranges.ranged(row, start, end)
        return row, {
            "pos": _numbers(pos), "start": _numbers(start), "end": _numbers(end), "label": spans.field("label"),
            "first": _numbers(first, first >= 0), "last": _numbers(last, last >= 0), "ok": pa.array(usable(first, last)),
        }

    return _mapped(docs, key, ["spans"], run, "pos int, start int, end int, label string, first int, last int, ok boolean")


def contracted(ranges: Ranges, row: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of spans shrunk to the tokens fully inside them; none is if first > last."""
    first, last = ranges.inside(row, start, end)
    missed = np.flatnonzero(first > last)
    moved = np.full(len(missed), -1)
    for i, (r, a, b) in enumerate(zip(row[missed].tolist(), start[missed].tolist(), end[missed].tolist(), strict=True)):
        text, at = ranges.texts[r] or "", max(0, a - reach)
        found = text[at : max(at, b + reach)].lower().find(text[max(0, a) : max(0, b)].lower())
        moved[i] = at + found if found >= 0 else -1
    seen = missed[moved >= 0]
    new = moved[moved >= 0]
    first[seen], last[seen] = ranges.inside(row[seen], new, new + end[seen] - start[seen])
    return first, last


def contract_spans(docs: DataFrame, key: list[str], reach: int = 25) -> DataFrame:
    """Spans shrunk to the tokens fully inside them, as `corpus.contract_to_tokens` with the library's own tokens: key, pos, label, first, last, aligned.

    A span without such a token is looked for again, lower-cased, up to `reach` characters around its place.
    """

    def run(batch: pa.RecordBatch, ranges: Ranges):
        row, pos, spans = span_lists(batch.column("spans"))
        first, last = contracted(ranges, row, span_field(spans, "start"), span_field(spans, "end"), reach)
        aligned = first <= last
        return row, {
            "pos": _numbers(pos), "label": spans.field("label"), "first": _numbers(first, aligned), "last": _numbers(last, aligned), "aligned": pa.array(aligned),
        }

    return _mapped(docs, key, ["spans"], run, "pos int, label string, first int, last int, aligned boolean")


def bio_tags(docs: DataFrame, key: list[str]) -> DataFrame:
    """Tokens with B-/I- tags of the spans: key, idx, token, start, end, tag; later spans overwrite, the rest is O."""

    def run(batch: pa.RecordBatch, ranges: Ranges):
        row, _, spans = span_lists(batch.column("spans"))
        first, last = ranges.ranged(row, span_field(spans, "start"), span_field(spans, "end"))
        used = np.flatnonzero(usable(first, last))
        coded = spans.field("label").dictionary_encode()
        labels, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        size = last[used] - first[used] + 1
        owner = np.repeat(np.arange(len(used)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        tag = np.zeros(len(ranges.tokens.row), np.int64)
        # Spans stand in their order, so the last one that covers a token is what stays.
        tag[(ranges.begin[row[used]] + first[used])[owner] + inside] = 1 + 2 * code[used][owner] + (inside > 0)
        names = pa.array(["O", *(f"{x}-{label}" for label in labels for x in "BI")])
        tokens = ranges.tokens
        return tokens.row, {
            "idx": _numbers(tokens.idx), "token": tokens.token, "start": _numbers(tokens.start), "end": _numbers(tokens.end), "tag": names.take(pa.array(tag)),
        }

    return _mapped(docs.filter("text IS NOT NULL"), key, ["spans"], run, "idx int, token string, start int, end int, tag string")


def resolve_relations(docs: DataFrame, key: list[str]) -> DataFrame:
    """Relations with the spans their end points fall on; null where no span has the first or last token.

    Columns: key, rel_pos, label, head_pos, tail_pos. Of several spans on a token the one that starts first counts, then the earlier one.
    Rows with a null side are the dropped relations.
    """

    def run(batch: pa.RecordBatch, ranges: Ranges):
        row, pos, spans = span_lists(batch.column("spans"))
        first, last = ranges.ranged(row, span_field(spans, "start"), span_field(spans, "end"))
        used = np.flatnonzero(usable(first, last))
        used = used[np.lexsort((pos[used], first[used]))[::-1]]  # best last, so that it stays
        size = last[used] - first[used] + 1
        owner = np.repeat(np.arange(len(used)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        span_at = np.full(len(ranges.tokens.row), -1)
        span_at[(ranges.begin[row[used]] + first[used])[owner] + inside] = used[owner]
        r_row, r_pos, relations = span_lists(batch.column("relations"))

        def side(number: int) -> pa.Array:
            a, b = ranges.ranged(r_row, span_field(relations, f"start{number}"), span_field(relations, f"end{number}"))
            ok = usable(a, b)
            best, rank = np.full(len(r_row), -1), np.full(len(r_row), np.iinfo(np.int64).max)
            for edge in (a, b):
                at = np.flatnonzero(ok)
                span = np.full(len(r_row), -1)
                span[at] = span_at[ranges.begin[r_row[at]] + edge[at]]
                order = np.where(span >= 0, first[span] * _ROW + pos[span], np.iinfo(np.int64).max) if len(first) else rank
                best, rank = np.where(order < rank, span, best), np.minimum(order, rank)
            shown = pos[best] if len(pos) else best
            return _numbers(shown, best >= 0)

        return r_row, {"rel_pos": _numbers(r_pos), "label": relations.field("label"), "head_pos": side(1), "tail_pos": side(2)}

    return _mapped(docs, key, ["spans", "relations"], run, "rel_pos int, label string, head_pos int, tail_pos int")
