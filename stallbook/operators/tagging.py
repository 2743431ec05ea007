"""Dictionary tagging of products, persons, places, payment methods and lengths; number tagging of prices."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallbook.functions.text import NUMBER_WORDS, cut_pieces, pieces_of, spread, tokens_of
from stallbook.operators.messages import non_blank
from stallbook.operators.token_trie import Matches, longest_first, token_ends, with_matches
from stallbook.schemas import MONEY, PATTERN_LABELS

#: Matches that leave a task at once.
OUT_ROWS = 1 << 18


def _span_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of every span, cut from a decoded text: a character of UTF-8 is found only by reading all before it."""
    for batch in batches:
        labels, parts = [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            whole = text.as_py()
            for span in spans:
                labels.append(span["label"])
                parts.append(whole[span["start"] : span["end"]])
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(parts, pa.string())], ["label", "part"])


def build_patterns(docs: DataFrame, labels: tuple[str, ...] = PATTERN_LABELS) -> DataFrame:
    """Distinct lower-cased token sequences of the annotated spans: label, tokens."""
    wanted = F.filter("spans", lambda s: s["label"].isin(*labels) & (s["start"] >= 0) & (s["end"] > s["start"]))
    rows = spread(docs.select("text", wanted.alias("spans"))).filter(F.col("text").isNotNull() & (F.size("spans") > 0))
    parts = rows.mapInArrow(_span_texts, "label string, part string").distinct()
    return parts.select("label", tokens_of(F.lower("part")).alias("tokens")).distinct().filter(F.size("tokens") > 0)


def pattern_rows(patterns: DataFrame) -> DataFrame:
    """A phrase as token rules: the first two tokens must match, each later one may be missing."""
    phrase = F.array_join("tokens", " ")
    return patterns.select("label", phrase.alias("phrase"), F.posexplode("tokens").alias("idx", "lower")).withColumn(
        "op", F.when(F.col("idx") >= 2, "?")
    )


def _words(docs: DataFrame, key: list[str]) -> DataFrame:
    return spread(docs.select(*key, "text")).select(*key, lowered(F.col("text")).alias("words"))


def lowered(text: Column) -> Column:
    return F.transform(tokens_of(text), lambda t: F.lower(t))


def _flat_matches(rows: DataFrame, patterns: DataFrame, optional: bool, key: list[str], name: str, value: Callable[[Matches], np.ndarray]) -> DataFrame:
    """Matches as rows: key, first (token number), a number under `name`, label."""

    def run(batch: pa.RecordBatch, found: Matches) -> Iterator[pa.RecordBatch]:
        begin, _ = token_ends(batch.column("words"))
        owner = np.searchsorted(begin, found.first, "right") - 1
        first = found.first - begin[owner]
        for at in range(0, len(owner), OUT_ROWS):
            here = slice(at, at + OUT_ROWS)
            part = Matches(first[here], found.n[here], found.label[here], found.labels)
            keys = [batch.column(k).take(pa.array(owner[here])) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(part.first, pa.int32()), pa.array(value(part), pa.int32()), part.names()], [*key, "first", name, "label"])

    schema = T.StructType([rows.schema[k] for k in key]).add("first", T.IntegerType()).add(name, T.IntegerType()).add("label", T.StringType())
    return with_matches(rows, patterns, optional, run, schema)


def dictionary_match(docs: DataFrame, patterns: DataFrame, key: list[str]) -> DataFrame:
    """All places where a whole phrase occurs: key, first, last (token numbers), label."""
    return _flat_matches(_words(docs, key), patterns, False, key, "last", lambda found: found.first + found.n - 1)


def pattern_matches(docs: DataFrame, patterns: DataFrame, key: list[str]) -> DataFrame:
    """All places where a phrase with optional later tokens occurs: key, first, n (tokens), label.

    The first two tokens of a phrase must match; each later one either is the next text token or is missing.
    """
    return _flat_matches(_words(docs, key), patterns, True, key, "n", lambda found: found.n)


_DIGITS = r"[.,]*\p{Nd}[\p{Nd}.,]*"


def entities_of(batch: pa.RecordBatch, found: Matches) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Matches without overlap and number-like tokens outside them, in order: first and last token (numbers in the batch), label."""
    number = rf"^[+\-±~]?{_DIGITS}(/{_DIGITS})?$"
    words = batch.column("words").flatten()
    # Of matches of one place and length only the least label can stay, whatever else overlaps them; matches are sorted.
    new = np.ones(len(found.first), bool)
    new[1:] = (np.diff(found.first) != 0) | (np.diff(found.n) != 0)
    first, n, label = found.first[new], found.n[new], found.label[new]
    taken = longest_first(first, n, label)
    kept = Matches(first[taken], n[taken], label[taken], found.labels)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, kept.first, 1)
    np.add.at(covered, kept.first + kept.n, -1)
    numeric = pc.or_(pc.match_substring_regex(words, number), pc.is_in(words, value_set=pa.array(list(NUMBER_WORDS)))).to_numpy(zero_copy_only=False)
    free = np.flatnonzero(numeric & (np.cumsum(covered[:-1]) == 0))
    firsts, lasts = np.concatenate([kept.first, free]), np.concatenate([kept.first + kept.n - 1, free])
    names = pa.concat_arrays([kept.names(), pa.array([MONEY] * len(free), pa.string())])
    by_place = np.argsort(firsts, kind="stable")
    return firsts[by_place], lasts[by_place], names.take(pa.array(by_place))


def tag_entities(docs: DataFrame, patterns: DataFrame, key: list[str]) -> DataFrame:
    """Dictionary entities without overlap, then number-like tokens outside them as prices.

    Columns: key, label, text, first, last (tokens), start, end (characters). Of matches that share a token the longest stays, then
    the earliest. A text is cut, matched and tagged inside its row; nothing is shuffled.
    """
    rows = spread(docs.select(*key, "text").filter(F.col("text").isNotNull()))
    rows = rows.select(*key, "text", pieces_of(F.col("text")).alias("pieces"), lowered(F.col("text")).alias("words"))

    def run(batch: pa.RecordBatch, found: Matches) -> Iterator[pa.RecordBatch]:
        tokens = cut_pieces(batch.column("pieces"))
        begin, _ = token_ends(batch.column("words"))
        firsts, lasts, names = entities_of(batch, found)
        home = np.searchsorted(begin, firsts, "right") - 1
        starts, ends = tokens.start[firsts], tokens.end[lasts]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(home, minlength=batch.num_rows))])
        parts = []
        for row in np.flatnonzero(np.diff(offsets)).tolist():
            text, (a, b) = batch.column("text")[row].as_py(), offsets[row : row + 2]
            parts.extend(text[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
        numbers = (firsts - begin[home], lasts - begin[home], starts, ends)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(pa.array(home)) for k in key), names, pa.array(parts, pa.string()), *(pa.array(x, pa.int32()) for x in numbers)],
            [*key, "label", "text", "first", "last", "start", "end"],
        )

    out = T.StructType([rows.schema[k] for k in key]).add("label", T.StringType()).add("text", T.StringType())
    for name in ("first", "last", "start", "end"):
        out = out.add(name, T.IntegerType())
    return with_matches(rows, patterns, True, run, out)


Annotator = Callable[[str], list[tuple[int, int, str]]]


def annotate(messages: DataFrame, make_annotator: Callable[[], Annotator], key: list[str]) -> DataFrame:
    """Span rows from a caller's tagger, created once per partition: key, pos, label, text, start, end.

    Null and blank messages have no spans and do not reach the tagger.
    """
    key_fields = ", ".join(f"{k} {messages.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = make_annotator()
        for batch in batches:
            rows = []
            for *ids, text in batch[[*key, "text"]].itertuples(index=False, name=None):
                for pos, (start, end, label) in enumerate(tag(text)):
                    rows.append((*ids, pos, label, text[start:end], start, end))
            yield pd.DataFrame(rows, columns=[*key, "pos", "label", "text", "start", "end"])

    schema = f"{key_fields}, pos int, label string, text string, start int, end int"
    return non_blank(messages).select(*key, "text").mapInPandas(run, schema)


def number_annotator() -> Annotator:
    """A small annotator of number words and digits, as a template for callers."""
    import re

    number = re.compile(r"\d+(?:[.,/]\d+)*|\b(?:" + "|".join(NUMBER_WORDS) + r")\b")
    return lambda text: [(m.start(), m.end(), MONEY) for m in number.finditer(text)]
