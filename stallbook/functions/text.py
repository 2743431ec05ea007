"""Column functions over free text. All of them stay inside the JVM."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# German number words and what they stand for.
NUMBER_WORDS = {
    "ein": 1,
    "eins": 1,
    "zwei": 2,
    "drei": 3,
    "vier": 4,
    "fünf": 5,
    "funf": 5,
    "sechs": 6,
    "sieben": 7,
    "acht": 8,
    "neun": 9,
    "zehn": 10,
    "elf": 11,
    "zwölf": 12,
    "zwolf": 12,
}

# Fixed values: "<number> <unit>" in a subscription length; the unit may be missing.
LENGTH_PATTERN = r"(\d+|ein|eins|zwei|drei|vier|f[uü]nf|sechs|sieben|acht|neun|zehn|elf|zw[oö]lf)(?:\s+)?(jahr|monat|)[e]?"

# Code points that count as printable. Letters, digits, white space, ASCII, symbols and
# the single code point emoji blocks; joiners and variation selectors are outside.
WHITESPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
PRINTABLE = (
    r"\p{L}\p{N}_" + WHITESPACE + r"!-~"
    r"\x{1F130}-\x{1F1FF}\x{FFFC}\x{A1}-\x{D7}\x{2013}-\x{300B}\x{0F3B}\x{FF0A}\x{02E9}"
    r"\x{1F004}\x{1F0CF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F7E0}-\x{1F7F0}"
    r"\x{1F90C}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{303D}\x{3297}\x{3299}"
)

# A token is a number with inner separators, a word, or one other visible character.
TOKEN_PATTERN = r"\p{N}+(?:[.,/]\p{N}+)*|[\p{L}\p{M}\p{N}_]+|[^" + WHITESPACE + "]"
TOKEN_WITH_GAP_PATTERN = "[" + WHITESPACE + "]*(?:" + TOKEN_PATTERN + ")"

_SPACE = "[" + WHITESPACE + "]"
_NON_WORD = r"[^\p{L}\p{N}_]"


def is_not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike("[^" + WHITESPACE + "]"), F.lit(False))


def strip(text: Column) -> Column:
    """Remove surrounding Unicode white space; `trim` only knows the plain blank."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def is_float(text: Column) -> Column:
    """Whether the text is a decimal number; a cast alone would also take the suffixes of Java literals."""
    return text.try_cast("double").isNotNull() & text.rlike(r"(?i)^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf|infinity)\s*$")


def normalize_price(text: Column) -> Column:
    """First reading of a price text as a number, -1 when there is none."""
    digits = F.regexp_replace(text, "[^0-9 .,]", "")
    dotted = F.regexp_replace(digits, ",", ".")
    return F.coalesce(F.regexp_replace(dotted, r"\.$", "").try_cast("double"), F.lit(-1.0))


def normalize_product_name(text: Column) -> Column:
    single = F.replace(F.lower(text), F.lit("  "), F.lit(" "))
    return F.trim(F.regexp_replace(single, "[^A-Za-z ]", ""))


def normalize_product_key(text: Column) -> Column:
    """Word characters only, one blank between words, lower case."""
    words = F.regexp_replace(F.regexp_replace(text, _NON_WORD, " "), " +", " ")
    return F.lower(F.trim(words))


def clean_cluster_name(text: Column) -> Column:
    return F.regexp_replace(text, _NON_WORD, "")


def number_word(text: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, text).cast("long"), text.try_cast("long"), F.lit(1).cast("long"))


def subscription_length(text: Column) -> Column:
    """struct(kind, months): kind is `months`, `lifetime` or null when nothing was recognised."""
    low = F.lower(text)
    found = low.rlike(LENGTH_PATTERN)
    unit = F.regexp_extract(low, LENGTH_PATTERN, 2)
    counted = number_word(F.regexp_extract(low, LENGTH_PATTERN, 1)) * F.when(unit.contains("ja"), 12).otherwise(1)
    months = (
        F.when(found, counted)
        .when(low.contains("jah"), F.lit(12).cast("long"))
        .when(low.contains("mon"), F.lit(1).cast("long"))
    )
    kind = F.when(months.isNotNull(), F.lit("months")).when(low.contains("lif"), F.lit("lifetime"))
    return F.struct(kind.alias("kind"), months.alias("months"))


def replace_nonprint(text: Column) -> Column:
    """Text with one blank per character outside the printable class."""
    return F.regexp_replace(text, f"[^{PRINTABLE}]", " ")


def nonprint_chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{PRINTABLE}]"), F.lit(0))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def lower_corpus_line(text: Column) -> Column:
    """Lower-cased tokens of a document joined by one blank."""
    return F.array_join(tokens_of(F.lower(text)), " ")


def is_number_like(token: Column) -> Column:
    digits = r"[.,]*\p{Nd}[\p{Nd}.,]*"
    return token.rlike(rf"^[+\-±~]?{digits}(/{digits})?$") | F.lower(token).isin(list(NUMBER_WORDS))


#: Bytes of texts and their tokens that cross between Spark and Python at once; one longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(size: str) -> int:
    """A plain number of bytes; a size with a unit counts as unbounded."""
    digits = size.removesuffix("b")
    return int(digits) if digits.isdigit() else 0


def spread(docs: DataFrame) -> DataFrame:
    """Texts of an input with fewer partitions than cores are dealt out before each becomes many rows; others stay in place.

    The session's batches are bounded in bytes, since a number of rows says nothing about the memory that texts take; a smaller bound stays.
    """
    conf = docs.sparkSession.conf
    if not 0 < _bytes(conf.get(_BATCH)) <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


class Tokens(NamedTuple):
    """All tokens of a batch, one after the other: the row of each, its number there, its text, and its place in the row's text."""

    row: np.ndarray
    idx: np.ndarray
    token: pa.Array
    start: np.ndarray
    end: np.ndarray


# The characters of WHITESPACE, for functions that take a list of them.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def pieces_of(text: Column) -> Column:
    """Tokens, each with the white space before it, so that they tile the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN_WITH_GAP_PATTERN), F.lit(0))


def cut_pieces(pieces: pa.Array) -> Tokens:
    """Tokens of a column of `pieces_of`: a running sum of the pieces' lengths is the token end."""
    counts = pc.list_value_length(pieces).to_numpy()
    flat = pieces.flatten()
    upto = np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    end = upto - np.concatenate([[0], upto])[first[row]]
    token = pc.utf8_ltrim(flat, characters=_SPACES)
    return Tokens(row, np.arange(len(row)) - first[row], token, end - pc.utf8_length(token).to_numpy(zero_copy_only=False), end)


#: Tokens that are worked on at once; one longer text is a slice of its own.
SLICE_TOKENS = 1 << 18


def token_slices(batches: Iterator[pa.RecordBatch], column: str = "pieces") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most SLICE_TOKENS elements in a list column each; whole rows only."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, done + SLICE_TOKENS, side="right")))
            yield batch.slice(at, end - at)
            at, done = end, int(upto[end - 1])


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a list of pieces as one row per token: the other columns, idx, token, start, end."""
    for batch in token_slices(batches):
        tokens = cut_pieces(batch.column("pieces"))
        rest = [batch.column(c).take(pa.array(tokens.row)) for c in batch.schema.names[:-1]]
        number = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*rest, number(tokens.idx), tokens.token, number(tokens.start), number(tokens.end)], [*batch.schema.names[:-1], "idx", "token", "start", "end"]
        )


def tokenize(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per token: key, idx (from 0), token, start, end (exclusive). All of it happens inside the row of the text, without a shuffle."""
    cut = spread(docs.select(*key, text)).filter(F.col(text).isNotNull()).select(*key, pieces_of(F.col(text)).alias("pieces"))
    out = T.StructType([f for f in cut.schema.fields if f.name != "pieces"]).add("idx", T.IntegerType()).add("token", T.StringType())
    return cut.mapInArrow(_tile, out.add("start", T.IntegerType()).add("end", T.IntegerType()))
