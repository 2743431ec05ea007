"""Groups of spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

1. Words are counted in one pass; a batch of documents is reduced to its distinct words before anything moves.
2. Every word is a point of letter counts. One edit moves it by a squared distance of at most 2: 1 for a letter more or less, 2 for
   another letter. The letters are dealt into classes, and a word's numbers of letters in each class name its cell. Its length is
   their sum, so the words one edit away lie in the same cell or in a few known ones of the same or the adjacent length.
3. Cells are cut into blocks of bounded size. For each block one NumPy product of letter counts with each batch of visiting words gives
   all squared distances; pairs at most 2 apart are verified code point by code point. Pairs never leave the task: each
   word gets its number of near words and the best of them, and these add up.
4. Words follow their forms to the last by pointer jumping over written rounds, as many as the logarithm of the longest chain.

The number of classes follows from the words themselves: as few as bring the products below `WORK` comparisons a word.

Defined cases: a null text has no words. Without a doc_id no letter is deleted. A run of any length is one word. Repeated rows count
again. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.tokens import buffers, chunks
from stallbook.scratch import cut_lineage, stored

#: Words of a block, their letters, and comparisons for each word that the number of classes aims at.
BLOCK, BLOCK_LETTERS = 1024, 1 << 21
WORK, MOST_CLASSES = 8192, 12
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_LEAD = 0xC3  # U+00C0 to U+00FF are C3 80 to C3 BF
_LETTERS = 26 + 64


def _runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All runs of letters in a binary column, dictionary-coded, and the text that each belongs to."""
    data, bounds = buffers(texts)
    low = _FOLD[data]
    inside = (low >= ord("a")) & (low <= ord("z")) | (low == _LEAD)
    inside[1:] |= (low[:-1] == _LEAD) & (low[1:] >= 0x80)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # texts lie side by side without a separator
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin = np.flatnonzero(first)
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - begin, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])
    return words.dictionary_encode(), np.searchsorted(bounds, begin, side="right") - 1


def _count(min_chars: int, every: int):
    """word, n: partial counts of whole texts, with the letter that the checksum of (document, run) tells to delete."""

    def batch_counts(batch: pa.RecordBatch) -> pa.Table:
        coded, text = _runs(batch.column("text"))
        terms, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        length = np.fromiter((len(t) - t.count(_LEAD) for t in terms), np.int64, len(terms))
        taken = length[codes] >= min_chars
        pairs, times = np.unique(text[taken] * max(len(terms), 1) + codes[taken], return_counts=True)
        of_text, of_term = np.divmod(pairs, max(len(terms), 1))
        ids = batch.column("doc_id").to_pylist()
        seeds = [None if i is None else zlib.crc32(f"{i}:".encode()) for i in ids]
        totals = np.bincount(of_term, times, len(terms)).astype(np.int64)
        words, counts = [], []
        crc32 = zlib.crc32
        for term, at, n in zip(of_term.tolist(), of_text.tolist(), times.tolist(), strict=True):
            seed = seeds[at]
            if seed is None:
                continue
            h = crc32(terms[term], seed)
            if h % every == 0:
                run = terms[term].decode()
                cut = h % len(run)
                totals[term] -= n
                if len(run) > min_chars:
                    words.append((run[:cut] + run[cut + 1 :]).encode())
                    counts.append(n)
        some = np.flatnonzero(totals)
        words.extend(terms[i] for i in some.tolist())
        return pa.table({"word": pa.array(words, pa.binary()), "n": pa.array([*counts, *totals[some].tolist()], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        add = lambda: pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
        for batch in batches:
            for part in chunks(batch):
                held.append(batch_counts(part))
                n += held[-1].num_rows
                if n > HELD_WORDS:
                    held = [add()]
                    n = held[0].num_rows
                    if n > HELD_WORDS // 2:
                        yield from held[0].to_batches(1 << 16)
                        held, n = [], 0
        if held:
            yield from add().to_batches(1 << 16)

    return run


def counted_words(docs: DataFrame, min_chars: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """word, n: lower-cased runs of letters of at least `min_chars` code points that occur at least `min_count` times.

    Where crc32 of `<doc_id>:<run>` is a multiple of `every`, the run loses its code point number crc32 % length first.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    partial = texts.mapInArrow(_count(min_chars, every), "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count).select(F.col("word").cast("string").alias("word"), "n")


class _Words:
    """Words as code points (0 behind the end) and letter counts."""

    def __init__(self, words: list[str], n: np.ndarray, kind: np.ndarray | None = None):
        self.words, self.n, self.kind = words, n, kind
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.length.max())
        self.points = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
        self.counts = letter_counts(self.points)
        self.norms = (self.counts**2).sum(axis=1)


def letter_counts(points: np.ndarray) -> np.ndarray:
    letter = np.where(points >= 0xC0, points.astype(np.int64) - 0xC0 + 26, points.astype(np.int64) - ord("a"))
    row, column = np.nonzero(points)
    cells = row * _LETTERS + letter[row, column]
    return np.bincount(cells, minlength=len(points) * _LETTERS).reshape(-1, _LETTERS).astype(np.float64)


def _near(a: _Words, b: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) one edit apart; a word of a is as long as those of b, or one letter shorter."""
    # Squares and products of counts are whole numbers below 2^53, so the distances are exact.
    wanted = np.where(a.length == b.length[0], 2.0, 1.0)
    used = np.flatnonzero(a.counts.any(axis=0) & b.counts.any(axis=0))
    products = a.counts[:, used] @ b.counts[:, used].T
    products *= 2
    products -= (a.norms - wanted)[:, None]
    i, j = np.nonzero(products == b.norms[None, :])
    if not len(i):
        return i, j
    width = b.points.shape[1]
    step = max(1, (1 << 22) // width)
    kept = np.concatenate([_one_edit(a, b, i[s : s + step], j[s : s + step]) for s in range(0, len(i), step)])
    return i[kept], j[kept]


def _one_edit(a: _Words, b: _Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    width = b.points.shape[1]
    left = np.zeros((len(i), width), np.uint32)
    left[:, : a.points.shape[1]] = a.points[i][:, :width]
    right = b.points[j]
    same = left == right
    replaced = (a.length[i] == b.length[j]) & ((~same).sum(axis=1) == 1)
    # A letter more in b: up to some place the words agree, behind it they agree one place later.
    before = np.logical_and.accumulate(same[:, :-1], axis=1)
    inserted = (a.length[i] + 1 == b.length[j]) & (before | (left[:, :-1] == right[:, 1:])).all(axis=1)
    return replaced | inserted


def _weights(classes: int) -> np.ndarray:
    """Drawn numbers below 2^31: the number of a cell with class counts c is their weighted sum, so neighbours differ by known steps."""
    import xxhash

    return np.array([xxhash.xxh32_intdigest(str(i).encode()) >> 1 for i in range(classes)], np.int64)


def _classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """Number of letters in each class; letters are dealt in turn."""
    dealt = (np.arange(_LETTERS)[:, None] % classes == np.arange(classes)).astype(np.float64)
    return (counts @ dealt).astype(np.int64)


def _cells(words: list[str], classes: list[int]) -> list[np.ndarray]:
    width = max(map(len, words))
    out = [np.empty(len(words), np.int64) for _ in classes]
    step = max(1, (1 << 22) // width)
    for at in range(0, len(words), step):
        counts = letter_counts(np.array(words[at : at + step], f"U{width}").view(np.uint32).reshape(-1, width))
        for cells, k in zip(out, classes, strict=True):
            cells[at : at + step] = _classes(counts, k) @ _weights(k)
    return out


def _cell_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ks = list(range(1, MOST_CLASSES + 1))
    for batch in batches:
        if batch.num_rows:
            for k, cells in zip(ks, _cells(batch.column("word").to_pylist(), ks), strict=True):
                cell, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(n)], ["classes", "cell", "n"])


def _with_cell(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = batch.column("word").to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_cells(words, [classes])[0])], [*batch.schema.names, "cell"])

    return run


def _steps(classes: int) -> list[tuple[int, int, int]]:
    """Cells that a word visits beside its own, as (step of the cell, class that grows, class that shrinks or -1).

    One more letter, or one letter replaced by one of a later class: each unordered pair of cells is visited from one side.
    """
    weight = _weights(classes)
    more = [(int(weight[g]), g, -1) for g in range(classes)]
    other = [(int(weight[g] - weight[s]), g, s) for g in range(classes) for s in range(g)]
    return more + other


def _visit(grown, shrunk):
    """Number of a kind of visit; 0 is the one within a cell."""
    return 1 + grown * (MOST_CLASSES + 1) + shrunk + 1


def _moves(a: _Words, b: _Words, i: np.ndarray, j: np.ndarray, classes: int) -> np.ndarray:
    """The kind of visit that leads from a word of a to the near word of b."""
    moved = _classes(b.counts[j], classes) - _classes(a.counts[i], classes)
    grown, shrunk = (np.where((moved == x).any(axis=1), (moved == x).argmax(axis=1), -1) for x in (1, -1))
    return np.where(grown < 0, 0, _visit(grown, shrunk))


def number_of_classes(words: DataFrame) -> int:
    """The fewest classes whose cells hold the comparisons for each word below WORK."""
    sizes = words.select("word").mapInArrow(_cell_sizes, "classes int, cell long, n long").groupBy("classes", "cell").agg(F.sum("n").cast("double").alias("n"))
    rows = sizes.groupBy("classes").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean")).collect()
    means = {r["classes"]: r["mean"] for r in rows}
    return next((k for k in range(1, MOST_CLASSES + 1) if means.get(k, 0) * (1 + len(_steps(k))) <= WORK), MOST_CLASSES)


def _compare(classes: int):
    """Sorted stream of blocks: residents first (kind -1), then visitors. Returns partial results of words that have near words."""

    def best(held: dict, word: str, n: int, other: str, other_n: int) -> None:
        now = held.get(word)
        if now is None:
            held[word] = [1, other_n, other]
        else:
            now[0] += 1
            if other_n > now[1] or other_n == now[1] and other < now[2]:
                now[1:] = other_n, other

    def credit(held: dict, a: _Words, b: _Words, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            best(held, a.words[x], int(a.n[x]), b.words[y], int(b.n[y]))
            best(held, b.words[y], int(b.n[y]), a.words[x], int(a.n[x]))

    def meet(held: dict, residents: _Words, words: list[str], n: np.ndarray, kind: np.ndarray) -> None:
        length = int(residents.length[0])
        fits = [i for i, w in enumerate(words) if len(w) in (length, length - 1)]  # others share the cell's number by chance
        step = max(1, min(BLOCK, BLOCK_LETTERS // length))
        for at in range(0, len(fits), step):
            rows = fits[at : at + step]
            a = _Words([words[i] for i in rows], n[rows], kind[rows])
            i, j = _near(a, residents)
            if len(i):
                # A pair counts on the visit that its own letters call for, so a cell number that two cells share does no harm.
                right = _moves(a, residents, i, j, classes) == a.kind[i]
                credit(held, a, residents, i[right], j[right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        name, waiting, residents = None, [], None

        def out() -> pa.RecordBatch:
            rows = [(w, x[0], x[1], x[2]) for w, x in held.items()]
            held.clear()
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["word", "n_near", "best_n", "best"]
            )

        def settle() -> _Words:
            """The residents of the block at hand, which have one length, compared with each other once."""
            own = _Words([w for x, _ in waiting for w in x], np.concatenate([x for _, x in waiting]))
            i, j = _near(own, own)
            if len(i):
                once = (i < j) & (_moves(own, own, i, j, classes) == 0)
                credit(held, own, own, i[once], j[once])
            return own

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, block, kind = (batch.column(c).to_numpy() for c in ("cell", "block", "kind"))
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            role = kind >= 0
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)], strict=True):
                if name != (cell[a], block[a]):
                    if waiting and residents is None:
                        settle()
                    name, waiting, residents = (cell[a], block[a]), [], None
                if role[a]:
                    if residents is None and waiting:
                        residents = settle()
                    if residents is not None:
                        meet(held, residents, words[a:b], n[a:b], kind[a:b])
                else:
                    waiting.append((words[a:b], n[a:b]))
            if len(held) > HELD_WORDS // 4:
                yield out()
        if waiting and residents is None:
            settle()
        if held:
            yield out()

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of the words (word, n) that have a near word; best has the largest n, of equals the first in code-point order."""
    classes = number_of_classes(words)
    placed = stored(words.mapInArrow(_with_cell(classes), "word string, n long, cell long").withColumn("length", F.char_length("word")), "cells")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_LETTERS) / F.col("length"))))
    # Two cells may share a number; the length parts blocks, so that residents of a block have one length.
    cells = placed.groupBy("cell", "length").agg(F.ceil(F.count("*") / F.max(room)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    homes = placed.join(cells, ["cell", "length"]).withColumn("block", block)
    residents = homes.select("cell", "length", "block", F.lit(-1).alias("kind"), "word", "n")
    # Inside a cell the words of a block visit the later blocks.
    inner = homes.filter("block + 1 < blocks").select("cell", "length", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "word", "n")
    steps = F.array(
        *(
            F.struct(F.lit(step).alias("step"), F.lit(int(lost < 0)).alias("longer"), F.lit(_visit(grown, lost)).alias("kind"))
            for step, grown, lost in _steps(classes)
        )
    )
    away = placed.select("word", "n", "length", "cell", F.explode(steps).alias("s")).select(
        "word", "n", (F.col("cell") + F.col("s.step")).alias("cell"), (F.col("length") + F.col("s.longer")).alias("length"), F.col("s.kind").alias("kind")
    )
    outer = away.join(cells, ["cell", "length"]).select(
        "cell", "length", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "kind", "word", "n"
    )
    rows = residents.unionByName(inner).unionByName(outer)
    # The length is part of a block's name.
    tasks = rows.withColumn("block", F.col("block").cast("long") * F.lit(1 << 31) + F.col("length")).drop("length")
    dealt = tasks.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    partial = dealt.mapInArrow(_compare(classes), "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("top")
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of the links word -> form, which have no circle: where the links from a word end."""
    current = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("at"), F.col("root").alias("next"))
        jumped = current.join(onward, F.col("root") == F.col("at"), "left")
        current = cut_lineage(jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if current.filter("moved").isEmpty():
            return current.select("word", "root")


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the documents.

    n_near: words one edit away. form: the most frequent of them (ties: first in code-point order) if it is at least `ratio`
    times as frequent. root: the last word that forms lead to, the word itself without a form.
    """
    words = stored(counted_words(docs, min_chars, min_count, every), "words")
    near = stored(near_words(words), "near")
    joined = words.join(near, "word", "left")
    better = F.col("best_n") >= ratio * F.col("n")
    formed = stored(
        joined.select("word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best_n")).alias("form_n")),
        "forms",
    )
    roots = last_forms(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
