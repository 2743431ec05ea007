"""A trie over the token sequences of phrases, walked for all places of a batch of texts at once.

The trie of a phrase list is one sorted array of edges (node, word) -> node. With optional tokens, a node behind the mandatory
ones also has edges to the nodes it reaches by leaving tokens out, so a place can stand at several nodes; no variant of a phrase is
ever written out. All places of a batch take one step together: a binary search finds the edges of every active place.

A list of more than TRIE_TOKENS tokens is cut into several tries by a hash of its phrases' heads: the tokens that must match, or all there
are. A place belongs to the trie of its own head, so the work on a text does not grow with the number of tries. Each trie is a
broadcast of that bounded size, and a task holds one at a time: a group of texts passes them in turn, all in one Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallbook.functions.text import token_slices
from stallbook.scratch import stored

#: Tokens of the phrases in one trie; bounds the broadcast, not the list.
TRIE_TOKENS = 1 << 21
#: Tokens of the texts that pass several tries together.
GROUP_TOKENS = 1 << 20
#: Tokens of a phrase that must match; each later one may be missing if tokens are optional.
MANDATORY = 2


@dataclass
class TokenTrie:
    """Edges by key node * len(words) + word, node 0 apart; the labels that end at node i are accepted[starts[i] : starts[i + 1]].

    A word's number is its place among the sorted hashes; words of one hash follow each other, `twins` of them at most.
    """

    words: pa.Array
    hashes: np.ndarray
    twins: int
    root: np.ndarray
    keys: np.ndarray
    to: np.ndarray
    starts: np.ndarray
    accepted: np.ndarray
    labels: list[str]
    optional: bool

    def numbers(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those in no phrase. The hash only finds a place, the texts are compared."""
        found = np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes)
        for k in range(self.twins):
            open_ = np.flatnonzero((found < 0) & (at + k < len(self.hashes)))
            open_ = open_[self.hashes[at[open_] + k] == hashes[open_]]
            same = pc.equal(self.words.take(pa.array(at[open_] + k)), words.take(pa.array(open_))).to_numpy(zero_copy_only=False).astype(bool)
            found[open_[same]] = at[open_[same]] + k
        return found

    def step(self, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places go on (by index, once for every edge), and where to."""
        key = node * len(self.words) + word
        low = np.searchsorted(self.keys, key, "left")
        hits = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(0, np.int64)
        if not self.optional:  # one edge for each word
            return hits, self.to[low[hits]].astype(np.int64)
        places, edges = _expand(low[hits], np.searchsorted(self.keys, key[hits], "right"))
        return hits[places], self.to[edges].astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, the same in every process."""
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _shard(first: np.ndarray, second: np.ndarray | None, shards: int) -> np.ndarray:
    """Trie of the heads with these word hashes; a head of one word has no second."""
    mixed = first if second is None else first * np.uint64(0x9E3779B97F4A7C15) + second
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ranges [low, high) and their members."""
    count = high - low
    owner = np.repeat(np.arange(len(low)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]


def build_trie(phrases: pa.Table, optional: bool) -> TokenTrie:
    """Trie of the rows (label, tokens); `optional`: tokens behind the first MANDATORY ones may be missing."""
    phrases = phrases.combine_chunks()
    tokens = phrases.column("tokens").combine_chunks()
    named = phrases.column("label").combine_chunks().cast(pa.string()).dictionary_encode()
    labels = sorted(named.dictionary.to_pylist())
    label = np.array([labels.index(x) for x in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]
    coded = tokens.flatten().cast(pa.string()).dictionary_encode()
    hashes = word_hashes(coded.dictionary)
    order = np.argsort(hashes, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    word_of = number[coded.indices.to_numpy()]
    hashes, n_words, n_labels = hashes[order], max(len(order), 1), max(len(labels), 1)
    counts = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(counts) - counts
    at, node, left, size = [], np.zeros(len(counts), np.int64), np.arange(len(counts)), 1
    parent, word, depth, ends = [np.array([-1])], [np.array([-1])], [np.array([0])], []
    level = 0
    while len(left := left[counts[left] > level]):
        below, which = np.unique(node[left] * n_words + word_of[begin[left] + level], return_inverse=True)
        at.append(below)
        parent.append(below // n_words)
        word.append(below % n_words)
        level += 1
        depth.append(np.full(len(below), level))
        node[left] = size + which
        size += len(below)
        if optional and level >= MANDATORY:
            ends.append(np.unique(node[left] * n_labels + label[left]))  # all that follows may be missing
    ends.append(node * n_labels + label)
    parent, word, depth = np.concatenate(parent), np.concatenate(word), np.concatenate(depth)
    edges, to = [np.concatenate(at)] if at else [np.zeros(0, np.int64)], [np.arange(1, size)]
    if optional:
        below, above = np.arange(1, size), parent[1:]
        # From every node above that may leave tokens out, up to one that the same word has led to.
        while len(below):
            on = (depth[above] > MANDATORY) & (word[above] != word[below])
            below, above = below[on], parent[above[on]]
            edges.append(above * n_words + word[below])
            to.append(below)
    key, to = np.concatenate(edges), np.concatenate(to)
    root, first = np.full(n_words, -1, np.int32), key < n_words
    root[key[first]] = to[first]
    order = np.lexsort((to[~first], key[~first]))
    accepted = np.unique(np.concatenate(ends))
    starts = np.searchsorted(accepted, np.arange(size + 1) * n_labels)
    twins = int(np.unique(hashes, return_counts=True)[1].max()) if len(hashes) else 0
    return TokenTrie(
        coded.dictionary.take(pa.array(number.argsort())), hashes, twins, root, key[~first][order], to[~first][order].astype(np.int32),
        starts.astype(np.int32), (accepted % n_labels).astype(np.min_scalar_type(n_labels)), labels, optional,
    )


def walk(trie: TokenTrie, ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches (first, n, label number) that begin at the places `at`, in word numbers `ids` (-1: in no phrase). ends: where the text of each token ends."""
    at = at[ids[at] >= 0]
    node = trie.root[ids[at]].astype(np.int64)
    at, node = at[node >= 0], node[node >= 0]
    found, n = [], 1
    while len(at):
        owner, accepted = _expand(trie.starts[node], trie.starts[node + 1])
        labels = trie.accepted[accepted]
        if trie.optional and n > MANDATORY:  # several nodes can end with one label
            key = np.unique(at[owner] * (len(trie.labels) + 1) + labels)
            found.append((key // (len(trie.labels) + 1), np.full(len(key), n), key % (len(trie.labels) + 1)))
        else:
            found.append((at[owner], np.full(len(owner), n), labels.astype(np.int64)))
        here = at + n
        inside = np.flatnonzero(here < ends[at])
        inside = inside[ids[here[inside]] >= 0]
        places, node = trie.step(node[inside], ids[here[inside]])
        at, n = at[inside][places], n + 1
        if trie.optional and n > MANDATORY + 1:  # two ways of leaving tokens out can meet
            at, node = np.divmod(np.unique(at * len(trie.starts) + node), len(trie.starts))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def token_ends(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First token of each list of a column, and for each token where its list ends."""
    counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    return begin, np.repeat(begin[1:], counts)


@dataclass
class Matches:
    """Matches of a batch, sorted: first (token number in the batch), n (tokens), label (number in `labels`, which are sorted)."""

    first: np.ndarray
    n: np.ndarray
    label: np.ndarray
    labels: list[str]

    def names(self) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(self.label.astype(np.int32)), pa.array(self.labels, pa.string())).cast(pa.string())


class _Texts:
    """A batch of texts on its way through the tries."""

    def __init__(self, batch: pa.RecordBatch, shards: int):
        self.batch, self.found = batch, []
        self.begin, self.ends = token_ends(batch.column("words"))
        coded = batch.column("words").flatten().dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy()
        self.hashes = word_hashes(self.words)
        if shards > 1:
            hashes = self.hashes[self.code]
            self.one = _shard(hashes, None, shards).astype(np.int32)
            self.two = np.append(_shard(hashes[:-1], hashes[1:], shards), -1).astype(np.int32) if len(hashes) else self.one

    def match(self, trie: TokenTrie, shard: int, shards: int) -> None:
        ids = self.trie_numbers(trie)
        at = np.arange(len(ids)) if shards == 1 else np.flatnonzero((self.one == shard) | (self.two == shard))
        first, n, label = walk(trie, ids, self.ends, at)
        # These wait for the other texts of the group, as narrow as they can be.
        self.found.append((first.astype(np.int32), n.astype(np.int32), label.astype(trie.accepted.dtype), trie.labels))

    def trie_numbers(self, trie: TokenTrie) -> np.ndarray:
        return trie.numbers(self.words, self.hashes)[self.code]

    def matches(self) -> Matches:
        names = sorted({name for *_, labels in self.found for name in labels})
        number = {name: i for i, name in enumerate(names)}
        parts = [(first, n, np.array([number[x] for x in labels], np.int64)[label]) for first, n, label, labels in self.found if len(first)]
        if not parts:
            none = np.zeros(0, np.int64)
            return Matches(none, none, none, names)
        first, n, label = (np.concatenate(x) for x in zip(*parts, strict=True))
        longest = int(n.max()) + 1
        key = np.sort((first.astype(np.int64) * longest + n) * len(names) + label)
        place, label = np.divmod(key, len(names))
        return Matches(*np.divmod(place, longest), label, names)


def _groups(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[list[_Texts]]:
    """Slices that pass the tries together: one by one if there is one trie, which stays in memory."""
    group, size = [], 0
    for batch in token_slices(batches, "words"):
        group.append(_Texts(batch, shards))
        size += len(group[-1].code)
        if shards < 2 or size >= GROUP_TOKENS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _unheld(shared) -> None:
    """Forget the value of a broadcast, which is read again from its file when it is asked for."""
    if getattr(shared, "_path", None):
        vars(shared).pop("_value", None)


def _with_shards(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            begin, ends = token_ends(tokens)
            counts, flat = np.diff(begin), tokens.flatten()
            hashes = word_hashes(flat)
            shard = np.zeros(batch.num_rows, np.int64)
            one, more = np.flatnonzero(counts == 1), np.flatnonzero(counts > 1)
            shard[one] = _shard(hashes[begin[one]], None, shards)
            shard[more] = _shard(hashes[begin[more]], hashes[begin[more] + 1], shards)
            yield pa.RecordBatch.from_arrays([batch.column("label"), tokens, pa.array(shard, pa.int32())], ["label", "tokens", "shard"])

    return run


def _tries(patterns: DataFrame, optional: bool) -> list:
    """Broadcasts of the tries of the patterns (label, tokens); the driver builds them one by one and keeps none."""
    context = patterns.sparkSession.sparkContext
    phrases = patterns.select("label", "tokens").filter(F.size("tokens") > 0)
    total = phrases.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    shards = -(-total // TRIE_TOKENS)
    if shards > 1:
        phrases = stored(phrases.mapInArrow(_with_shards(shards), T.StructType([*phrases.schema.fields, T.StructField("shard", T.IntegerType())])), "phrases")
    tries = []
    for shard in range(shards):
        part = phrases.filter(F.col("shard") == shard).drop("shard") if shards > 1 else phrases
        tries.append(context.broadcast(build_trie(part.toArrow(), optional)))
        _unheld(tries[-1])
    return tries


def with_matches(rows: DataFrame, patterns: DataFrame, optional: bool, run: Callable, schema: T.StructType) -> DataFrame:
    """What `run` (batch, matches) makes of `rows` (with `words`: array of lower-cased tokens) and all matches of the patterns (label, tokens).

    A place, a length and a label are one match. Nothing is shuffled.
    """
    tries = _tries(patterns, optional)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(tries)):
            for shard, shared in enumerate(tries):
                trie = shared.value
                for texts in group:
                    texts.match(trie, shard, len(tries))
                if len(tries) > 1:
                    del trie
                    _unheld(shared)
            while group:
                texts = group.pop(0)
                yield from run(texts.batch, texts.matches())

    return rows.mapInArrow(stage, schema)


def longest_first(first: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which intervals stay if the longest is taken first, then the earliest, then the one of smaller `order`, and none may overlap.

    Rounds of local maxima: an interval that ranks best on all its tokens is taken, and all that share a token with it go.
    """
    taken = np.zeros(len(first), bool)
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((order, first, -n))] = np.arange(len(first))
    left = np.argsort(-rank)  # worst first, so that the best one is written last
    base = int(first.min()) if len(first) else 0
    best = np.zeros(int((first + n).max()) - base if len(first) else 0, np.int64)
    used = np.zeros(len(best), bool)
    while len(left):
        owner, token = _expand(first[left] - base, first[left] + n[left] - base)
        best[token] = rank[left][owner]
        starts = np.cumsum(n[left]) - n[left]
        wins = np.logical_and.reduceat(best[token] == rank[left][owner], starts)
        taken[left[wins]] = True
        used[token[wins[owner]]] = True
        left = left[~np.logical_or.reduceat(used[token], starts)]
        used[token] = False
    return taken
