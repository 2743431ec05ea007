"""Prefix trie of conversations: member intervals by range-minimum over sorted common prefixes.

A conversation is the sequence of its turns (role, text), held as 16 bytes of a hash and a length for each turn. The
sequences are range-partitioned and sorted, so that the members of every prefix are neighbours. A partition keeps the
lengths of the common prefix of neighbours (LCP) and a sparse table of their minima. Each candidate prefix (conversation i,
depth d) searches its left and its right extent on its own, in steps of falling powers of two; the interval gives the
members, the smallest id (a second sparse table) and, by prefix sums, leaves, children and saved tokens. No stack, no pass
that depends on another candidate.

An interval can run over the edge of a partition. Only prefixes of a partition's first and last conversation can: these
leave it as partial rows keyed by a hash of the prefix, and partial rows add up. The first partition that holds such a
prefix created it; this also tells the LCP across the edge. Members that end at such a prefix travel as chunks of ids, and
one stream hashes them in order.

Defined cases: rows without conv_id take no part. Turns follow `turn` (null first), ties `role`, then `text`, both with null
as empty; equal rows all count. Only groups that hold such a tie are sorted again with their texts. An empty table has no
node, not even a root. Other columns are not read. One conversation is one row of 20 bytes for each turn; its turns are sorted
by Spark and never held with their texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from stallbook.llm.tokens import buffers
from stallbook.scratch import stored

#: Conversations and turns that a task sorts and searches at once.
PART_ROWS, PART_TURNS = 250_000, 2_000_000
#: Candidate prefixes that search their extents at once, and ids in a chunk of a prefix that crosses an edge.
CANDIDATES, CHUNK_IDS = 1 << 18, 1 << 16
KEY_BYTES = 16

_SEQUENCE = pa.schema(
    [("family", pa.int64()), ("tied", pa.bool_()), ("conv_id", pa.int64()), ("n_turns", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary())]
)
_NODE, _PARTIAL, _ENDS = 0, 1, 2
_LONGS = "depth conv_id parent_conv_id n_convs n_children n_leaves saved_tokens tokens made before through first_tokens first_turns"
_FOUND = pa.schema(
    [(c, pa.int32()) for c in ("kind", "part", "side", "chunk")]
    + [(c, pa.int64()) for c in _LONGS.split()]
    + [(c, pa.bool_()) for c in ("at_first", "at_last", "last_end")]
    + [(c, pa.binary()) for c in ("hash", "parent_hash", "ids")]
    + [("ends_sha256", pa.string())]
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turn_rows(conversations: DataFrame, family: int | None) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps (role, text) apart from every other cut of the same letters.
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    group = F.col("conv_id") if family is None else F.col("conv_id") - F.col("conv_id") % family
    return conversations.filter("conv_id is not null").select(
        group.alias("family"),
        (F.col("conv_id") != group).alias("later"),
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.substring(F.unhex(F.sha2(both.cast("binary"), 256)), 1, KEY_BYTES).alias("key"),
        F.char_length(text).alias("size"),
    )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of equal conv_id in a sorted stream: family, conv_id, keys, sizes, and whether turns tie with different content."""
    name, pieces = None, []

    def run() -> tuple:
        keys, sizes, turns, known = (np.concatenate(x) for x in zip(*pieces, strict=True))
        tie = (turns[1:] == turns[:-1]) & (known[1:] == known[:-1]) & (keys[1:] != keys[:-1]).any(axis=1)
        return (*name, keys, sizes, bool(tie.any()))

    for batch in batches:
        if not batch.num_rows:
            continue
        family, ids = batch.column("family").to_numpy(), batch.column("conv_id").to_numpy()
        keys = np.frombuffer(buffers(batch.column("key"))[0].tobytes(), np.uint64).reshape(-1, 2)
        known = batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
        turns, sizes = batch.column("turn").fill_null(0).to_numpy(), batch.column("size").to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (family[1:] != family[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if name is not None and name != (family[a], ids[a]):
                yield run()
                pieces = []
            name = (family[a], ids[a])
            pieces.append((keys[a:b], sizes[a:b], turns[a:b], known[a:b]))
    if name is not None:
        yield run()


def _rebuild(heads: int):
    """Sequences of a stream sorted by family, its first conversation at the front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        base = None
        for family, conv, keys, sizes, tied in _whole(batches):
            if family == conv:
                base = (family, keys[:heads], sizes[:heads])
            if heads:
                h = zlib.crc32(str(conv).encode()) % heads
                known = base is not None and base[0] == family
                keys = np.concatenate([base[1][:h] if known else keys[:0], keys[h:]])
                sizes = np.concatenate([base[2][:h] if known else sizes[:0], sizes[h:]])
            held.append((int(family), tied, int(conv), len(keys), keys.tobytes(), sizes.astype(np.int32).tobytes()))
            weight += 64 + 20 * len(keys)
            if weight > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _SEQUENCE.types, strict=True)], schema=_SEQUENCE)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _SEQUENCE.types, strict=True)], schema=_SEQUENCE)

    return run


def turn_sequences(conversations: DataFrame, family: int | None = None, heads: int = 0) -> DataFrame:
    """conv_id, n_turns, keys and sizes (16 and 4 bytes for each turn) of each conversation.

    With `family`, conversation c begins with the first h turns of conversation c - c % family and goes on with its own turns
    after its first h; h is crc32(c in decimal) % heads.
    """
    rows = _turn_rows(conversations, family)
    order = ["family", "later", "conv_id", F.col("turn").asc_nulls_first()]
    dealt = rows.drop("role", "text").repartition("family").sortWithinPartitions(*order, "key")
    first = stored(dealt.mapInArrow(_rebuild(heads), from_arrow_schema(_SEQUENCE)), "sequences")
    odd = first.filter("tied").select("family").distinct()
    if odd.isEmpty():
        return first.drop("family", "tied")
    texts = rows.join(odd, "family", "left_semi").repartition("family").sortWithinPartitions(*order, "role", "text")
    again = texts.drop("role", "text").mapInArrow(_rebuild(heads), from_arrow_schema(_SEQUENCE))
    return stored(first.join(odd, "family", "left_anti").unionByName(again).drop("family", "tied"), "sequences")


class _Minima:
    """Sparse table: minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum over [left, right]."""
        level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(left), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][left[at]], self.levels[k][right[at] - (1 << int(k)) + 1])
        return out

    def right_extent(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last position that is reached from `at` over values of at least `depth` to its right."""
        pos, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(pos + (1 << k) < n)
            fits = fits[self.levels[k][pos[fits] + 1] >= depth[fits]]
            pos[fits] += 1 << k
        return pos

    def left_extent(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First position from which `at` is reached over values of at least `depth`."""
        pos = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(pos - (1 << k) >= 0)
            fits = fits[self.levels[k][pos[fits] - (1 << k) + 1] >= depth[fits]]
            pos[fits] -= 1 << k
        return pos


def _common(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Turns that sequence i shares with sequence i - 1, from the second one on. keys: two numbers for each turn."""
    n = np.diff(starts)
    both = np.minimum(n[:-1], n[1:])
    begin = np.cumsum(both) - both
    offset = np.arange(both.sum()) - np.repeat(begin, both)
    same = (keys[np.repeat(starts[:-2], both) + offset] == keys[np.repeat(starts[1:-1], both) + offset]).all(axis=1)
    out = both.copy()
    some = both > 0
    if some.any():
        differs = np.where(same, np.iinfo(np.int64).max, offset)
        out[some] = np.minimum(both[some], np.minimum.reduceat(differs, begin[some]))
    return out


def _path_hashes(keys: bytes) -> list[bytes]:
    """A hash of every prefix of a sequence, the empty one first."""
    import xxhash

    state = xxhash.xxh3_128()
    out = [state.digest()]
    for at in range(0, len(keys), KEY_BYTES):
        state.update(keys[at : at + KEY_BYTES])
        out.append(state.digest())
    return out


class _Part:
    """Sorted sequences of one partition."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        ids, counts, lcps, sizes = [], [], [], []
        self.first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = buffers(batch.column("keys"))
            held = last or b""
            keys = np.frombuffer(held + data.tobytes(), np.uint64).reshape(-1, 2)
            starts = np.concatenate([[0], bounds + len(held)]) // KEY_BYTES
            lcps.append(_common(keys, starts))
            ids.append(batch.column("conv_id").to_numpy())
            counts.append(np.diff(bounds) // KEY_BYTES)
            sizes.append(np.frombuffer(buffers(batch.column("sizes"))[0].tobytes(), np.int32))
            if self.first is None:
                self.first = data[: bounds[1]].tobytes()
            last = data[bounds[-2] :].tobytes()
        self.n = sum(map(len, ids))
        if not self.n:
            return
        self.last = last
        self.ids, self.turns, self.lcp = np.concatenate(ids), np.concatenate(counts), np.concatenate(lcps)
        self.lcp[0] = -1  # the edge to the partition before is settled later
        self.top = np.maximum(self.lcp, 0)
        offsets = np.cumsum(self.turns) - self.turns
        self._sums = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        self._offsets = offsets
        self.totals = self.through(np.arange(self.n), self.turns)
        self.entries = np.concatenate([[0], np.cumsum(self.turns - self.top + 1)])
        self.minima = _Minima(self.lcp.astype(np.int32))
        self.by_id = np.argsort(self.ids, kind="stable")
        rank = np.empty(self.n, np.int32)
        rank[self.by_id] = np.arange(self.n, dtype=np.int32)
        self.ranks = _Minima(rank)
        self._count()

    def through(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Text of the first `depth` turns of sequence i."""
        return self._sums[self._offsets[i] + depth] - self._sums[self._offsets[i]]

    def _count(self) -> None:
        """Sums over all sequences, and children by the entry (creator, depth) of their parent."""
        i = np.arange(1, self.n)
        made = np.zeros(self.n, np.int64)
        made[1:] = self.totals[1:] - self.through(i, self.lcp[1:])
        leaf = np.zeros(self.n, np.int64)
        leaf[:-1] = self.lcp[1:] < self.turns[:-1]
        self.made_sums, self.total_sums, self.leaf_sums = (np.concatenate([[0], np.cumsum(x)]) for x in (made, self.totals, leaf))
        self.children = np.zeros(self.entries[-1], np.int32)
        grows = i[self.turns[1:] > self.lcp[1:]]
        left = self.minima.left_extent(grows, self.lcp[grows])
        np.add.at(self.children, self.entries[left] + self.lcp[grows] - self.top[left], 1)
        # A sequence is, from its first own turn on, its own child; that of the first one waits for the edge.
        new_run = np.ones(self.n, bool)
        new_run[1:] = self.lcp[1:] < self.turns[1:]
        starts = np.flatnonzero(new_run)
        self.run_end = dict(zip(starts.tolist(), [*(starts[1:] - 1).tolist(), self.n - 1], strict=True))

    def blocks(self) -> Iterator[tuple[int, int]]:
        at = 0
        while at < self.n:
            end = max(at + 1, int(np.searchsorted(self.entries, self.entries[at] + CANDIDATES, side="right")) - 1)
            yield at, end
            at = end


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId()
    part = _Part(batches)
    if not part.n:
        return
    paths = _path_hashes(part.first), _path_hashes(part.last)

    def out(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)

    for a, b in part.blocks():
        count = np.diff(part.entries[a : b + 1])
        i = np.repeat(np.arange(a, b), count)
        depth = np.arange(len(i)) - np.repeat(part.entries[a:b] - part.entries[a], count) + part.top[i]
        left, right = part.minima.left_extent(i, depth), part.minima.right_extent(i, depth)
        smallest = part.ids[part.by_id[part.ranks.least(left, right)]]
        at_first, at_last = left == 0, right == part.n - 1
        open_ = at_first | at_last
        # The entry before is the parent: the same sequence one turn less, or the prefix that it visits.
        parent = np.arange(len(i)) - 1
        node = (left == i) & (depth > part.lcp[i])
        n = right - left + 1
        before = part.through(left, np.maximum(depth - 1, 0))
        tokens = part.total_sums[right + 1] - part.total_sums[left]
        made = part.made_sums[right + 1] - part.made_sums[np.minimum(left + 1, part.n)] + np.where(at_first, 0, part.totals[left] - before)
        leaves = part.leaf_sums[right + 1] - part.leaf_sums[left]
        own = (depth < part.turns[i]) & (i > 0)
        children = part.children[part.entries[a] : part.entries[b]] + own
        ends = np.flatnonzero(node & (depth == part.turns[i]))

        whole = np.flatnonzero(node & ~open_)
        if len(whole):
            p = parent[whole]
            hashed = {int(e): hashlib.sha256(",".join(map(str, part.ids[i[e] : part.run_end[int(i[e])] + 1].tolist())).encode()).hexdigest() for e in ends[~open_[ends]]}
            yield out(
                {
                    "kind": np.full(len(whole), _NODE),
                    "part": np.full(len(whole), number),
                    "side": pa.array(np.where(at_first[p], 0, 1), pa.int32(), mask=~open_[p]),
                    "depth": depth[whole],
                    "conv_id": smallest[whole],
                    "parent_conv_id": pa.array(smallest[p], pa.int64(), mask=open_[p]),
                    "n_convs": n[whole],
                    "n_children": children[whole],
                    "n_leaves": leaves[whole],
                    "saved_tokens": (tokens - n * before - made)[whole],
                    "ends_sha256": [hashed.get(e, _NO_ENDS) for e in whole.tolist()],
                },
                len(whole),
            )
        partial = np.flatnonzero(node & open_)
        if len(partial):
            d = depth[partial]
            side = np.where(at_first[partial], 0, 1)
            yield out(
                {
                    "kind": np.full(len(partial), _PARTIAL),
                    "part": np.full(len(partial), number),
                    "side": side,
                    "depth": d,
                    "conv_id": smallest[partial],
                    "n_convs": n[partial],
                    "n_children": children[partial],
                    "n_leaves": leaves[partial],
                    "hash": [paths[s][x] for s, x in zip(side.tolist(), d.tolist(), strict=True)],
                    "parent_hash": [paths[s][x - 1] if x else None for s, x in zip(side.tolist(), d.tolist(), strict=True)],
                    "at_first": at_first[partial],
                    "at_last": at_last[partial],
                    "last_end": at_last[partial] & (d == part.turns[-1]),
                    "tokens": tokens[partial],
                    "made": made[partial],
                    "before": before[partial],
                    "through": part.through(left, depth)[partial],
                    "first_tokens": np.full(len(partial), part.totals[0]),
                    "first_turns": np.full(len(partial), part.turns[0]),
                },
                len(partial),
            )
        for e in ends[open_[ends]]:
            d, members = int(depth[e]), part.ids[i[e] : part.run_end[int(i[e])] + 1]
            for no, at in enumerate(range(0, len(members), CHUNK_IDS)):
                chunk = ",".join(map(str, members[at : at + CHUNK_IDS].tolist())).encode()
                yield out(
                    {"kind": [_ENDS], "part": [number], "depth": [d], "hash": [paths[0 if at_first[e] else 1][d]], "chunk": [no], "ids": [chunk]},
                    1,
                )


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each (hash, depth) of a sorted stream of chunks."""
    name = state = None
    done: list[tuple] = []
    for batch in batches:
        for key, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("hash", "depth", "ids")), strict=True):
            if name != (key, depth):
                if name is not None:
                    done.append((*name, state.hexdigest()))
                name, state = (key, depth), hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if name is not None:
        done.append((*name, state.hexdigest()))
        keys, depths, digests = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(depths, pa.int64()), pa.array(digests, pa.string())], ["hash", "depth", "ends_sha256"])


_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _across_edges(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes that touch an edge of a partition as whole nodes, and the key (part, side, depth) of each of their rows."""
    partial = found.filter(F.col("kind") == _PARTIAL)
    span = partial.groupBy("hash", "depth").agg(F.min("part").alias("creator"), F.max("part").alias("latest"))
    spanned = partial.join(span, ["hash", "depth"])
    known = F.col("at_first") & (F.col("creator") < F.col("part"))
    # Two paths for each partition: how far its first sequence was known before, and whether its last one ends a path.
    edges = spanned.groupBy("part").agg(
        F.coalesce(F.max(F.when(known, F.col("depth"))), F.lit(-1)).alias("edge"),
        F.coalesce(F.max(F.when(known, F.col("through"))), F.lit(0)).alias("edge_through"),
        F.max((F.col("last_end") & (F.col("latest") == F.col("part"))).cast("long")).alias("last_leaf"),
    )
    made = F.col("made") + F.when(F.col("at_first"), F.col("first_tokens") - F.greatest("edge_through", "before")).otherwise(0)
    child = F.col("at_first") & (F.col("first_turns") > F.col("depth")) & (F.col("edge") <= F.col("depth"))
    leaf = F.when(F.col("at_last"), F.col("last_leaf")).otherwise(0)
    total = F.sum("tokens") - F.sum("n_convs") * F.first("before") - F.sum("total_made")
    merged = (
        partial.join(edges, "part")
        .select("*", made.alias("total_made"), (F.col("n_children") + child.cast("long")).alias("children"), (F.col("n_leaves") + leaf).alias("leaves"))
        .groupBy("hash", "depth")
        .agg(
            F.first("parent_hash").alias("parent_hash"),
            F.min("conv_id").alias("conv_id"),
            F.sum("children").alias("n_children"),
            F.sum("leaves").alias("n_leaves"),
            total.alias("saved_tokens"),
            F.sum("n_convs").alias("n_convs"),
        )
    )
    chunks = found.filter(F.col("kind") == _ENDS).select("hash", "depth", "part", "chunk", "ids")
    hashed = chunks.repartition("hash", "depth").sortWithinPartitions("hash", "depth", "part", "chunk")
    ends = hashed.mapInArrow(_hash_chunks, "hash binary, depth long, ends_sha256 string")
    nodes = stored(merged.join(ends, ["hash", "depth"], "left"), "edge_nodes")
    return nodes, partial.select("part", "side", "depth", "hash")


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences that `turn_sequences` returns; the columns are those of `prefix_trie`."""
    size = sequences.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_turns"), F.lit(0)).alias("turns")).first()
    least = sequences.sparkSession.sparkContext.defaultParallelism
    parts = max(least, -(-size["rows"] // PART_ROWS), -(-size["turns"] // PART_TURNS))
    ordered = sequences.repartitionByRange(parts, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    found = stored(ordered.select("conv_id", "keys", "sizes").mapInArrow(_intervals, from_arrow_schema(_FOUND)), "prefixes")
    nodes, rows = _across_edges(found)
    parents = nodes.select(F.col("hash").alias("parent_hash"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    crossing = nodes.join(parents, ["parent_hash", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    inside = found.filter(F.col("kind") == _NODE)
    # Whole nodes below a crossing one meet it by partition, so no key holds more rows than a partition does.
    above = rows.join(nodes.select("hash", "depth", "conv_id"), ["hash", "depth"]).select(
        "part", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above")
    )
    below = inside.filter("side is not null").join(above, ["part", "side", "depth"]).withColumn("parent_conv_id", F.col("above"))
    return inside.filter("side is null").select(_COLUMNS).unionByName(below.select(_COLUMNS)).unionByName(crossing.select(_COLUMNS))


def prefix_trie(conversations: DataFrame, family: int | None = None, heads: int = 0) -> DataFrame:
    """One row for each distinct sequence of first turns, the empty one (root) included.

    conv_id: smallest member; depth; parent_conv_id: that of the parent (root: null); n_convs: members; n_children; n_leaves: childless
    nodes at or below it; saved_tokens: (members - 1) x code points of the last text, summed at or below it; ends_sha256: SHA-256
    of the ascending ids of the members that end here, comma-joined. See `turn_sequences` for `family` and `heads`.
    """
    return prefix_nodes(turn_sequences(conversations, family, heads))
