"""Exact similarity joins: all pairs of vectors within a cosine distance.

Dense vectors lie in the leaves of a pivot tree and are compared leaf by leaf; pairs of leaves that can hold no neighbour are left
out, which depends on the data: vectors without any grouping are all compared. The blocks of the leaves are dealt to homes, and a task
compares two homes: a block travels once to each home it may have a neighbour in, so no vector is copied more often than there are homes.
Sparse vectors meet on their rare terms only.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallbook.functions.vectors import doubles, is_zero, unit
from stallbook.operators.pivot_tree import SLACK, build_tree, leaf_pairs, packed, unpacked, visits
from stallbook.scratch import stored

# Homes that vectors are dealt to, which is how many tasks a vector visits at most, and numbers in the vectors of one home: few homes keep
# copies few, the bounds keep tasks small and busy.
VISITS, HOME_VALUES, LEAST_HOME_VALUES = 16, 1 << 22, 1 << 17
# Visitors in one product, and pairs that leave a task at once; a product has no more than twice as many, also where all are copies.
PRODUCT_ROWS, PAIR_ROWS = 1024, 1 << 19
# Vectors that share a term, on either side of one join key.
TERM_ROWS = 1024
_SLACK = 1e-9


def distinct_directions(vectors: DataFrame, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Equal unit vectors once, with the smallest id and the number of copies; and each row's representative.

    With `bits`, vectors are equal whose coordinates round to the same multiples of 2^-bits: copies whose sums were added in another order.
    """
    units = vectors.select("id", unit(doubles(F.col("vector"))).alias("unit"))
    if bits is not None:
        units = units.withColumn("same", F.transform("unit", lambda x: F.rint(x * float(1 << bits)).cast("long")))
        units = units.withColumn("h", F.xxhash64("same"))
        points = units.groupBy("h", "same").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min_by("unit", "id").alias("unit"))
        members = units.join(points.select("h", "same", "rep"), ["h", "same"]).select("id", "rep")
        return points.select(F.col("rep").alias("id"), "unit", "copies"), members
    units = units.withColumn("h", F.xxhash64("unit"))
    points = units.groupBy("h", "unit").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = units.join(points.select("h", "unit", "rep"), ["h", "unit"]).select("id", "rep")
    return points.select(F.col("rep").alias("id"), "unit", "copies"), members


def all_vectors(vectors: DataFrame) -> DataFrame:
    """Every row with an id and a vector that has a direction as a point of its own (id, unit): copies are near each other too."""
    given = vectors.select("id", doubles(F.col("vector")).alias("vector")).filter(F.col("id").isNotNull() & ~is_zero(F.col("vector")))
    return given.select("id", unit(F.col("vector")).alias("unit"))


def copy_links(vectors: DataFrame, points: DataFrame) -> DataFrame:
    """Edges u, v from each copy among (id, vector) to its point of `distinct_directions`, which is near it at any threshold; zero vectors have none."""
    h = F.xxhash64("unit").alias("h")
    several = points.filter((F.col("copies") > 1) & ~is_zero(F.col("unit"))).select(h, "unit", F.col("id").alias("rep"))
    copies = all_vectors(vectors).select("id", "unit", h).join(several, ["h", "unit"]).filter("id <> rep")
    return copies.select(F.col("id").alias("u"), F.col("rep").alias("v"))


def _meetings(points: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """Packed blocks of all leaves, and the blocks that come to each leaf, its own included: leaf, own, block, ids, n, data."""
    tree = build_tree(points)
    if tree is None:
        return None
    blocks = stored(packed(tree), "blocks")
    if tree.single:
        return blocks, blocks.select(*(F.col(c).alias(c) for c in blocks.columns), F.lit(True).alias("own"))
    coming = visits(tree, blocks, math.sqrt(2.0 * threshold)).select(F.col("at").alias("leaf"), F.lit(False).alias("own"), "block", "ids", "n", "data")
    at_home = blocks.select("leaf", F.lit(True).alias("own"), "block", "ids", "n", "data")
    guests = stored(coming.unionByName(at_home), "visits")
    return blocks, guests


def n_homes(values: int) -> int:
    """Homes for so many numbers: VISITS of them unless they would be too small or too large."""
    return max(1, min(VISITS, -(-values // LEAST_HOME_VALUES)), -(-values // HOME_VALUES))


def _home_pair(low: Column, high: Column) -> Column:
    """Number of an unordered pair of homes (low <= high)."""
    return (high * (high + 1) / 2 + low).cast("int")


def _met_homes(points: DataFrame, threshold: float) -> tuple[DataFrame, int] | None:
    """Blocks on their way to each pair of homes they may have a neighbour in, a partition for each pair; and the number of homes."""
    tree = build_tree(points)
    if tree is None:
        return None
    blocks = stored(packed(tree), "blocks")
    homes = n_homes(blocks.agg(F.sum(F.length("data"))).first()[0] // 8)
    at = blocks.select("leaf", "block", F.pmod(F.xxhash64("leaf", "block"), F.lit(homes)).cast("int").alias("home"))
    at = stored(at, "homes")
    side = lambda x: at.groupBy("leaf", "home").agg(F.collect_list("block").alias("blocks")).select(F.col("leaf").alias(x), F.col("home").alias(f"home_{x}"), F.col("blocks").alias(f"blocks_{x}"))
    meets = leaf_pairs(tree, math.sqrt(2.0 * threshold)).join(side("a"), "a").join(side("b"), "b")
    pair = _home_pair(F.least("home_a", "home_b"), F.greatest("home_a", "home_b")).alias("pair")
    sent = lambda x: meets.select(pair, F.col(x).alias("leaf"), F.col(f"home_{x}").alias("home"), F.explode(f"blocks_{x}").alias("block"))
    tasks = sent("a").union(sent("b")).distinct()
    ball = tree.nodes.filter("leaf").select(F.col("node").alias("leaf"), "pivot", "low", "high")
    coming = tasks.join(ball, "leaf").join(blocks, ["leaf", "block"])
    return coming.repartitionById(homes * (homes + 1) // 2, "pair").drop("pair"), homes


class _Block:
    """A block of a leaf as it comes to a task, and the ball of its leaf."""

    def __init__(self, row):
        self.home, self.name = row.home, (row.leaf, row.block)
        self.pivot, self.low, self.high = np.asarray(row.pivot), row.low, row.high
        self.ids, self.x = np.asarray(row.ids), unpacked(row.data, row.n)

    def may_meet(self, other: "_Block", radius: float) -> bool:
        """Whether the balls meet, and neither lies in the hole of the other."""
        apart = math.sqrt(max(0.0, 2.0 - 2.0 * float(self.pivot @ other.pivot)))
        hole = apart + self.high + radius + SLACK >= other.low and apart + other.high + radius + SLACK >= self.low
        return hole and apart <= self.high + other.high + radius + SLACK

    def visitors(self, other: "_Block", radius: float) -> np.ndarray:
        """Places of the other block's points that lie within `radius` of this ball and not deep in its hole."""
        away = np.sqrt(np.maximum(2.0 - 2.0 * (other.x @ self.pivot), 0.0))
        return np.flatnonzero((away <= self.high + radius + SLACK) & (away >= self.low - radius - SLACK))


def _neighbours(rows: list[_Block], threshold: float, inclusive: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Near pairs of the blocks of two homes, or of one: numbers of two blocks, places in them, distances."""
    radius = math.sqrt(2.0 * threshold)
    one_home = bool(rows) and rows[0].home == rows[-1].home
    for first in range(len(rows)):
        for second in range(first, len(rows)):
            # The leaf of the smaller name is visited; blocks of one home meet in the task of that home.
            i, j = sorted((first, second), key=lambda n: rows[n].name)
            here, there = rows[i], rows[j]
            if (here.home == there.home) != one_home or not here.may_meet(there, radius):
                continue
            same, one_leaf = i == j, here.name[0] == there.name[0]
            visitors = np.arange(len(there.x)) if one_leaf else here.visitors(there, radius)
            step = max(1, min(PRODUCT_ROWS, 2 * PAIR_ROWS // max(len(here.x), 1)))
            for at in range(0, len(visitors), step):
                places = visitors[at : at + step]
                cosine = there.x[places] @ here.x.T
                v, h = np.nonzero(cosine >= 1.0 - threshold - SLACK)
                distance = 1.0 - cosine[v, h]
                keep = distance <= threshold if inclusive else distance < threshold
                if same:
                    keep &= h < places[v]
                if keep.any():
                    yield i, j, h[keep], places[v[keep]], distance[keep]


def _blocks(batches: Iterator[pd.DataFrame]) -> list[_Block]:
    """The blocks of a task in the order of their homes and leaves."""
    return sorted((_Block(row) for batch in batches for row in batch.itertuples(index=False)), key=lambda r: (r.home, r.name))


def cosine_pairs(points: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """All pairs id_a < id_b of unit vectors (id, unit) with cosine distance below `threshold`; equal vectors are near each other.

    A task holds the blocks of two homes, and its pairs leave it in parts of bounded size.
    """
    id_type = points.schema["id"].dataType.simpleString()
    schema = f"id_a {id_type}, id_b {id_type}, distance double"
    met = _met_homes(points, threshold)
    if met is None:
        return points.sparkSession.createDataFrame([], schema)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, out, size = _blocks(batches), [], 0
        for i, j, h, v, distance in _neighbours(rows, threshold, inclusive):
            a, b = rows[i].ids[h], rows[j].ids[v]
            out.append(pd.DataFrame({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b), "distance": np.maximum(distance, 0.0)}))
            size += len(a)
            if size >= PAIR_ROWS:
                yield pd.concat(out)
                out, size = [], 0
        if out:
            yield pd.concat(out)

    return met[0].mapInPandas(compare, schema).filter("id_a < id_b")


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place of each place's group after the groups of a[i] and b[i] are united; `root` points straight to it."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def cosine_links(points: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """Edges u, v with the connected components of `cosine_pairs`, and no more of them than points in every task.

    The pairs themselves grow with the square of the points; here they are united inside the task that finds them.
    """
    id_type = points.schema["id"].dataType.simpleString()
    schema = f"u {id_type}, v {id_type}"
    met = _met_homes(points, threshold)
    if met is None:
        return points.sparkSession.createDataFrame([], schema)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _blocks(batches)
        if not rows:
            return
        begin = np.cumsum([0, *(len(r.x) for r in rows)])
        root = np.arange(begin[-1])
        for i, j, h, v, _ in _neighbours(rows, threshold, inclusive):
            root = _united(root, begin[i] + h, begin[j] + v)
        ids = np.concatenate([r.ids for r in rows])
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            yield pd.DataFrame({"u": ids[moved], "v": ids[root[moved]]})

    return met[0].mapInPandas(link, schema)


def compared_pairs(points: DataFrame, threshold: float) -> DataFrame:
    """One row of work that `cosine_pairs` does: n_points, n_leaves, n_meetings (of blocks), n_compared (pairs of vectors)."""
    met = _meetings(points, threshold)
    if met is None:
        return points.agg(*(F.lit(0).cast("long").alias(c) for c in ("n_points", "n_leaves", "n_meetings", "n_compared")))
    blocks, guests = met
    homes = blocks.groupBy("leaf").agg(F.collect_list(F.struct(F.col("block").alias("home"), F.col("n").alias("n_home"))).alias("homes"))
    meetings = guests.select("leaf", "own", "block", "n").join(homes, "leaf").select("*", F.inline("homes")).filter("NOT own OR block <= home")
    pairs = F.when(F.col("own") & (F.col("block") == F.col("home")), F.col("n").cast("long") * (F.col("n") - 1) / 2).otherwise(F.col("n").cast("long") * F.col("n_home"))
    work = meetings.agg(F.count("*").alias("n_meetings"), F.coalesce(F.sum(pairs), F.lit(0.0)).cast("long").alias("n_compared"))
    size = blocks.agg(F.sum("n").alias("n_points"), F.countDistinct("leaf").alias("n_leaves"))
    return size.join(work, how="cross").select("n_points", "n_leaves", "n_meetings", "n_compared")


def sparse_cosine_pairs(weights: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sparse unit vectors (id, term, weight >= 0) with cosine distance below `threshold`.

    Terms are ranked from rare to frequent. A vector's prefix is what must be read until the rest has a norm
    below the wanted similarity; two vectors that are similar enough share a prefix term, so only the rare
    terms meet in a join. The candidates are then scored on all their terms.
    """
    wanted = 1.0 - threshold
    df = weights.groupBy("term").agg(F.count("*").alias("df"))
    ranked = weights.join(df, "term")
    # Sum of squares from the most frequent term down to this one: the norm of the rest, this term included.
    rest = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = ranked.withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(rest)).filter(
        F.col("rest") >= wanted * wanted - _SLACK
    )
    # The vectors of a frequent term are cut into blocks, and each pair of blocks is a join key of its own.
    sides = stored(prefix.select("id", "term"), "prefixes")
    blocks = sides.groupBy("term").agg(F.ceil(F.count("*") / TERM_ROWS).cast("int").alias("blocks"))
    cut = sides.join(blocks, "term").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = cut.select("term", F.col("id").alias("id_a"), F.col("block").alias("block_a"), every.alias("block_b"))
    second = cut.select("term", F.col("id").alias("id_b"), F.col("block").alias("block_b"), every.alias("block_a"))
    candidates = first.join(second, ["term", "block_a", "block_b"]).filter("id_a < id_b").select("id_a", "id_b").distinct()
    a = weights.select(F.col("id").alias("id_a"), "term", F.col("weight").alias("w_a"))
    b = weights.select(F.col("id").alias("id_b"), "term", F.col("weight").alias("w_b"))
    return (
        candidates.join(a, "id_a")
        .join(b, ["id_b", "term"])
        .groupBy("id_a", "id_b")
        .agg((1.0 - F.sum(F.col("w_a") * F.col("w_b"))).alias("distance"))
        .filter(F.col("distance") < threshold)
    )
