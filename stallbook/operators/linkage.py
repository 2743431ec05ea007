"""Agglomerative clustering with a distance cut, exact and without a full distance matrix.

Only clusters joined by an edge (a pair of points nearer than the cut) can ever merge, so the connected components of the edge
graph are clustered on their own. A component that fits a task is finished by a nearest-neighbour chain in O(n^2). A larger one goes
through rounds in which all mutually nearest clusters merge at once, and is handed to the chain as soon as its clusters fit.
A round looks again only at clusters that merged or whose nearest one did, and finds their nearest clusters block by block from
the vectors; no table of pairs is kept, as pairs of a component grow with the square of its points.

Both ways see the same distances: vectors are whole multiples of 2^-SCALE, so sums and products are exact whole numbers in any order,
and a mean is the same quotient everywhere. Equal distances follow the names of the two clusters. The name is the greatest
of the points' keys (hash, id), so a merged pair never comes before both pairs it stems from. With this order average and complete
linkage are reducible, and every order of merging mutually nearest clusters gives one partition. Hashed names also keep rows of
equal distances from merging one by one.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.operators.components import connected_components
from stallbook.scratch import cut_lineage, stored

#: Largest number of clusters of a component that one task holds as a matrix.
LOCAL_POINTS = 1024
#: Bits of a coordinate, and further bits of a mean.
SCALE, MEAN = 24, 20
#: Bits of a limb: products of two, summed over 2^12 dimensions, are exact in double precision.
_LIMB = 20
#: Numbers in a block of clusters, and rows of one product; bound memory, not results. Points of the clusters that one task finishes.
BLOCK_VALUES, PRODUCT_ROWS, MOST_POINTS = 1 << 20, 512, 1 << 14


def _least_similarity(threshold: float) -> int:
    """Similarities above this whole number are nearer than the threshold."""
    return math.floor((1 - Fraction(threshold)) * (1 << (2 * SCALE + MEAN)))


def exact_products(totals: list[list[int]]) -> np.ndarray:
    """All products of whole-number vectors as Python integers."""
    rest = np.array(totals, np.int64)
    limbs = []
    while True:
        low = rest & ((1 << _LIMB) - 1)
        if (np.abs(rest) < 1 << _LIMB).all():
            limbs.append(rest.astype(np.float64))
            break
        limbs.append(low.astype(np.float64))
        rest = rest >> _LIMB
    out = np.zeros((len(rest), len(rest)), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a @ b.T).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return out


def nearest_neighbour_chain(similar: np.ndarray, weight: list[int] | None, bound: int) -> np.ndarray:
    """Group of each cluster. similar: summed (with `weight`: average linkage) or least (complete linkage) similarity of two clusters.

    Rows stand in the order of the clusters' names. The chain follows nearest neighbours until two are each other's nearest; a cluster
    without a neighbour above `bound` is final, since no merge brings another one nearer.
    """
    n = len(similar)
    similar = similar.copy()
    close = similar.astype(np.float64)
    weights = np.array(weight if weight is not None else [1] * n, object)
    shown = weights.astype(np.float64)
    group, alive = np.arange(n), np.ones(n, bool)
    slack = float(1 << 2 * SCALE) * 1e-12

    def exact(i: int, j: int) -> int:
        return (similar[i, j] << MEAN) // (weights[i] * weights[j]) if weight is not None else similar[i, j] << MEAN

    def nearest(i: int) -> tuple[int, int]:
        """Nearest cluster and its similarity: the first in the order of pairs among equals."""
        means = np.where(alive, close[i] / (shown * shown[i]) if weight is not None else close[i], -np.inf)
        means[i] = -np.inf
        ties = np.flatnonzero(means >= means.max() - slack - abs(means.max()) * 1e-14)
        return min(((int(j), exact(i, j)) for j in ties if j != i and alive[j]), key=lambda x: (-x[1], min(i, x[0]), max(i, x[0])))

    chain: list[int] = []
    for start in range(n):
        while alive[start] and alive.sum() > 1:
            if not chain:
                chain.append(start)
            top = chain[-1]
            other, value = nearest(top)
            if value <= bound:
                alive[top] = False
                chain.pop()
            elif len(chain) > 1 and other == chain[-2]:
                del chain[-2:]
                low, high = min(top, other), max(top, other)
                if weight is not None:
                    merged = similar[low] + similar[high]
                    weights[high] += weights[low]
                    shown[high] = float(weights[high])
                else:
                    merged = np.minimum(similar[low], similar[high])
                similar[high], similar[:, high] = merged, merged
                close[high] = close[:, high] = merged.astype(np.float64)
                group[group == low] = high
                alive[low] = False
            else:
                chain.append(other)
    return group


def _starts(names: list) -> np.ndarray:
    """First places of the runs of equal names."""
    return np.array([i for i, name in enumerate(names) if not i or name != names[i - 1]], np.int64)


def _least_similarities(a: np.ndarray, b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> np.ndarray:
    """Least product of a point of one run of `a` and one of a run of `b`; whole numbers that double precision holds."""
    return np.minimum.reduceat(np.minimum.reduceat(a @ b.T, starts_a, axis=0), starts_b, axis=1)


def _finished(clusters: DataFrame, members: DataFrame | None, linkage: str, threshold: float) -> DataFrame:
    """Merges (u, v) of components that fit a task. `members` (component, cluster, point) are needed for complete linkage of clusters of more than one point."""
    id_type = clusters.schema["cluster"].dataType.simpleString()
    bound = _least_similarity(threshold)

    def solve(rows: pd.DataFrame, known: pd.DataFrame | None) -> pd.DataFrame:
        rows = rows.sort_values(["h", "cluster"])
        names = rows["cluster"].tolist()
        totals, n = [[int(x) for x in t] for t in rows["total"]], [int(x) for x in rows["n"]]
        if linkage == "average":
            group = nearest_neighbour_chain(exact_products(totals), n, bound)
        else:
            if known is None:
                least = exact_products([[x // k for x in t] for t, k in zip(totals, n)]).astype(np.int64)
            else:
                place = {name: i for i, name in enumerate(names)}
                known = known.assign(at=known["cluster"].map(place)).sort_values("at", kind="stable")
                x, at = np.stack(known["point"].to_numpy()).astype(np.float64), known["at"].tolist()
                starts = _starts(at)
                least = np.empty((len(names), len(names)))
                # Rows of the matrix come in runs of clusters, so that a product has a bounded number of rows.
                ends, low = [*starts[1:].tolist(), len(x)], 0
                while low < len(starts):
                    high = max(low + 1, int(np.searchsorted(ends, starts[low] + PRODUCT_ROWS, "right")))
                    least[low:high] = _least_similarities(x[starts[low] : ends[high - 1]], x, starts[low:high] - starts[low], starts)
                    low = high
                least = least.astype(np.int64)
            group = nearest_neighbour_chain(least.astype(object), None, bound)
        return pd.DataFrame({"u": names, "v": [names[g] for g in group]})

    schema = f"u {id_type}, v {id_type}"
    columns = ["component", "cluster", "h", "total", "n"]
    if members is None:
        return clusters.select(columns).groupBy("component").applyInPandas(lambda rows: solve(rows, None), schema)
    both = clusters.select(columns).groupBy("component").cogroup(members.select("component", "cluster", "point").groupBy("component"))
    return both.applyInPandas(lambda rows, known: solve(rows, known) if len(rows) else pd.DataFrame({"u": [], "v": []}), schema)


class _Side:
    """Clusters of a batch in the order of their names: totals and weights (average linkage), or the points of each (complete linkage)."""

    def __init__(self, rows: pd.DataFrame, linkage: str):
        rows = rows.sort_values(["h", "cluster"], kind="stable")
        self.starts = _starts(rows["cluster"].tolist())
        first = rows.iloc[self.starts]
        self.names, self.h, self.n = first["cluster"].tolist(), first["h"].tolist(), [int(x) for x in first["n"]]
        self.whole = rows["vector"].to_numpy()
        self.x = np.stack(self.whole).astype(np.float64)
        self.shown = np.array(self.n, np.float64)
        self.average = linkage == "average"

    def similar(self, other: "_Side", low: int, high: int) -> np.ndarray:
        """Similarity of the clusters low to high - 1 and each of the other side: exact for complete, to rounding for average linkage."""
        if self.average:
            return (self.x[low:high] @ other.x.T) / (self.shown[low:high, None] * other.shown)
        ends = [*self.starts[1:].tolist(), len(self.x)]
        part = self.x[self.starts[low] : ends[high - 1]]
        return _least_similarities(part, other.x, self.starts[low:high] - self.starts[low], other.starts)

    def exact(self, i: int, other: "_Side", j: int, value: float) -> int:
        if not self.average:
            return int(value) << MEAN
        return (sum(x * y for x, y in zip(self.whole[i].tolist(), other.whole[j].tolist(), strict=True)) << MEAN) // (self.n[i] * other.n[j])


def _nearest_in(mine: pd.DataFrame, others: pd.DataFrame, linkage: str, bound: int) -> pd.DataFrame:
    """For clusters of one block the nearest one of another block: a, far (minus the similarity), low, h_low, high, h_high. None beyond the bound."""
    here, there = _Side(mine, linkage), _Side(others, linkage)
    slack = float(1 << 2 * SCALE) * 1e-12
    order = list(zip(there.h, there.names))
    place = {name: i for i, name in enumerate(there.names)}
    out = []
    ends = np.append(here.starts[1:], len(here.x))
    low = 0
    while low < len(here.names):
        high = max(low + 1, int(np.searchsorted(ends, here.starts[low] + PRODUCT_ROWS, "right")))
        similar = here.similar(there, low, high)
        for i in range(low, high):
            if here.names[i] in place:
                similar[i - low, place[here.names[i]]] = -np.inf
        best = similar.max(axis=1)
        for i in np.flatnonzero(best >= bound / (1 << MEAN) - slack).tolist():
            at = i + low
            own = (here.h[at], here.names[at])
            ties = np.flatnonzero(similar[i] >= best[i] - (slack + abs(best[i]) * 1e-14 if here.average else 0.0))
            key = min((-here.exact(at, there, j, similar[i, j]), min(own, order[j]), max(own, order[j])) for j in ties.tolist())
            if -key[0] > bound:
                out.append((own[1], Decimal(key[0]), key[1][0], key[1][1], key[2][0], key[2][1]))
        low = high
    return pd.DataFrame(out, columns=["a", "far", "h_low", "low", "h_high", "high"])


def _nearest(clusters: DataFrame, members: DataFrame | None, frontier: DataFrame, linkage: str, threshold: float) -> DataFrame:
    """a, best (far, h_low, low, h_high, high): the nearest cluster of each cluster of the frontier, if it is nearer than the threshold.

    Clusters of a component are dealt to blocks; a task holds a block of the frontier and a block of all clusters.
    """
    vectors = clusters.select("component", "cluster", "h", "n", F.col("total").alias("vector"))
    if members is not None:
        vectors = clusters.select("component", "cluster", "h", "n").join(members.select("cluster", F.col("point").alias("vector")), "cluster")
    looking = vectors.join(frontier.select(F.col("a").alias("cluster")), "cluster", "left_semi")
    # Blocks on either side: as few as keep a task small, so that a vector travels to few of them.
    parts = lambda df, name: df.groupBy("component").agg(F.ceil(F.sum(F.size("vector")) / BLOCK_VALUES).cast("int").alias(name))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    blocks = stored(parts(looking, "n_mine").join(parts(vectors, "n_others"), "component"), "blocks")
    at = lambda n, name: F.pmod(F.xxhash64("cluster"), F.col(n)).cast("int").alias(name)
    columns = ["component", "cluster", "h", "n", "vector"]
    mine = looking.join(blocks, "component").select(*columns, at("n_mine", "i"), every("n_others", "j"))
    # Names of its own for the other side, since both stem from one table.
    others = vectors.join(blocks, "component").select(*(F.col(c).alias(c) for c in columns), at("n_others", "j"), every("n_mine", "i"))
    id_type = clusters.schema["cluster"].dataType.simpleString()
    bound = _least_similarity(threshold)
    none = pd.DataFrame({c: [] for c in ("a", "far", "h_low", "low", "h_high", "high")})
    key = ["component", "i", "j"]
    found = mine.groupBy(*key).cogroup(others.groupBy(*key)).applyInPandas(
        lambda a, b: _nearest_in(a, b, linkage, bound) if len(a) and len(b) else none,
        f"a {id_type}, far decimal(38,0), h_low long, low {id_type}, h_high long, high {id_type}",
    )
    return found.groupBy("a").agg(F.min(F.struct("far", "h_low", "low", "h_high", "high")).alias("best"))


def _by_rounds(clusters: DataFrame, linkage: str, threshold: float, local_points: int) -> tuple[list[DataFrame], int]:
    """Merges (u, v) of components too large for a task, and the number of rounds."""
    clusters = stored(clusters, "clusters")
    members = None
    if linkage == "complete":
        # Clusters still are single points: a total divided by its copies is the point.
        point = F.transform("total", lambda x: F.try_divide(x, F.col("n")).cast("long"))
        members = stored(clusters.select("component", "cluster", point.alias("point")), "members")
    frontier, nearest = clusters.select(F.col("cluster").alias("a")), None
    merges, rounds = [], 0
    while True:
        # Components whose clusters and points fit a task leave for the chain.
        sizes = clusters.groupBy("component").agg(F.count("*").alias("size"), F.sum("points").alias("points"))
        few = F.col("size") <= local_points if linkage == "average" else (F.col("size") <= local_points) & (F.col("points") <= MOST_POINTS)
        fit = stored(sizes.filter(few).select("component"), "fit")
        if not fit.isEmpty():
            ready = clusters.join(fit, "component", "left_semi")
            known = members.join(fit, "component", "left_semi") if members is not None else None
            merges.append(cut_lineage(_finished(ready, known, linkage, threshold).filter("u <> v")))
            clusters = cut_lineage(clusters.join(fit, "component", "left_anti"))
            if members is not None:
                members = cut_lineage(members.join(fit, "component", "left_anti"))
            if clusters.isEmpty():
                return merges, rounds
        fresh = _nearest(clusters, members, frontier, linkage, threshold)
        if nearest is not None:
            fresh = nearest.join(clusters.select(F.col("cluster").alias("a")), "a", "left_semi").unionByName(fresh)
        nearest = cut_lineage(fresh)
        chosen = nearest.groupBy("best").agg(F.count("*").alias("votes")).filter("votes = 2")
        # The greater name stays.
        step = cut_lineage(chosen.select(F.col("best.low").alias("gone"), F.col("best.high").alias("into")))
        if step.isEmpty():
            return merges, rounds
        rounds += 1
        merges.append(step.select(F.col("gone").alias("u"), F.col("into").alias("v")))
        took = clusters.join(step.select(F.col("gone").alias("cluster"), "into"), "cluster").select(
            F.col("into").alias("cluster"), F.col("total").alias("t2"), F.col("n").alias("n2"), F.col("points").alias("p2")
        )
        clusters = cut_lineage(
            clusters.join(step.select(F.col("gone").alias("cluster")), "cluster", "left_anti")
            .join(took, "cluster", "left")
            .select(
                "component", "cluster", "h",
                F.when(F.col("t2").isNull(), F.col("total")).otherwise(F.zip_with("total", "t2", lambda x, y: x + y)).alias("total"),
                (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
                (F.col("points") + F.coalesce("p2", F.lit(0))).alias("points"),
            )
        )
        if members is not None:
            moved = members.join(step.select(F.col("gone").alias("cluster"), "into"), "cluster", "left")
            members = cut_lineage(moved.select("component", F.coalesce("into", "cluster").alias("cluster"), "point"))
        # Whoever merged, or was nearest to one that did, looks again; all others keep their nearest cluster.
        names = step.select(F.explode(F.array("gone", "into")).alias("c"))
        lost = nearest.select("a", F.explode(F.array("best.low", "best.high")).alias("c")).join(names, "c", "left_semi").select("a").distinct()
        gone = step.select(F.col("gone").alias("a"))
        frontier = stored(lost.union(step.select("into")).distinct().join(gone, "a", "left_anti"), "frontier")
        nearest = nearest.join(frontier, "a", "left_anti").join(gone, "a", "left_anti")


def merge_rounds(points: DataFrame, edges: DataFrame, threshold: float, linkage: str, local_points: int) -> tuple[DataFrame, int]:
    """Merges (u, v) of average or complete linkage and the number of rounds that large components took.

    Of `edges` only their connected components matter.
    """
    components = connected_components(edges.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    copies = F.col("copies").cast("long")
    whole = F.transform("unit", lambda x: F.rint(x * float(1 << SCALE)).cast("long") * F.col("copies").cast("long"))
    placed = components.withColumnRenamed("node", "id").join(sizes, "component").join(points, "id")
    clusters = stored(
        placed.select("component", "size", F.col("id").alias("cluster"), F.xxhash64("id").alias("h"), whole.alias("total"), copies.alias("n"), F.lit(1).cast("long").alias("points")),
        "components",
    )
    large = clusters.filter(F.col("size") > local_points).drop("size")
    merges, rounds = [_finished(clusters.filter(F.col("size") <= local_points), None, linkage, threshold).filter("u <> v")], 0
    if not large.isEmpty():
        more, rounds = _by_rounds(large, linkage, threshold, local_points)
        merges += more
    out = merges[0]
    for part in merges[1:]:
        out = out.unionByName(part)
    return out, rounds


def agglomerate(
    points: DataFrame, edges: DataFrame, threshold: float, linkage: str = "average", local_points: int = LOCAL_POINTS
) -> DataFrame:
    """id, cluster (smallest id in it) for unit vectors `points` (id, unit, copies).

    `edges` (id_a, id_b) connect the same points as all pairs nearer than `threshold` do. Points without an edge stay alone.
    """
    merges = edges.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    if linkage != "single":
        merges, _ = merge_rounds(points, edges, threshold, linkage, local_points)
    found = connected_components(merges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    alone = points.join(found, "id", "left_anti").select("id", F.col("id").alias("cluster"))
    return found.unionByName(alone)
