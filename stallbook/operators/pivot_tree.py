"""A tree of pivots over unit vectors, and the pairs of leaves that can hold near points.

Every node keeps one point as its pivot and the least and the largest distance of its points to it. A node with more points than a leaf
holds picks up to FAN pivots among a reproducible sample of its points, far from each other, and each point goes to the
nearest. By the triangle inequality no point of node a is within `radius` of one of node b if the balls are that far apart, or
if the ball of one lies that deep in the hole of the other. Pairs of nodes are followed from the root down, so only
neighbours of neighbours are looked at; what remains is the schedule, a table of leaf pairs.

A leaf is packed into rows of a bounded number of values. Nothing but counts of open nodes reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallbook.functions.vectors import dot
from stallbook.scratch import cut_lineage, stored

#: Numbers in the vectors of one leaf, which is one packed block; bounds memory, not results.
LEAF_VALUES = 1 << 19
LEAST_ROWS = 256
#: Children of a node, and candidates for their pivots.
FAN, CANDIDATES = 16, 96
#: Points of one node that a task places at once.
PLACED_ROWS = 8192
SLACK = 1e-9


@dataclass
class PivotTree:
    """nodes: node, parent, pivot, low, high, n, leaf; points: id, unit, leaf."""

    nodes: DataFrame
    points: DataFrame
    rows: int
    #: The root is the only leaf.
    single: bool


def leaf_rows(dims: int) -> int:
    return max(LEAST_ROWS, LEAF_VALUES // max(dims, 1))


def _far_apart(node_type: str, id_column: str):
    """Up to FAN candidates of a node, each far from those before it."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", id_column])
        x = np.stack(pdf["unit"].to_numpy())
        chosen, reach = [0], 2.0 - 2.0 * (x @ x[0])
        while len(chosen) < min(FAN, len(x)):
            best = int(reach.argmax())
            if reach[best] <= SLACK:
                break
            chosen.append(best)
            reach = np.minimum(reach, 2.0 - 2.0 * (x @ x[best]))
        return pd.DataFrame({"node": pdf["node"].iloc[0], "child": range(len(chosen)), "pivot": list(x[chosen])})

    return pick


def _new_pivots(points: DataFrame, full: DataFrame) -> DataFrame:
    """node, child, pivot for every node of `full` (node, n)."""
    h = F.xxhash64("id", "node")
    share = (h.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("share")
    sample = points.join(full, "node").select("id", "node", "unit", "n", h.alias("h"), share).filter(F.col("share") * F.col("n") < CANDIDATES)
    return sample.groupBy("node").applyInPandas(_far_apart("node", "id"), "node string, child int, pivot array<double>")


def _placed(points: DataFrame, full: DataFrame, pivots: DataFrame, id_type: str) -> DataFrame:
    """Points of full nodes at their nearest new pivot: id, unit, node (of the child), away (distance to its pivot)."""
    parts = F.ceil(F.col("n") / PLACED_ROWS).cast("int")
    home = points.join(full, "node").select("id", "unit", "node", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    several = pivots.join(full, "node").select("node", "child", "pivot", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

    def place(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame()
        near = near.sort_values("child")
        x, p = np.stack(rows["unit"].to_numpy()), np.stack(near["pivot"].to_numpy())
        cosine = x @ p.T
        best = cosine.argmax(axis=1)
        away = np.sqrt(np.maximum(2.0 - 2.0 * cosine[np.arange(len(x)), best], 0.0))
        names = (rows["node"].iloc[0] + "/" + near["child"].astype(str)).to_numpy()
        return pd.DataFrame({"id": rows["id"].to_numpy(), "unit": rows["unit"].to_numpy(), "node": names[best], "away": away})

    key = ["node", "part"]
    return home.groupBy(*key).cogroup(several.groupBy(*key)).applyInPandas(place, f"id {id_type}, unit array<double>, node string, away double")


def build_tree(points: DataFrame) -> PivotTree | None:
    """Tree over unit vectors (id, unit); None for no points. A node that no pivot can part stays a leaf of many blocks."""
    points = points.select("id", "unit")
    id_type = points.schema["id"].dataType.simpleString()
    whole = points.agg(F.count("*").alias("n"), F.max(F.size("unit")).alias("dims"), F.min_by("unit", "id").alias("pivot")).first()
    if not whole["n"]:
        return None
    rows = leaf_rows(whole["dims"])
    spark = points.sparkSession
    schema = "node string, parent string, pivot array<double>, low double, high double, n long, leaf boolean"
    # Unit vectors are at most 2 apart, so the root needs no pass over its points.
    root = spark.createDataFrame([("", None, list(whole["pivot"]), 0.0, 2.0, whole["n"], whole["n"] <= rows)], schema)
    levels, done = [root], []
    active = points.withColumn("node", F.lit(""))
    full, n_full = root.filter("NOT leaf").select("node", "n"), int(whole["n"] > rows)
    if not n_full:
        done.append(active)
    while n_full:
        pivots = stored(_new_pivots(active, full), "pivots")
        moved = cut_lineage(_placed(active, full, pivots, id_type))
        child = pivots.select(F.concat("node", F.lit("/"), "child").alias("node"), F.col("node").alias("parent"), "pivot")
        sizes = moved.groupBy("node").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n"))
        above = full.select(F.col("node").alias("parent"), F.col("n").alias("n_above"))
        # A child as large as its parent was not parted: it holds points that no pivot tells apart.
        leaf = (F.col("n") <= rows) | (F.col("n") == F.col("n_above"))
        level = stored(child.join(sizes, "node").join(above, "parent").select("node", "parent", "pivot", "low", "high", "n", leaf.alias("leaf")), "level")
        levels.append(level)
        ended = level.filter("leaf").select("node")
        done.append(moved.join(ended, "node", "left_semi").select("id", "unit", "node"))
        active, full = moved.select("id", "unit", "node"), level.filter("NOT leaf").select("node", "n")
        n_full = full.count()
    nodes, leaves = levels[0], done[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    for part in done[1:]:
        leaves = leaves.unionByName(part)
    return PivotTree(nodes, leaves.withColumnRenamed("node", "leaf"), rows, len(levels) == 1)


def _meets(radius: float) -> Column:
    """Whether points of two nodes can be within `radius`: their balls meet, and neither lies in the hole of the other."""
    apart = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot(F.col("a.pivot"), F.col("b.pivot"))))
    near = apart <= F.col("a.high") + F.col("b.high") + radius + SLACK
    hole = lambda x, y: apart + F.col(f"{x}.high") + radius + SLACK >= F.col(f"{y}.low")
    return near & hole("a", "b") & hole("b", "a")


def leaf_pairs(tree: PivotTree, radius: float) -> DataFrame:
    """Schedule of unordered leaf pairs (a <= b) that can hold points within `radius`, found level by level."""
    down = tree.nodes.filter("parent is not null").select("parent", F.struct("node", "pivot", "low", "high", "leaf").alias("s"))
    root = F.struct("node", "pivot", "low", "high", "leaf")
    pairs = tree.nodes.filter("parent is null").select(root.alias("a"), root.alias("b"))
    found, open_ = [], pairs
    while True:
        ready = F.col("a.leaf") & F.col("b.leaf")
        found.append(open_.filter(ready).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
        open_ = open_.filter(~ready)
        if open_.isEmpty():
            break
        # A node that is a leaf stays; the other one is replaced by its children.
        for side in ("a", "b"):
            children = down.select(F.col("parent").alias("at"), F.col("s").alias("next"))
            inner = open_.withColumn("pair", F.col("a.node") == F.col("b.node")) if side == "a" else open_
            inner = inner.withColumn("at", F.when(~F.col(f"{side}.leaf"), F.col(f"{side}.node")))
            kept = inner.filter("at is null").drop("at")
            grown = inner.join(children, "at").withColumn(side, F.col("next")).drop("at", "next")
            open_ = kept.unionByName(grown)
        once = ~F.col("pair") | (F.col("a.node") <= F.col("b.node"))
        open_ = cut_lineage(open_.filter(once).filter(_meets(radius)).select("a", "b"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def packed(tree: PivotTree) -> DataFrame:
    """leaf, block, ids, n, data: the vectors of a leaf as little-endian doubles, one row for each block."""
    sizes = tree.nodes.filter("leaf").select(F.col("node").alias("leaf"), F.ceil(F.col("n") / tree.rows).cast("int").alias("blocks"))
    cut = tree.points.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "unit")
    id_type = tree.points.schema["id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        data = np.stack(pdf["unit"].to_numpy()).astype("<f8").tobytes()
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy()], "n": [len(pdf)], "data": [data]})

    return cut.groupBy("leaf", "block").applyInPandas(pack, f"leaf string, block int, ids array<{id_type}>, n int, data binary")


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(n, -1)


def visits(tree: PivotTree, blocks: DataFrame, radius: float) -> DataFrame:
    """Blocks on their way to other leaves: at (leaf), from (leaf), block, whole, ids, n, data.

    Of a visiting block only points remain that lie within `radius` of the ball of the leaf and not deep in its hole.
    """
    id_type = tree.points.schema["id"].dataType.simpleString()
    ball = tree.nodes.select(F.col("node").alias("a"), "pivot", "low", "high")
    coming = leaf_pairs(tree, radius).filter("a <> b").join(ball, "a").join(blocks.withColumnRenamed("leaf", "b"), "b")

    def narrow(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = unpacked(row.data, row.n)
                away = np.sqrt(np.maximum(2.0 - 2.0 * (x @ np.asarray(row.pivot)), 0.0))
                keep = np.flatnonzero((away <= row.high + radius + SLACK) & (away >= row.low - radius - SLACK))
                if len(keep):
                    yield pd.DataFrame({"at": [row.a], "from": [row.b], "block": [row.block], "ids": [np.asarray(row.ids)[keep]], "n": [len(keep)], "data": [x[keep].tobytes()]})

    schema = f"at string, from string, block int, ids array<{id_type}>, n int, data binary"
    return coming.select("a", "b", "pivot", "low", "high", "block", "ids", "n", "data").mapInPandas(narrow, schema)
