"""Clusters of sparse text vectors: average linkage on character n-grams, and their names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallbook.functions.text import clean_cluster_name
from stallbook.operators.clustering import NO_NAME
from stallbook.operators.components import connected_components
from stallbook.operators.linkage import LOCAL_POINTS, agglomerate
from stallbook.operators.similarity import sparse_cosine_pairs
from stallbook.scratch import stored


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _dense(at: pd.Series, w: pd.Series, dims: pd.Series) -> pd.Series:
    def one(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        out[places] = values
        return out

    return pd.Series([one(*row) for row in zip(at, w, dims, strict=True)])


def distinct_vectors(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sparse vectors (id, term, weight) of the smallest id of each, and for every id its representative with the number of copies."""
    entries = F.array_sort(F.collect_list(F.struct("term", "weight")))
    digests = weights.groupBy("id").agg(F.sha2(F.to_json(entries), 256).alias("digest"))
    same = Window.partitionBy("digest")
    members = stored(digests.select("id", F.min("id").over(same).alias("rep"), F.count("*").over(same).alias("copies")), "members")
    return weights.join(members.filter("id = rep").select("id"), "id", "left_semi"), members


def dense_in_components(weights: DataFrame, components: DataFrame) -> DataFrame:
    """id and unit (array) of component members: terms are numbered inside their component, whose vectors only ever meet each other."""
    placed = weights.join(components.select(F.col("node").alias("id"), "component"), "id")
    terms = placed.groupBy("component", "term").agg(F.lit(1).alias("one"))
    dim = (F.row_number().over(Window.partitionBy("component").orderBy("term")) - 1).alias("dim")
    numbered = terms.select("component", "term", dim, F.count("*").over(Window.partitionBy("component")).cast("int").alias("dims"))
    cells = placed.join(numbered, ["component", "term"])
    sparse = cells.groupBy("id").agg(F.collect_list("dim").alias("at"), F.collect_list("weight").alias("w"), F.max("dims").alias("dims"))
    return sparse.select("id", _dense("at", "w", "dims").alias("unit"))


def sparse_clusters(weights: DataFrame, threshold: float, local_points: int = LOCAL_POINTS) -> DataFrame:
    """id, cluster (smallest id in it): average linkage of sparse unit vectors (id, term, weight >= 0) under a cosine distance cut."""
    weights = stored(weights, "weights")
    single, members = distinct_vectors(weights)
    single = stored(single, "distinct")
    edges = stored(sparse_cosine_pairs(single, threshold), "edges")
    components = stored(connected_components(edges.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))), "components")
    copies = members.filter("id = rep").select("id", "copies")
    points = stored(dense_in_components(single, components).join(copies, "id"), "points")
    found = agglomerate(points, edges, threshold, "average", local_points).select(F.col("id").alias("rep"), "cluster")
    return members.join(found, "rep", "left").select("id", F.coalesce("cluster", "rep").alias("cluster"))


def sparse_cluster_names(clusters: DataFrame, weights: DataFrame, offered: DataFrame, product_weights: DataFrame) -> DataFrame:
    """cluster_id, cluster_name: the offered product (id, product) nearest to the mean vector of a cluster, word characters only.

    Only products at a cosine distance below 1 with a name left qualify; equal distances go to the smaller name.
    """
    real = clusters.filter(F.col("cluster_id") >= 0)
    # The cosine needs no division by the size of the cluster: a sum points where the mean does.
    sums = stored(real.join(weights, "id").groupBy("cluster_id", "term").agg(F.sum("weight").alias("total")), "cluster_sums")
    norms = sums.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("norm"))
    candidates = real.join(offered, "id").select("cluster_id", "product").distinct()
    dots = (
        candidates.join(product_weights, "product")
        .join(sums, ["cluster_id", "term"])
        .groupBy("cluster_id", "product")
        .agg(F.sum(F.col("weight") * F.col("total")).alias("dot"))
    )
    name = clean_cluster_name(F.col("product"))
    near = dots.join(norms, "cluster_id").select("cluster_id", F.round(1.0 - F.col("dot") / F.col("norm"), 9).alias("distance"), name.alias("name"))
    best = near.filter("distance < 1 AND name <> ''").groupBy("cluster_id").agg(F.min(F.struct("distance", "name"))["name"].alias("name"))
    return norms.select("cluster_id").join(best, "cluster_id", "left").select("cluster_id", F.coalesce("name", F.lit(NO_NAME)).alias("cluster_name"))
