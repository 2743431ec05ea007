"""Profile and product clusters: building, sizes, names, separation and layout."""

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.functions.ranks import exact_quantiles
from stallbook.functions.text import clean_cluster_name
from stallbook.functions.vectors import cosine_distance, doubles, mean_vectors, sum_vectors, unit
from stallbook.operators.components import connected_components
from stallbook.operators.linkage import LOCAL_POINTS, SCALE, agglomerate
from stallbook.operators.similarity import cosine_links, distinct_directions
from stallbook.operators.vectors import split_zero_vectors
from stallbook.scratch import stored

NO_CLUSTER_ID, EMPTY_PROFILE_ID = -1, -2
# Names shown for profiles outside every cluster and for profiles without products.
NO_CLUSTER, EMPTY_PROFILE, NO_NAME = "NO_CLUSTER", "EMPTY_PROFILE", "NO_NAME"

# Classes compared at once by the silhouette; further classes are handled in further passes.
CLASS_CHUNK = 2048
ROW_CHUNK = 8192


def cluster_sizes(clusters: DataFrame, min_size: int) -> DataFrame:
    """Clusters (id, cluster; null for a zero vector) with small ones as -1 and empty profiles as -2."""
    sizes = clusters.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("size"))
    shown = (
        F.when(F.col("cluster").isNull(), EMPTY_PROFILE_ID)
        .when(F.col("size") < min_size, NO_CLUSTER_ID)
        .otherwise(F.col("cluster"))
    )
    return clusters.join(sizes, "cluster", "left").select("id", shown.cast("long").alias("cluster_id"))


def agglomerative_clusters(
    vectors: DataFrame, threshold: float, linkage: str = "average", local_points: int = LOCAL_POINTS
) -> DataFrame:
    """id, cluster for all rows (id, vector); null cluster for zero vectors. Copies share one point."""
    filled, empty = split_zero_vectors(vectors)
    # Distances are taken on this grid, so vectors that fall together on it are one point.
    points, members = distinct_directions(filled, SCALE)
    points = stored(points, "points")
    edges = stored(cosine_links(points, threshold).select(F.col("u").alias("id_a"), F.col("v").alias("id_b")), "edges")
    found = agglomerate(points, edges, threshold, linkage, local_points)
    clusters = members.join(found.withColumnRenamed("id", "rep"), "rep").select("id", "cluster")
    return clusters.unionByName(empty.select("id", F.lit(None).cast(clusters.schema["cluster"].dataType).alias("cluster")))


def cluster_profiles(
    vectors: DataFrame,
    threshold: float = 0.1,
    linkage: str = "average",
    min_size: int = 3,
    local_points: int = LOCAL_POINTS,
) -> DataFrame:
    """id, cluster_id: agglomerative clusters of at least `min_size` profiles, -1 and -2 otherwise."""
    return cluster_sizes(agglomerative_clusters(vectors, threshold, linkage, local_points), min_size)


def cluster_products(vectors: DataFrame, eps: float, min_size: int) -> DataFrame:
    """Density clusters with two points per core: components of the graph of pairs within `eps`.

    Unclustered items and small clusters are -1.
    """
    points, members = distinct_directions(vectors)
    points = stored(points, "points")
    components = connected_components(cosine_links(points, eps, inclusive=True))
    copies = points.filter("copies > 1").select(F.col("id").alias("node"), F.col("id").alias("component"))
    grouped = components.unionByName(copies.join(components, "node", "left_anti"))
    clusters = members.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select(
        "id", F.col("component").alias("cluster")
    )
    return cluster_sizes(clusters, min_size).withColumn(
        "cluster_id", F.greatest("cluster_id", F.lit(NO_CLUSTER_ID).cast("long"))
    )


def cluster_names(
    clusters: DataFrame, vectors: DataFrame, products: DataFrame, product_vectors: DataFrame, clean: bool = False
) -> DataFrame:
    """cluster_id, cluster_name: the product nearest to the mean profile vector of a cluster.

    `products` has id and product, `product_vectors` has product and vector. Only products at a cosine distance
    below 1 qualify; equal distances go to the smaller text. `clean` keeps word characters only.
    """
    real = clusters.filter(F.col("cluster_id") >= 0)
    means = mean_vectors(real.join(vectors, "id"), ["cluster_id"]).withColumnRenamed("vector", "mean")
    offered = real.join(products, "id").select("cluster_id", "product").distinct()
    distance = cosine_distance(F.col("vector"), F.col("mean"))
    best = (
        offered.join(product_vectors, "product")
        .join(means, "cluster_id")
        .select("cluster_id", "product", distance.alias("distance"))
    )
    if clean:
        best = best.withColumn("product", clean_cluster_name(F.col("product"))).filter("product <> ''")
    best = (
        best.filter("distance < 1").groupBy("cluster_id").agg(F.min(F.struct("distance", "product"))["product"].alias("name"))
    )
    default = NO_NAME if clean else ""
    return means.select("cluster_id").join(best, "cluster_id", "left").select(
        "cluster_id", F.coalesce("name", F.lit(default)).alias("cluster_name")
    )


def with_names(clusters: DataFrame, names: DataFrame) -> DataFrame:
    shown = (
        F.when(F.col("cluster_id") == EMPTY_PROFILE_ID, EMPTY_PROFILE)
        .when(F.col("cluster_id") == NO_CLUSTER_ID, NO_CLUSTER)
        .otherwise(F.col("cluster_name"))
    )
    return clusters.join(names, "cluster_id", "left").withColumn("cluster_name", shown)


def silhouette_samples(vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """id, class, silhouette from the class sums alone: no pair of rows is formed.

    `cosine` equals the pairwise definition. `sqeuclidean` uses squared distances. A class of one scores 0.
    `vectors` has id, class, vector.
    """
    v = doubles(F.col("vector"))
    rows = vectors.select("id", "class", (unit(v) if metric == "cosine" else v).alias("vector"))
    rows = rows.withColumn("square", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    sums = stored(sum_vectors(rows, ["class"]), "classes")
    rows = stored(rows, "silhouette_rows")
    row_blocks, class_blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, ROW_CHUNK), (sums, CLASS_CHUNK)))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, class {rows.schema['class'].dataType.simpleString()}, a double, b double"

    def score(batch: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        if not len(batch) or not len(classes):
            return pd.DataFrame()  # no rows
        x, square, n = np.stack(batch["vector"].to_numpy()), batch["square"].to_numpy(), classes["n"].to_numpy(dtype=float)
        dots = x @ np.stack(classes["total"].to_numpy()).T
        if metric == "cosine":
            summed, to_itself = n - dots, 1.0 - square
        else:
            summed, to_itself = n * square[:, None] + classes["squares"].to_numpy() - 2.0 * dots, np.zeros(len(x))
        own = batch["class"].to_numpy()[:, None] == classes["class"].to_numpy()[None, :]
        inside = np.where(own & (n > 1.0), (summed - to_itself[:, None]) / np.maximum(n - 1.0, 1.0), -np.inf)
        outside = np.where(own, np.inf, summed / n)
        return pd.DataFrame({"id": batch["id"], "class": batch["class"], "a": inside.max(axis=1), "b": outside.min(axis=1)})

    # A block of rows meets a block of class sums in one task; neither side is ever whole in one place.
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    left = rows.select("*", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).alias("rows_of"), every(class_blocks, "classes_of"))
    right = sums.select("*", F.pmod(F.xxhash64("class"), F.lit(class_blocks)).alias("classes_of"), every(row_blocks, "rows_of"))
    key = ["rows_of", "classes_of"]
    partial = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(score, schema)
    best = partial.groupBy("id", "class").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    ratio = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    score = F.when(F.col("b") == float("inf"), None).when(F.col("a") == float("-inf"), 0.0).otherwise(ratio)
    return best.select("id", "class", score.alias("silhouette"))


def silhouette(vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """One row: mean silhouette, null for fewer than two classes."""
    return silhouette_samples(vectors, metric).agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n"))


def cluster_layout(vectors: DataFrame) -> DataFrame:
    """Two principal components per row: id, cluster, x, y. The greatest weight of a component is positive, so reruns agree in sign."""
    rows = vectors.select("id", "cluster", array_to_vector(doubles(F.col("vector"))).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(rows)
    weights = model.pc.toArray()
    signs = np.sign(weights[np.abs(weights).argmax(axis=0), [0, 1]]).tolist()
    xy = vector_to_array("xy")
    return model.transform(rows).select("id", "cluster", *((xy[i] * signs[i]).alias(axis) for i, axis in enumerate("xy")))


def cluster_medians(layout: DataFrame) -> DataFrame:
    """Median position per cluster."""
    middle = lambda axis: exact_quantiles(layout, ["cluster"], axis, [0.5]).select(
        "cluster", F.col("q")[0].alias(axis)
    )
    return middle("x").join(middle("y"), "cluster")


def close_clusters(medians: DataFrame, limit: float = 1.0) -> DataFrame:
    """Pairs of clusters whose medians are closer than `limit`, found over a grid of that width."""
    cell = lambda axis: F.floor(F.col(axis) / limit)
    home = medians.select("cluster", "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = (
        home.withColumn("dx", F.explode(around))
        .withColumn("dy", F.explode(around))
        .select(
            F.col("cluster").alias("other"),
            F.col("x").alias("x2"),
            F.col("y").alias("y2"),
            (F.col("gx") + F.col("dx")).alias("gx"),
            (F.col("gy") + F.col("dy")).alias("gy"),
        )
    )
    distance = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return (
        home.join(spread, ["gx", "gy"])
        .filter(F.col("cluster") < F.col("other"))
        .select("cluster", "other", distance.alias("distance"))
        .filter(F.col("distance") < limit)
    )
