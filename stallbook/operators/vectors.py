"""Vectors of items, profiles and classes, and how well classes separate."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallbook.functions.text import tokens_of
from stallbook.functions.vectors import cosine_distance, doubles, dot, is_zero, mean_vectors, sum_vectors, unit
from stallbook.operators.blocks import coded, in_blocks, places, slices
from stallbook.operators.tfidf import product_frequencies, weighted_mentions
from stallbook.scratch import stored

# Classes whose sums meet the sums of another block in one task.
BLOCK_CLASSES = 512


def item_vectors(items: DataFrame, token_vectors: DataFrame, item: str = "item") -> DataFrame:
    """Mean of the vectors of an item's lower-cased tokens; tokens outside the vocabulary do not count."""
    tokens = items.select(item).distinct().select(item, F.explode(tokens_of(F.lower(item))).alias("token"))
    return mean_vectors(tokens.join(token_vectors, "token"), [item])


def split_zero_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a non-zero vector, and rows with an all-zero one."""
    return vectors.filter(~is_zero(F.col("vector"))), vectors.filter(is_zero(F.col("vector")))


def _with_zero(users: DataFrame, means: DataFrame, dims: int) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), dims)
    return users.join(means, "user", "left").withColumn("vector", F.coalesce("vector", zero))


def profile_vectors(
    mentions: DataFrame, vectors: DataFrame, users: DataFrame, dims: int, n_profiles: int, use_tf_idf: bool = True
) -> DataFrame:
    """(Weighted) mean of the product vectors over all mentions of a profile; zero vector when there is none.

    `vectors` has product and vector. Mentions are counted per product first, so only distinct products of a
    profile meet their vectors, in blocks of profiles: a vector travels once to a block, not with each mention.
    """
    frequencies = stored(product_frequencies(mentions), "frequencies")
    if use_tf_idf:
        weighted = weighted_mentions(frequencies, n_profiles)
    else:
        weighted = frequencies.withColumn("weight", F.col("n").cast("double"))
    rows = stored(weighted.filter("weight > 0").select("user", "product", "weight"), "weighted_mentions")
    known = vectors.filter("vector IS NOT NULL").select("product", doubles(F.col("vector")).alias("vector"))
    schema = T.StructType([rows.schema["user"], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    means = in_blocks(rows, known, "user", "product", F.lit(dims), _block_means, schema)
    return _with_zero(users, means, dims)


def _block_means(rows: pa.Table, facts: pa.Table) -> pa.Table:
    """Weighted mean of the vectors of each user of a block."""
    at = places(rows.column("product"), facts.column("product"))
    rows, at = rows.filter(pa.array(at >= 0)), at[at >= 0]
    user, users = coded(rows.column("user"))
    weight = rows.column("weight").to_numpy()
    vectors = facts.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(facts.num_rows, -1) if facts.num_rows else np.zeros((0, 0))
    total = np.zeros((len(users), vectors.shape[1]))
    order = np.argsort(user, kind="stable")
    for part in slices(np.full(len(order), max(1, vectors.shape[1]))):
        some = order[part]
        first = np.flatnonzero(np.diff(user[some], prepend=-1))
        total[user[some][first]] += np.add.reduceat(weight[some, None] * vectors[at[some]], first)
    means = total / np.bincount(user, weights=weight, minlength=len(users))[:, None]
    ends = pa.array(np.arange(len(users) + 1, dtype=np.int32) * np.int32(means.shape[1]))
    return pa.table({"user": users, "vector": pa.ListArray.from_arrays(ends, pa.array(means.ravel()))})


def contextual_profile_vectors(token_vectors: DataFrame, spans: DataFrame, users: DataFrame, key: list[str], dims: int):
    """Mean over a profile's product spans, each the mean of its token vectors in context.

    `token_vectors` has key, idx, vector; `spans` has user, key, pos and the token range first..last. A message
    with the same key is used once.
    """
    covered = spans.select("user", *key, "pos", F.explode(F.sequence("first", "last")).alias("idx"))
    per_span = mean_vectors(covered.join(token_vectors, [*key, "idx"]), ["user", *key, "pos"])
    return _with_zero(users, mean_vectors(per_span, ["user"]), dims)


def vector_distances(pairs: DataFrame) -> DataFrame:
    """Cosine distance of columns `a` and `b`."""
    return pairs.withColumn("distance", cosine_distance(F.col("a"), F.col("b")))


def _class_sums(class_vectors: DataFrame) -> DataFrame:
    """Sum of unit vectors and size per class; all pairwise class similarities follow from it."""
    units = class_vectors.select("class", unit(doubles(F.col("vector"))).alias("vector"))
    return sum_vectors(units, ["class"])


def cohesion(class_vectors: DataFrame) -> DataFrame:
    """Mean cosine similarity over the pairs of a class, null for a single item.

    With s the sum of n unit vectors the pairs add up to (|s|^2 - n) / 2, so no pair is formed. A zero vector
    has similarity 0 to everything.
    """
    squared = dot(F.col("total"), F.col("total"))
    n = F.col("n")
    return _class_sums(class_vectors).select("class", "n", F.try_divide(squared - F.col("squares"), n * (n - 1)).alias("cohesion"))


def affinity_matrix(class_vectors: DataFrame) -> DataFrame:
    """class_a, class_b, value: mean similarity between two classes, cohesion on the diagonal.

    The sums of a block of classes meet those of another block in one task; a cell of the matrix is all that leaves it.
    """
    sums = stored(_class_sums(class_vectors), "class_sums")
    blocks = max(1, -(-sums.count() // BLOCK_CLASSES))
    class_type = sums.schema["class"].dataType.simpleString()
    block = F.pmod(F.xxhash64("class"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    rows = sums.select("class", "n", "squares", "total", block.alias("block_a"), every.alias("block_b"))
    columns = sums.select(F.col("class").alias("other"), F.col("n").alias("m"), F.col("total").alias("sum"), block.alias("block_b"), every.alias("block_a"))

    def cells(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()  # no rows
        total = np.stack(a["total"].to_numpy()) @ np.stack(b["sum"].to_numpy()).T
        same = a["class"].to_numpy()[:, None] == b["other"].to_numpy()[None, :]
        pairs = a["n"].to_numpy()[:, None] * (b["m"].to_numpy()[None, :] - same)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(pairs > 0, (total - same * a["squares"].to_numpy()[:, None]) / pairs, np.nan)
        i, j = np.indices(value.shape)
        return pd.DataFrame({"class_a": a["class"].to_numpy()[i.ravel()], "class_b": b["other"].to_numpy()[j.ravel()], "value": value.ravel()})

    key = ["block_a", "block_b"]
    met = rows.groupBy(*key).cogroup(columns.groupBy(*key))
    found = met.applyInPandas(cells, f"class_a {class_type}, class_b {class_type}, value double")
    return found.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def coupling(class_vectors: DataFrame) -> DataFrame:
    """Mean similarity between two different classes, smaller name first."""
    return affinity_matrix(class_vectors).filter("class_a < class_b")


def difference_table(affinity: DataFrame) -> DataFrame:
    """Affinity minus the diagonal entry of the class that comes first by name."""
    diagonal = affinity.filter("class_a = class_b").select(F.col("class_a").alias("owner"), F.col("value").alias("own"))
    return (
        affinity.withColumn("owner", F.least("class_a", "class_b"))
        .join(diagonal, "owner")
        .select("class_a", "class_b", (F.col("value") - F.col("own")).alias("value"))
    )


def difference_margins(differences: DataFrame) -> DataFrame:
    """Row mean and variance, column mean, and both over the whole table, all without the diagonal."""
    off = differences.filter("class_a <> class_b")
    stats = [F.avg("value").alias("mean"), F.var_pop("value").alias("variance")]
    rows = off.groupBy(F.col("class_a").alias("class")).agg(*stats).select(F.lit("row").alias("side"), "class", "mean", "variance")
    columns = off.groupBy(F.col("class_b").alias("class")).agg(*stats).select(
        F.lit("column").alias("side"), "class", "mean", F.lit(None).cast("double").alias("variance")
    )
    overall = off.agg(*stats).select(F.lit("all").alias("side"), F.lit("Mean").alias("class"), "mean", "variance")
    return rows.unionByName(columns).unionByName(overall)


def train_word_vectors(docs: DataFrame, dims: int = 32, min_count: int = 5, rounds: int = 1, seed: int = 17) -> DataFrame:
    """token, vector for the words of a lower-cased corpus that occur at least `min_count` times.

    The learner keeps its vocabulary on the driver; `min_count` bounds it. Texts are dealt out to all cores however few row groups hold them,
    cut into words once, and learned from in as many parts.
    """
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    words = stored(docs.select("text").repartition(parts).select(tokens_of(F.lower("text")).alias("words")), "words")
    learner = Word2Vec(vectorSize=dims, minCount=min_count, maxIter=rounds, seed=seed, inputCol="words", numPartitions=parts)
    vectors = learner.fit(words).getVectors()
    return vectors.select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))
