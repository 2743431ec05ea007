"""Column functions and aggregations over dense vectors (array<double>)."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Vector of length 1 in the same direction; a zero vector stays as it is."""
    return F.when(is_zero(a), a).otherwise(F.transform(a, lambda x: x / norm(a)))


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def mean_vectors(df: DataFrame, by: list[str], vector: str = "vector", weight: str | None = None) -> DataFrame:
    """Mean vector per group, combined on the map side. Groups whose weights are all 0 are left out."""
    if weight is not None:
        df = df.filter(F.col(weight) > 0)
        summary = Summarizer.mean(array_to_vector(vector), F.col(weight))
    else:
        summary = Summarizer.mean(array_to_vector(vector))
    return df.groupBy(*by).agg(vector_to_array(summary).alias("vector"))


def sum_vectors(df: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """Per group the vector sum, the number of rows and the sum of squared lengths, combined on the map side."""
    summary = Summarizer.metrics("sum", "count").summary(array_to_vector(vector))
    squares = F.sum(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return (
        df.groupBy(*by)
        .agg(summary.alias("s"), squares.alias("squares"))
        .select(*by, vector_to_array("s.sum").alias("total"), F.col("s.count").alias("n"), "squares")
    )
