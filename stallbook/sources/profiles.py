"""Profile collections, offers and cluster folders on disk."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.functions.text import strip
from stallbook.operators import summaries

_USER = "struct<id: string, first_name: string, last_name: string, username: string, phone: string>"
_ENTITY = "struct<label: string, text: string, start: int, end: int>"
_POINT = "struct<text: string, start: int, end: int>"
_COUNTS = ", ".join(f"{name}: bigint" for name in summaries.COUNTS)

#: What a component can hold besides its name and message; each kind fills its own.
FINDINGS = {"entity": _ENTITY, "price": _ENTITY, "relation": f"struct<head: {_POINT}, tail: {_POINT}, label: string>", "summary": f"struct<{_COUNTS}>"}
PROFILE = f"""
    user {_USER}, part int,
    components array<struct<name: string, chat_id: string, message_id: bigint, {", ".join(f"{name}: {kind}" for name, kind in FINDINGS.items())}>>
"""


def nest_profiles(components: DataFrame, users: DataFrame, rows_per_part: int = 10_000) -> DataFrame:
    """Profiles as nested rows. A large profile becomes several parts, so no row grows with its author.

    `components` has user (all five fields), name, chat_id, message_id and the findings; every user gets at least one row.
    """
    sizes = components.groupBy("user").agg(F.ceil(F.count("*") / rows_per_part).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("chat_id", "message_id", "name", "entity", "relation"), F.col("parts")).cast("int")
    sizes = sizes.withColumnRenamed("user", "sized")
    nested = (
        components.join(sizes, F.col("user").eqNullSafe(F.col("sized")))
        .withColumn("part", part)
        .groupBy("user", "part")
        .agg(F.array_sort(F.collect_list(F.struct("name", "chat_id", "message_id", *FINDINGS))).alias("components"))
    )
    empty = users.join(sizes, F.col("user").eqNullSafe(F.col("sized")), "left_anti").select(
        "user", F.lit(0).alias("part"), F.array().cast(nested.schema["components"].dataType).alias("components")
    )
    return nested.unionByName(empty)


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).json(path)


def components_in(profiles: DataFrame) -> DataFrame:
    return profiles.select("user", F.explode("components").alias("c")).select("user", "c.*")


def write_offers(offers: list[DataFrame], path: str) -> None:
    """The offers of several chats as one table."""
    reduce(DataFrame.unionByName, offers).write.parquet(path)


def cluster_folder(name: Column) -> Column:
    """Folder of a cluster: no slash, no surrounding blanks, at most 100 characters."""
    return F.substring(strip(F.replace(name, F.lit("/"), F.lit("_"))), 1, 100)


def cluster_members(clusters: DataFrame, empty_name: str = "EMPTY_PROFILE") -> DataFrame:
    return clusters.filter(F.col("cluster_name") != empty_name).withColumn(
        "cluster_key", cluster_folder(F.col("cluster_name"))
    )


def write_clusters(clusters: DataFrame, path: str) -> None:
    cluster_members(clusters).write.partitionBy("cluster_key").parquet(path)


def product_cluster_folder(clusters: DataFrame) -> DataFrame:
    """Products with the folder `<cluster>_<size>` they are written to."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    key = F.format_string("%03d_%04d", "cluster_id", "size")
    return clusters.join(sizes, "cluster_id").select(key.alias("cluster_key"), F.col("item").alias("value"))


def write_product_clusters(clusters: DataFrame, path: str) -> None:
    """Sorted products, one folder per cluster; a large cluster becomes several files in order."""
    ordered = product_cluster_folder(clusters).repartitionByRange("cluster_key", "value")
    ordered.sortWithinPartitions("cluster_key", "value").write.partitionBy("cluster_key").text(path)
