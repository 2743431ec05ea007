"""Posting activity per author."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_clock(times: DataFrame) -> DataFrame:
    """Date and time of day on the sender's own clock."""
    return times.withColumns(
        {"date": F.to_date("ts_local"), "time": F.date_format("ts_local", "HH:mm:ss")}
    )


def posts_per_day(times: DataFrame) -> DataFrame:
    return times.groupBy("user", F.to_date("ts_local").alias("date")).agg(F.count("*").alias("n"))


def calendar_fill(daily: DataFrame) -> DataFrame:
    """Adds the days between an author's first and last one with a count of 0.

    Only (author, first, last) is expanded; counts and empty days then meet in one aggregation.
    """
    spans = daily.groupBy("user").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = spans.select(
        "user", F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("date"), F.lit(0).cast("long").alias("n")
    )
    return daily.unionByName(days).groupBy("user", "date").agg(F.sum("n").alias("n"))


def daily_activity(times: DataFrame) -> DataFrame:
    return calendar_fill(posts_per_day(times))


def hourly_activity(times: DataFrame) -> DataFrame:
    """24 rows per author."""
    hour = F.hour("ts_local")
    counts = times.groupBy("user").agg(*[F.count_if(hour == h).alias(f"h{h}") for h in range(24)])
    bins = F.array(*[F.struct(F.lit(h).alias("hour"), F.col(f"h{h}").alias("n")) for h in range(24)])
    return counts.select("user", F.inline(bins))


def most_active_profile(times: DataFrame) -> DataFrame:
    """The author with most distinct post times; the first one in author order wins ties."""
    return times.groupBy("user").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user").limit(1)


def message_date_range(messages: DataFrame) -> DataFrame:
    return messages.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).select(
        "first", "last", F.timestamp_diff("SECOND", F.col("first"), F.col("last")).alias("seconds")
    )
