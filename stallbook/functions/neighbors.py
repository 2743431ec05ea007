"""Nearest point lookups on a line without comparing pairs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_neighbors(probes: DataFrame, points: DataFrame, group: list[str], equal: str = "before") -> DataFrame:
    """For each probe position, the closest point on either side.

    `probes` has group columns and `at`; `points` has group columns, `at` and a struct `point`. Both must hold
    one row per (group, at), so a group is never larger than the text it comes from. A point at the probe's own
    position counts as `before` or `after` as `equal` says. Cost: one shuffle and two sorts, whatever the number
    of probes and points per group.
    """
    no_point = F.lit(None).cast(points.schema["point"].dataType)
    both = points.select(*group, "at", F.lit(0).alias("probe"), "point").unionByName(
        probes.select(*group, "at", F.lit(1).alias("probe"), no_point.alias("point"))
    )
    return neighbors_in(both, group, equal)


def neighbors_in(both: DataFrame, group: list[str], equal: str = "before", least: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """As `attach_neighbors`, for probes (`probe` = 1, null `point`) and points already in one table.

    With `least`, places may hold several points, of which the one with the least value of that column counts, and several probes, each
    with the columns `keep`. The frames are running ones: a group of any size is read as a stream.
    """
    frame = (Window.unboundedPreceding, Window.currentRow)
    points_first, probes_first = F.asc("probe"), F.desc("probe")
    up, down = (points_first, probes_first) if equal == "before" else (probes_first, points_first)
    last = [F.desc(least)] if least else []  # the least is the last in both orders
    rising = Window.partitionBy(*group).orderBy(F.asc("at"), up, *last).rowsBetween(*frame)
    falling = Window.partitionBy(*group).orderBy(F.desc("at"), down, *last).rowsBetween(*frame)
    return (
        both.withColumn("before", F.last("point", ignorenulls=True).over(rising))
        .withColumn("after", F.last("point", ignorenulls=True).over(falling))
        .filter("probe = 1")
        .select(*(keep or group), "at", "before", "after")
    )


def closer(at: Column, before: Column, after: Column, before_wins_tie: Column) -> Column:
    """The nearer of two optional points by |point.start - at|."""
    d_before = F.abs(before["start"] - at)
    d_after = F.abs(after["start"] - at)
    take_before = (d_before < d_after) | ((d_before == d_after) & before_wins_tie)
    return F.when(after.isNull() | (before.isNotNull() & take_before), before).otherwise(after)
