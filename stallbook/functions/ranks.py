"""Exact ranks and quantiles without sorting a whole group in one task."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallbook.scratch import stored

#: A sketch misses a rank by at most 1 / ACCURACY of the rows; groups of fewer rows are exact but for rounding.
ACCURACY = 10_000
_BELOW, _INSIDE, _ABOVE = -1, 0, 1


def _brackets(quantiles: list[float]) -> tuple[Column, Column]:
    """The sketched values, and from them a struct (i, quantile, low, high) for each quantile."""
    inner = [q for q in quantiles if 0 < q < 1]
    points = [min(max(q + side * 2 / ACCURACY, 0.0), 1.0) for q in inner for side in (-1, 1)]
    out = []
    for i, q in enumerate(quantiles):
        at = 2 * len([x for x in quantiles[:i] if 0 < x < 1])
        low, high = (F.col("least"),) * 2 if q <= 0 else (F.col("most"),) * 2 if q >= 1 else (F.col("edges")[at], F.col("edges")[at + 1])
        out.append(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("quantile"), low.alias("low"), high.alias("high")))
    return F.percentile_approx("v", points or [0.5], ACCURACY), F.array(*out)


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Quantiles per group with linear interpolation: `by`, `n`, and an array column `q` in the given order.

    A mergeable sketch of each group brackets every quantile between two values. One more pass counts what lies below a bracket
    and the values inside it, and only these few are ranked. Both passes combine on the map side, so a group of any size and any
    scale leaves a task as a sketch, counts, and the distinct values of its brackets.
    """
    names = [f"by_{i}" for i in range(len(by))]
    rows = stored(df.select(*(F.col(c).alias(x) for c, x in zip(by, names)), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL"), "values")
    sketched, brackets = _brackets(quantiles)
    sketch = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), sketched.alias("edges"))
    asked = stored(sketch.select(*(F.col(x).alias(f"k_{x}") for x in names), "n", brackets.alias("b")), "sketches").filter("n > 0")
    same = reduce(and_, (F.col(x).eqNullSafe(F.col(f"k_{x}")) for x in names), F.lit(True))
    zone = lambda x: F.when(F.col("v") < x["low"], _BELOW).when(F.col("v") > x["high"], _ABOVE).otherwise(_INSIDE)
    places = F.transform("b", lambda x: F.struct(x["i"].alias("i"), x["quantile"].alias("quantile"), zone(x).alias("zone")))
    met = rows.join(F.broadcast(asked) if not by else asked, same).select(*names, "n", "v", F.inline(places))
    counted = met.groupBy(*names, "n", "i", "quantile", "zone", F.when(F.col("zone") == _INSIDE, F.col("v")).alias("at")).agg(
        F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last")
    )
    order = Window.partitionBy(*names, "i").orderBy("zone", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("c").over(order))
    position = F.col("quantile") * (F.col("n") - 1)
    below = F.coalesce(F.max(F.when(F.col("zone") == _BELOW, F.col("c"))), F.lit(0))

    def pick(rank: Column) -> Column:
        """Small groups can miss a bracket by one rank, and that neighbour is known."""
        under, over = F.max(F.when(F.col("zone") == _BELOW, F.col("last"))), F.min(F.when(F.col("zone") == _ABOVE, F.col("first")))
        inside = F.min(F.when((F.col("zone") == _INSIDE) & (F.col("upto") > rank), F.col("at")))
        return F.when(F.first(rank) < below, under).otherwise(F.coalesce(inside, over))

    picked = ranked.groupBy(*names, "n", "i", "quantile").agg(pick(F.floor(position)).alias("lo"), pick(F.ceil(position)).alias("hi"))
    point = F.col("lo") + (position - F.floor(position)) * (F.col("hi") - F.col("lo"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", point.alias("x")))), lambda x: x["x"])
    return picked.groupBy(*names, "n").agg(listed.alias("q")).select(*(F.col(x).alias(c) for c, x in zip(by, names)), "n", "q")


def order_digest(key: list[str], seed: int) -> Column:
    """Hex digest whose order is a seeded random order of rows with a unique key."""
    return F.md5(F.concat_ws("_", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def digest_at(keys: DataFrame, rank: int, digits: int = 3) -> str:
    """The digest at a rank (from 1) in digest order, without sorting: only `digest` is read.

    Rows are counted by a prefix, the prefix that holds the rank is kept, and its next digits are counted. A step returns
    at most 16 ** digits counts, and leaves that fraction of the rows.
    """
    prefix = ""
    while True:
        size = min(len(prefix) + digits, 32)
        inside = keys.filter(F.col("digest").startswith(prefix)) if prefix else keys
        counts = inside.groupBy(F.substring("digest", 1, size).alias("p")).agg(F.count("*").alias("n"), F.min("digest").alias("first")).collect()
        for row in sorted(counts):
            if rank <= row["n"]:
                break
            rank -= row["n"]
        if row["n"] == 1 or size == 32:
            return row["first"]
        prefix = row["p"]
