"""Pairing of products with prices, and matching of relations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallbook.functions.neighbors import closer, neighbors_in
from stallbook.schemas import CANDIDATE_LABELS, MESSAGE_KEY, MONEY, PROD, PROD_PRICE
from stallbook.scratch import stored


# Entities that a task sorts; bounds memory, not results.
TASK_ROWS = 1 << 18


def _dealt(entities: DataFrame, *labels: str) -> tuple[DataFrame, int]:
    """Entities of the labels as a written table, and the number of tasks that sort them: a task's share does not grow with the table."""
    rows = stored(entities.filter(F.col("label").isin(*labels)), "entities")
    return rows, max(entities.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def _nearest_positions(entities: DataFrame, tasks: int, key: list[str], head: str = PROD, tail: str = MONEY) -> DataFrame:
    """Distinct ends of `head` entities with the starts of `tail` entities around them.

    Positions are reduced to one row before the window, so a message is never larger than its text however
    many entities repeat in it. A message is in one task from the start, which reduces and sorts its own positions.
    """
    is_head = F.col("label") == head
    point = F.struct("start", "pos", "end", "text")
    both = (
        entities.select(
            *key,
            is_head.cast("int").alias("probe"),
            F.when(is_head, F.col("end")).otherwise(F.col("start")).alias("at"),
            F.when(~is_head, point).alias("point"),
        )
        .repartition(tasks, *key)
        .groupBy(*key, "probe", "at")
        .agg(F.min("point").alias("point"))
    )
    return neighbors_in(both, key)


def nearest_price(
    entities: DataFrame,
    max_distance: int | None = None,
    tie: str = "text",
    key: list[str] = MESSAGE_KEY,
) -> DataFrame:
    """Each product with the price whose start is nearest to the product's end in the same message.

    `tie`: `text` prefers the price that comes first in the text, `annotation` the one annotated first. With
    `max_distance`, prices at that distance or more do not count and products without a price are dropped.
    """
    before_wins = F.lit(True) if tie == "text" else F.col("before.pos") <= F.col("after.pos")
    columns = [c for c in entities.columns if c != "label"]
    entities, tasks = _dealt(entities, PROD, MONEY)
    # All rows of a message come together once: the products read their neighbours from the running last price, so nothing is joined.
    # A price moves with its place and text only.
    is_head = F.col("label") == PROD
    moved = [F.col(c) if c in (*key, "start", "pos", "end", "text") else F.when(is_head, F.col(c)).alias(c) for c in columns]
    rows = entities.select(*moved, is_head.cast("int").alias("probe")).repartition(tasks, *key)
    head = F.col("probe") == 1
    point = F.when(~head, F.struct("start", "pos", "end", "text"))
    placed = rows.withColumns({"at": F.when(head, F.col("end")).otherwise(F.col("start")), "point": point})
    near = neighbors_in(placed, key, least="point", keep=columns)
    known = F.col("end").isNotNull()
    for k in key:  # a missing key is no message
        known &= F.col(k).isNotNull()
    paired = near.withColumn("price", F.when(known, closer(F.col("at"), F.col("before"), F.col("after"), before_wins)))
    if max_distance is not None:
        paired = paired.filter(F.abs(F.col("price.start") - F.col("end")) < max_distance)
    return paired.select(
        *columns,
        F.col("price.text").alias("price_text"),
        F.col("price.start").alias("price_start"),
        F.col("price.end").alias("price_end"),
    )


def candidate_counts(entities: DataFrame, pairs=CANDIDATE_LABELS, key: list[str] = MESSAGE_KEY) -> DataFrame:
    """Number of ordered entity pairs per message and allowed label combination.

    A product of counts: the pairs themselves grow with the square of a message and are never built.
    """
    labels = {label for pair in pairs for label in pair}
    counts = (
        entities.filter(F.col("label").isin(*labels))
        .groupBy(*key)
        .agg(*[F.count_if(F.col("label") == label).alias(f"n_{label}") for label in sorted(labels)])
    )
    combos = F.array(
        *[
            F.struct(
                F.lit(head).alias("head"),
                F.lit(tail).alias("tail"),
                (F.col(f"n_{head}") * F.col(f"n_{tail}")).alias("n_pairs"),
            )
            for head, tail in pairs
        ]
    )
    return counts.select(*key, F.inline(combos)).filter("n_pairs > 0")


def adjacent_candidates(entities: DataFrame, key: list[str] = MESSAGE_KEY, pair: tuple[str, str] = (PROD, MONEY)) -> DataFrame:
    """Pairs worth scoring: each distinct entity of the first label (columns start, end, text) with the nearest one of the second on
    either side (column price). Relations to an entity farther away are not among them; `missed_relations` counts these.
    """
    head, tail = pair
    entities, tasks = _dealt(entities, head, tail)
    near = _nearest_positions(entities, tasks, key, head, tail).withColumnRenamed("at", "end").repartition(tasks, *key, "end")
    products = entities.filter(F.col("label") == head).select(*key, "start", "end", "text").repartition(tasks, *key, "end").distinct()
    sides = F.array(
        F.struct(F.lit(0).alias("is_after"), F.col("before").alias("price")),
        F.struct(F.lit(1).alias("is_after"), F.col("after").alias("price")),
    )
    return (
        products.join(near, [*key, "end"])
        .select(*key, "start", "end", "text", F.inline(sides))
        .filter("price IS NOT NULL")
    )


def missed_relations(candidates: DataFrame, relations: DataFrame, key: list[str] = MESSAGE_KEY) -> DataFrame:
    """One row: gold relations, and those of them that no candidate pair joins."""
    ends = [F.col("head.start").alias("start"), F.col("head.end").alias("end"), F.col("tail.start").alias("price_start")]
    gold = relations.select(*key, *ends)
    built = candidates.select(*key, "start", "end", F.col("price.start").alias("price_start"), F.lit(1).alias("built")).distinct()
    return gold.join(built, [*key, "start", "end", "price_start"], "left").agg(F.count("*").alias("n_gold"), F.count_if(F.col("built").isNull()).alias("n_missed"))


def _pair_key(r: Column | None = None) -> list[Column]:
    """Both ends of a relation, smaller range first, so that the direction does not matter."""
    one = F.struct(F.col("start1").alias("start"), F.col("end1").alias("end"))
    two = F.struct(F.col("start2").alias("start"), F.col("end2").alias("end"))
    return [F.least(one, two).alias("low"), F.greatest(one, two).alias("high")]


def match_relations(predicted: DataFrame, gold: DataFrame, key: list[str], label: str = PROD_PRICE) -> DataFrame:
    """Per document: true positives, false positives, false negatives.

    Ranges are matched as multisets in either direction, which is the smaller of the two occurrence counts.
    """

    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.filter(F.col("label") == label).select(
            *key, *_pair_key(), *[F.lit(int(s == side)).cast("long").alias(s) for s in ("n_predicted", "n_gold")]
        )

    per_range = (
        counted(predicted, "n_predicted")
        .unionByName(counted(gold, "n_gold"))
        .groupBy(*key, "low", "high")
        .agg(F.sum("n_predicted").alias("p"), F.sum("n_gold").alias("g"))
    )
    hit = F.least("p", "g")
    return per_range.groupBy(*key).agg(
        F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn")
    )


def nn_scores(matches: DataFrame) -> DataFrame:
    total = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return total.select(
        "tp",
        "fp",
        "fn",
        F.try_divide(F.col("tp"), F.col("tp") + 0.5 * (F.col("fp") + F.col("fn"))).alias("f_1"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
    )

