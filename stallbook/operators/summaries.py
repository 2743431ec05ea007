"""Per-author summaries, kept as flat tables so that no row grows with its author."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.functions.text import normalize_product_key
from stallbook.operators.messages import non_blank, with_label
from stallbook.schemas import LOC, MESSAGE_KEY, PAYM, PER


# What a summary counts for an author.
COUNTS = ["n_products", "n_prices", "n_product_messages", "n_locations", "n_persons", "n_payments", "n_post_times"]


def _product_key():
    return F.lower("text").alias("product_key")


def product_summary(mentions: DataFrame) -> DataFrame:
    """Per author and product (case folded): first spelling, number of distinct prices and messages.

    A message's mentions of a product are one row, which takes no shuffle where mentions lie by message, and these rows move once.
    """
    in_message = mentions.groupBy("user", _product_key(), *MESSAGE_KEY).agg(
        F.min(F.struct("start", "text")).alias("first"), F.collect_set("price_text").alias("prices")
    )
    first_seen = F.struct(*MESSAGE_KEY, F.col("first.start").alias("start"), F.col("first.text").alias("text")).alias("first")
    whole = F.col(MESSAGE_KEY[0]).isNotNull() & F.col(MESSAGE_KEY[1]).isNotNull()
    spelling = F.lower("first.text").alias("product_key")
    dealt = in_message.select("user", first_seen, whole.cast("long").alias("n"), "prices").repartition("user", F.lower("first.text"))
    priced = dealt.select("user", spelling, "first", "n", F.posexplode_outer("prices").alias("i", "price_text"))
    counted = F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n")).otherwise(0)
    per_price = priced.groupBy("user", "product_key", "price_text").agg(F.min("first").alias("first"), F.sum(counted).alias("n"))
    return per_price.groupBy("user", "product_key").agg(
        F.min("first")["text"].alias("product"), F.count("price_text").alias("n_prices"), F.sum("n").alias("n_messages")
    )


def product_prices(mentions: DataFrame) -> DataFrame:
    """Distinct price texts per author and product."""
    return mentions.filter("price_text IS NOT NULL").select("user", _product_key(), "price_text").distinct()


def product_messages(mentions: DataFrame) -> DataFrame:
    """Distinct messages per author and product."""
    return mentions.select("user", _product_key(), *MESSAGE_KEY).distinct()


def mention_map(entities: DataFrame, label: str) -> DataFrame:
    """Per author and text the messages it occurs in; `n` keeps repeats inside a message."""
    return with_label(entities, label).groupBy("user", "text", *MESSAGE_KEY).agg(F.count("*").alias("n"))


def mention_counts(entities: DataFrame, label: str) -> DataFrame:
    """Number of mentions (not messages) per author and text."""
    return with_label(entities, label).groupBy("user", "text").agg(F.count("*").alias("n_mentions"))


def post_times(messages: DataFrame) -> DataFrame:
    """Distinct instants of visible messages per author, with the earliest wall clock seen for each."""
    return non_blank(messages).groupBy("user", "ts").agg(F.min("ts_local").alias("ts_local"))


def summaries(mentions: DataFrame, entities: DataFrame, times: DataFrame, users: DataFrame) -> DataFrame:
    """One row per author, also for authors without any finding.

    Every part is aggregated per author first; the parts are then summed as one narrow table, which needs a
    single shuffle instead of one join per part.
    """
    columns = COUNTS

    def part(df: DataFrame, **values) -> DataFrame:
        return df.select("user", *[values.get(c, F.lit(0)).cast("long").alias(c) for c in columns])

    products = product_summary(mentions)
    spans = entities.filter(F.col("label").isin(LOC, PER, PAYM))
    parts = [
        part(users),
        part(
            products,
            n_products=F.lit(1),
            n_prices=F.col("n_prices"),
            n_product_messages=F.col("n_messages"),
        ),
        part(
            spans,
            n_locations=(F.col("label") == LOC).cast("int"),
            n_persons=(F.col("label") == PER).cast("int"),
            n_payments=(F.col("label") == PAYM).cast("int"),
        ),
        part(times, n_post_times=F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("user").agg(*[F.sum(c).alias(c) for c in columns])


def sorted_products(summary: DataFrame) -> DataFrame:
    """Products of all authors in output order: by author, then by displayed name in code point order."""
    return summary.orderBy("user", "product", "product_key")


def normalized_products(summary: DataFrame) -> DataFrame:
    """Distinct product names over all authors: word characters, single blanks, lower case, longer than one."""
    return (
        summary.select("product")
        .distinct()
        .select(normalize_product_key(F.col("product")).alias("product"))
        .filter(F.length("product") > 1)
        .distinct()
    )


def messages_for_product(products_in: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages behind each product; equal texts share the smallest message as `first_id`.

    `products_in` is `product_messages`, `messages` has the key and `text` (null reads as empty).
    """
    rows = products_in.join(
        messages.select(*MESSAGE_KEY, F.coalesce("text", F.lit("")).alias("text")), MESSAGE_KEY
    ).withColumn("text_key", F.sha2("text", 256))
    folded = ["user", "product_key", "chat_id", "text_key"]
    first = rows.groupBy(*folded).agg(
        F.min("message_id").alias("first_id"), F.count("*").alias("n_messages")
    )
    return rows.join(first, folded).select(
        "user", "product_key", "chat_id", "first_id", "message_id", "n_messages", "text"
    )
