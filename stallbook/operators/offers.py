"""Offers (product, price, subscription length) and price statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.functions.ranks import exact_quantiles
from stallbook.functions.text import normalize_price, normalize_product_name, subscription_length
from stallbook.schemas import PROD_PRICE
from stallbook.scratch import stored

# Product families and the letters that identify them inside a lower-cased product text.
FAMILIES = {"Netflix": "netfl", "NordVPN": "nordv", "Sky": "sky"}

# Subscription lengths shown in the histogram.
SHOWN_LENGTHS = ("1", "12", "24", "36", "lifetime", "unknown")

FIVE_NUMBERS = [0.0, 0.25, 0.5, 0.75, 1.0]


def offer_candidates(relations: DataFrame) -> DataFrame:
    """Product-price relations with every length attached to the same price entity, null when there is none."""
    is_price = F.col("label") == PROD_PRICE
    key = ["user", "chat_id", "message_id"]
    priced = relations.filter(is_price).select(*key, F.col("head").alias("product"), F.col("tail").alias("price"))
    lengths = relations.filter(~is_price).select(*key, F.col("head").alias("price"), F.col("tail").alias("crit"))
    return priced.join(lengths, [*key, "price"], "left").select(
        *key, F.col("product.text").alias("product"), F.col("price.text").alias("price"), F.col("crit.text").alias("crit")
    )


def _matching_families(product: Column, families: dict[str, str]) -> Column:
    low = F.lower(product)
    return F.array_compact(
        F.array(*[F.when(low.contains(part), F.lit(name)) for name, part in families.items()])
    )


def normalize_offers(candidates: DataFrame, families: dict[str, str] = FAMILIES) -> DataFrame:
    """One offer per matching product family. Lengths that cannot be read drop the offer.

    crit_kind is `none`, `months` or `lifetime`; crit_months is set for `months` only. An unreadable price
    stays -1 and is marked by `is_priced`.
    """
    length = subscription_length(F.col("crit"))
    kind = F.when(F.col("crit").isNull(), "none").otherwise(F.col("length.kind"))
    months = F.col("crit_months")
    return (
        candidates.withColumn("type", F.explode(_matching_families(F.col("product"), families)))
        .withColumn("length", length)
        .withColumn("price", normalize_price(F.col("price")))
        .withColumn("crit_kind", kind)
        .withColumn("crit_months", F.col("length.months"))
        .filter("crit_kind IS NOT NULL")
        .withColumn("price_per_month", F.col("price") / F.when(months != 0, months))
        .withColumn("is_normalized", F.col("crit_kind") == "months")
        .withColumn("is_priced", F.col("price") >= 0)
        .drop("length", "crit")
    )


def product_price_mentions(mentions: DataFrame, part: str = "netflix") -> DataFrame:
    """Mentions of one named product with a nearest price, price normalised."""
    return (
        mentions.filter(F.lower("text").contains(part) & F.col("price_text").isNotNull())
        .withColumn("price", normalize_price(F.col("price_text")))
        .withColumn("type", F.lit(part))
    )


def box_offers(offers: DataFrame) -> DataFrame:
    return offers.filter("crit_kind = 'months' AND price_per_month < 25 AND price < 100")


def scatter_offers(offers: DataFrame) -> DataFrame:
    return offers.filter("crit_kind = 'months' AND crit_months < 50 AND price_per_month < 25")


def length_class() -> Column:
    return (
        F.when(F.col("crit_kind") == "none", "unknown")
        .when(F.col("crit_kind") == "lifetime", "lifetime")
        .otherwise(F.col("crit_months").cast("string"))
    )


def histogram_offers(offers: DataFrame, types: list[str]) -> DataFrame:
    return offers.withColumn("length_class", length_class()).filter(
        F.col("length_class").isin(*SHOWN_LENGTHS) & F.col("type").isin(*types)
    )


def box_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Five-number summary per group."""
    names = ["min", "q1", "median", "q3", "max"]
    stats = exact_quantiles(df, by, value, FIVE_NUMBERS)
    return stats.select(*by, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(names)])


def subscription_histogram(offers: DataFrame, types: list[str]) -> DataFrame:
    """Share of each length class inside its product family."""
    counts = histogram_offers(offers, types).groupBy("type", "length_class").agg(F.count("*").alias("n"))
    totals = counts.groupBy("type").agg(F.sum("n").alias("total"))
    return counts.join(totals, "type").select("type", "length_class", "n", (F.col("n") / F.col("total")).alias("share"))


def price_trend(offers: DataFrame) -> DataFrame:
    """Least squares of price per month on log10 of the length, per product family."""
    x = F.log10("crit_months")
    y = F.col("price_per_month")
    return (
        scatter_offers(offers)
        .groupBy("type")
        .agg(
            F.count("*").alias("n"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"),
        )
    )


def product_price_ranges(prices: DataFrame, more_than: int = 15, cap: float = 1000.0) -> DataFrame:
    """Readable prices of products with more than `more_than` of them, below `cap`.

    `prices` has product (displayed name) and price_text, one row per distinct price text of an author's
    product.
    """
    priced = prices.select(
        normalize_product_name(F.col("product")).alias("product"), normalize_price(F.col("price_text")).alias("price")
    ).filter("price >= 0")
    # Equal prices travel as one row with a count until the frequent products are known.
    counted = stored(priced.groupBy("product", "price").agg(F.count("*").alias("n")), "prices")
    frequent = (
        counted.groupBy("product").agg(F.sum("n").alias("n_prices")).filter(F.col("n_prices") > more_than)
    )
    return counted.join(frequent, "product").filter(F.col("price") < cap)
