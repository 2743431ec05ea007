"""Messages, their authors and the spans found in them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.functions.text import is_not_blank
from stallbook.schemas import LOC, MONEY, PAYM, PER, PROD


def non_blank(messages: DataFrame) -> DataFrame:
    return messages.filter(is_not_blank(F.col("text")))


def users_of(messages: DataFrame) -> DataFrame:
    """Distinct authors. All user fields count, so an edited name is another profile."""
    return messages.select("user").distinct()


def messages_per_user(messages: DataFrame) -> DataFrame:
    """Per author the number of messages and of visible messages; authors of blank ones only are kept."""
    visible = is_not_blank(F.col("text"))
    return messages.groupBy("user").agg(
        F.count("*").alias("n_messages"), F.count_if(visible).alias("n_visible")
    )


def profile_for(profiles: DataFrame, user: Column | None = None, user_id: str | None = None) -> DataFrame:
    """All rows of the profile of a full user, or of the first user (in user order) with an id; a large profile has several."""
    if user is not None:
        return profiles.filter(F.col("user").eqNullSafe(user))
    having = profiles.filter(F.col("user.id") == user_id)
    first = having.agg(F.min("user").alias("chosen")).filter("chosen IS NOT NULL")  # one row
    return having.join(F.broadcast(first), F.col("user").eqNullSafe(F.col("chosen"))).drop("chosen")


def named_entities(annotated: DataFrame) -> DataFrame:
    """One row per span of an annotated message, in annotation order."""
    return annotated.select(
        "chat_id", "message_id", "user", "text", F.posexplode("spans").alias("pos", "s")
    ).select(
        "chat_id",
        "message_id",
        "user",
        "pos",
        F.col("s.label").alias("label"),
        F.expr("substring(text, s.start + 1, s.end - s.start)").alias("text"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
    )


def relation_rows(annotated: DataFrame) -> DataFrame:
    """One row per relation of an annotated message with both end points."""

    def point(start: str, end: str) -> Column:
        return F.struct(
            F.expr(f"substring(text, r.{start} + 1, r.{end} - r.{start})").alias("text"),
            F.col(f"r.{start}").alias("start"),
            F.col(f"r.{end}").alias("end"),
        )

    return annotated.select("chat_id", "message_id", "user", "text", F.explode("relations").alias("r")).select(
        "chat_id",
        "message_id",
        "user",
        point("start1", "end1").alias("head"),
        point("start2", "end2").alias("tail"),
        F.col("r.label").alias("label"),
    )


def with_label(entities: DataFrame, label: str) -> DataFrame:
    return entities.filter(F.col("label") == label)


def products(entities: DataFrame) -> DataFrame:
    return with_label(entities, PROD)


def prices(entities: DataFrame) -> DataFrame:
    return with_label(entities, MONEY)


def locations(entities: DataFrame) -> DataFrame:
    return with_label(entities, LOC)


def persons(entities: DataFrame) -> DataFrame:
    return with_label(entities, PER)


def payment_methods(entities: DataFrame) -> DataFrame:
    return with_label(entities, PAYM)
