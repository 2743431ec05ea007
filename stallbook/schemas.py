"""Schemas and column conventions shared by all operators."""

from pyspark.sql import types as T

USER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("phone", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("user", USER),
        T.StructField("datetime", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("reply_to", T.LongType()),
        T.StructField("type", T.ArrayType(T.StringType())),
    ]
)

CHAT = T.StructType(
    [
        T.StructField(
            "info",
            T.StructType(
                [
                    T.StructField("date", T.StringType()),
                    T.StructField("message_count", T.LongType()),
                    T.StructField("message_count_limit", T.LongType()),
                    T.StructField("source", T.StringType()),
                ]
            ),
        ),
        T.StructField("messages", T.ArrayType(MESSAGE)),
    ]
)

ENTITY = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)

SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)

RELATION = T.StructType(
    [
        T.StructField("start1", T.IntegerType()),
        T.StructField("end1", T.IntegerType()),
        T.StructField("start2", T.IntegerType()),
        T.StructField("end2", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)

# Label vocabulary of the annotated corpora.
PROD, MONEY, CRIT, PAYM, PER, LOC = "PROD", "MONEY", "CRIT", "PAYM", "PER", "LOC"
NOT_INCLUDED, NO_ANNOTATION = "NOT_INCLUDED", "NO_ANNOTATION"
PROD_PRICE, PRICE_CRIT = "PROD_PRICE", "PRICE_CRIT"
PATTERN_LABELS = (PROD, PER, PAYM, LOC, CRIT)
CANDIDATE_LABELS = ((PROD, MONEY), (MONEY, CRIT))

# A message is identified by the chat it belongs to and its id inside that chat.
MESSAGE_KEY = ["chat_id", "message_id"]
