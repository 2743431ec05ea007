"""Chat exports."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.schemas import CHAT, MESSAGE
from stallbook.sources.export_ranges import RANGE_BYTES, ChatExportSource

# An ISO 8601 stamp may end in Z, +02:00, +0200 or +02, or have no offset.
_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2})?)$"


def read_exports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per export: chat_id, info, messages.

    The usual export is one JSON object over many lines per file, and its chat_id is the file name. `multi_line=False`
    reads files with one export per line, which Spark can split; their chat_id is the file name with a digest of
    the line, so equal lines of a file are one chat.
    """
    name = F.col("_metadata.file_name")
    if multi_line:
        return spark.read.schema(CHAT).option("multiLine", True).json(path).select(name.alias("chat_id"), "info", "messages")
    lines = spark.read.text(path).filter("trim(value) <> ''")
    chat_id = F.concat_ws("#", name, F.substring(F.sha2("value", 256), 1, 16))
    return lines.select(chat_id.alias("chat_id"), F.from_json("value", CHAT).alias("export")).select("chat_id", "export.info", "export.messages")


def instant(stamp: Column) -> Column:
    """ISO 8601 stamp as an instant; without an offset it counts as session time. Null if unreadable."""
    with_colon = F.regexp_replace(stamp, r"(T.*[+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(stamp.rlike(r"T.*[+-]\d{2}$"), F.concat(stamp, F.lit(":00"))).otherwise(with_colon).try_cast("timestamp")


def wall_clock(stamp: Column) -> Column:
    """The sender's own date and time of an ISO 8601 stamp."""
    return F.when(stamp.contains("T"), F.regexp_replace(stamp, _OFFSET, "")).otherwise(stamp).try_cast("timestamp_ntz")


def _shown(messages: DataFrame) -> DataFrame:
    """Columns of messages (chat_id, m)."""
    m = F.col("m")
    stamp = m["datetime"]
    unreadable = F.raise_error(F.concat_ws(" ", F.lit("no time stamp:"), stamp, F.lit("in message"), m["id"].cast("string"), F.lit("of"), F.col("chat_id")))
    ts = F.when(stamp.isNull() | instant(stamp).isNotNull(), instant(stamp)).otherwise(unreadable)
    return messages.select(
        "chat_id",
        m["id"].alias("message_id"),
        m["user"].alias("user"),
        ts.alias("ts"),
        wall_clock(stamp).alias("ts_local"),
        m["message"].alias("text"),
        m["reply_to"].alias("reply_to"),
        m["type"].alias("type"),
    )


def messages_of(exports: DataFrame) -> DataFrame:
    """One row per message, `ts` as an instant and `ts_local` as the sender's wall clock. An unreadable stamp fails and names the message."""
    return _shown(exports.select("chat_id", F.explode("messages").alias("m")))


def count_violations(exports: DataFrame) -> DataFrame:
    """Exports whose declared message count differs from the number of messages in them."""
    actual = F.coalesce(F.size("messages"), F.lit(0)).cast("long")
    return exports.select(
        "chat_id", F.col("info.message_count").alias("declared"), actual.alias("actual")
    ).filter("declared IS DISTINCT FROM actual")


def _count_message(declared: Column, actual: Column) -> Column:
    return F.concat_ws(" ", F.lit("declared message count"), declared, F.lit("but found"), actual, F.lit("in"), F.col("chat_id"))


def checked(exports: DataFrame) -> DataFrame:
    """The exports again; reading one with a wrong message count fails and names both numbers."""
    actual = F.coalesce(F.size("messages"), F.lit(0)).cast("long")
    declared = F.col("info.message_count")
    valid = F.when(declared.eqNullSafe(actual), F.col("messages")).otherwise(F.raise_error(_count_message(declared, actual)))
    return exports.withColumn("messages", valid)


def read_chat(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return messages_of(checked(read_exports(spark, path, multi_line)))


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """chat_id, info, m: one row per info and per message of exports (one per file) of any size, read in byte ranges."""
    spark.dataSource.register(ChatExportSource)
    rows = spark.read.format("chat_export").option("path", path).option("rangeBytes", range_bytes).load()
    parsed = lambda kind, schema: F.when(F.col("kind") == kind, F.from_json("body", schema))
    return rows.select("chat_id", parsed("info", CHAT["info"].dataType).alias("info"), parsed("message", MESSAGE).alias("m"))


def ranged_messages(rows: DataFrame) -> DataFrame:
    """The messages among the rows of `read_ranges`, as `messages_of` shows them."""
    return _shown(rows.filter("m IS NOT NULL").select("chat_id", "m"))


def read_large_chat(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As `read_chat`, but a file is split. A wrong message count fails; the counts are one row per export."""
    rows = read_ranges(spark, path, range_bytes)
    counts = rows.groupBy("chat_id").agg(F.max("info.message_count").alias("declared"), F.count("m").alias("actual"))
    declared, actual = F.col("declared"), F.col("actual")
    fine = F.when(declared.eqNullSafe(actual), F.col("m")).otherwise(F.raise_error(_count_message(declared, actual)))
    return _shown(rows.filter("m IS NOT NULL").join(counts, "chat_id").select("chat_id", fine.alias("m")))
