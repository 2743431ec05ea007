"""How the supplied tables become the library's inputs, in Spark and as SQL for the check engine.

Orders with their line items stand in for annotated chat messages, conversations for messages, documents for
annotated corpora, events for posting times and embeddings for vectors. Every rule uses all rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.schemas import PRICE_CRIT, PROD_PRICE

# Product families for part names.
PART_FAMILIES = {"Widget": "widg", "Gizmo": "gizm", "Bolt": "bolt", "Cold": "cold"}
SPAN_LABELS = ["PROD", "MONEY", "CRIT", "PAYM", "PER", "LOC"]
SPAN_STEP = 97

# One row per line item: a product, and possibly a price, a length, a place, a person, a payment method.
LINES = """
SELECT CAST(o_custkey AS STRING) AS author, o_orderstatus AS chat_id, l_orderkey AS message_id,
       l_linenumber AS line_no, l_partkey AS part_id,
       p_name AS prod, CAST((l_partkey * 13) % 900 AS INT) AS prod_at,
       CASE WHEN l_discount > 0 THEN
         CASE WHEN l_returnflag = 'A' THEN CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING) || '€'
              WHEN l_returnflag = 'R' THEN CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING) || ',50 €'
              WHEN l_linestatus = 'O' THEN CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING) || ' - 99€'
              ELSE CAST(CAST(floor(l_extendedprice / 100) AS BIGINT) AS STRING) || '.' END
       END AS money, CAST((l_suppkey * 7 + l_linenumber * 31) % 900 AS INT) AS money_at,
       CASE WHEN l_tax > 0 THEN
         CASE WHEN l_quantity <= 12 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' Monate'
              WHEN l_quantity <= 15 THEN 'eins jahr'
              WHEN l_quantity <= 20 THEN CAST(CAST(l_quantity - 15 AS BIGINT) AS STRING) || ' Jahr'
              WHEN l_quantity <= 24 THEN 'Lifetime'
              WHEN l_quantity <= 28 THEN 'jährlich'
              WHEN l_quantity <= 32 THEN 'pro jahr'
              WHEN l_quantity <= 36 THEN 'zwölf monate'
              WHEN l_quantity <= 40 THEN 'pro Monat'
              WHEN l_quantity <= 44 THEN 'keine'
              WHEN l_quantity <= 47 THEN '0 monate'
              ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' tage' END
       END AS crit, CAST((l_partkey * 3 + 11) % 900 AS INT) AS crit_at,
       CASE WHEN l_returnflag = 'R' THEN p_brand END AS loc, CAST(l_partkey % 900 AS INT) AS loc_at,
       CASE WHEN l_returnflag = 'A' THEN '@seller' || CAST(l_suppkey AS STRING) END AS per,
       CAST((l_suppkey * 11) % 900 AS INT) AS per_at,
       CASE WHEN l_linestatus = 'F' THEN o_orderpriority END AS paym, CAST((l_suppkey * 17) % 900 AS INT) AS paym_at,
       l_shipdate AS shipped
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""

_TABLES = {"lineitem": "lineitem", "orders": "orders", "part": "part"}

# Kinds of entities a line holds: label, text column, position column, place in the annotation order.
_KINDS = [
    ("PROD", "prod", "prod_at", 0),
    ("MONEY", "money", "money_at", 1),
    ("CRIT", "crit", "crit_at", 2),
    ("LOC", "loc", "loc_at", 3),
    ("PER", "per", "per_at", 4),
    ("PAYM", "paym", "paym_at", 5),
]

LINES_SQL = LINES.format(**_TABLES)
ENTITIES_SQL = f"lines AS ({LINES_SQL}), ents AS (" + " UNION ALL ".join(
    f"SELECT author, chat_id, message_id, line_no * 10 + {n} AS pos, '{label}' AS label, {text} AS text, "
    f"{at} AS s, {at} + CAST(length({text}) AS INT) AS e FROM lines WHERE {text} IS NOT NULL"
    for label, text, at, n in _KINDS
) + ")"
RELATIONS_SQL = f"""lines AS ({LINES_SQL}), rels AS (
  SELECT author, chat_id, message_id, prod AS head_text, prod_at AS head_s, prod_at + CAST(length(prod) AS INT) AS head_e,
         money AS tail_text, money_at AS tail_s, money_at + CAST(length(money) AS INT) AS tail_e, 'PROD_PRICE' AS label
  FROM lines WHERE money IS NOT NULL
  UNION ALL
  SELECT author, chat_id, message_id, money, money_at, money_at + CAST(length(money) AS INT),
         crit, crit_at, crit_at + CAST(length(crit) AS INT), 'PRICE_CRIT'
  FROM lines WHERE money IS NOT NULL AND crit IS NOT NULL)"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(LINES, **{name: table(spark, folder, name) for name in _TABLES})


def _entity(label: str, text: str, at: str) -> Column:
    return F.struct(
        F.lit(label).alias("label"),
        F.col(text).alias("text"),
        F.col(at).alias("start"),
        (F.col(at) + F.length(text)).alias("end"),
    )


def entities(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """Entities of the lines; `rows`: the lines, if they are at hand."""
    kinds = F.array(
        *[
            F.struct((F.col("line_no") * 10 + n).cast("int").alias("pos"), *[_entity(label, text, at)[f].alias(f) for f in ("label", "text", "start", "end")])
            for label, text, at, n in _KINDS
        ]
    )
    return (
        (lines(spark, folder) if rows is None else rows)
        .select(F.col("author").alias("user"), "chat_id", "message_id", F.inline(kinds))
        .filter("text IS NOT NULL")
    )


def relations(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """Gold relations of the lines; `rows`: the lines, if they are at hand."""
    end = lambda text, at: F.struct(
        F.col(text).alias("text"), F.col(at).alias("start"), (F.col(at) + F.length(text)).alias("end")
    )
    kinds = F.array(
        F.struct(end("prod", "prod_at").alias("head"), end("money", "money_at").alias("tail"), F.lit(PROD_PRICE).alias("label")),
        F.struct(end("money", "money_at").alias("head"), end("crit", "crit_at").alias("tail"), F.lit(PRICE_CRIT).alias("label")),
    )
    return (
        (lines(spark, folder) if rows is None else rows)
        .filter("money IS NOT NULL")
        .select(F.col("author").alias("user"), "chat_id", "message_id", F.inline(kinds))
        .filter("tail.text IS NOT NULL")
    )


def line_entities(item) -> Column:
    """The entities of a line as an array of `item` (kind 0), as `entities` has them."""
    found = [
        F.when(F.col(text).isNotNull(), item(kind=F.lit(0), label=F.lit(label), start=F.col(at), end=F.col(at) + F.length(text), text=F.col(text), pos=F.col("line_no") * 10 + n))
        for label, text, at, n in _KINDS
    ]
    return F.array_compact(F.array(*found))


def line_relations(item) -> Column:
    """The gold relations of a line as an array of `item` (kind 2), as `relations` has them."""
    gold = lambda head, tail, label: item(
        kind=F.lit(2), label=F.lit(label), start=F.col(f"{head}_at"), end=F.col(f"{head}_at") + F.length(head), other=F.col(f"{tail}_at")
    )
    priced, limited = F.col("money").isNotNull(), F.col("crit").isNotNull()
    return F.array_compact(F.array(F.when(priced, gold("prod", "money", PROD_PRICE)), F.when(priced & limited, gold("money", "crit", PRICE_CRIT))))


# Texts with characters that are not printable: a joiner, a bell, or a soft mark, by key.
_MARKS = (("an", "a\u200dn"), ("er", "\u0007er"), ("on", "on\u00ad"))


def dirty(text: Column, key: Column) -> Column:
    out = text
    for i, (old, new) in enumerate(_MARKS):
        out = F.when(key % 4 == i, F.replace(text, F.lit(old), F.lit(new))).otherwise(out)
    return out


def dirty_sql(text: str, key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN replace({text}, '{old}', '{new}')" for i, (old, new) in enumerate(_MARKS))
    return f"CASE {key} % 4 {cases} ELSE {text} END"


# Conversations as messages. A user who goes on after the third turn has changed the user name. Offsets are one or two
# hours by turn; some messages are null or blank.
MESSAGES = """
SELECT 'chat' || CAST(conv_id AS STRING) AS chat_id, turn AS message_id,
       role || '_' || CAST(conv_id % 10 AS STRING) AS user_id, CASE WHEN turn > 3 THEN role END AS username,
       TIMESTAMP '2024-01-01 00:00:00' + CAST((conv_id * 7 + turn * 3) * 10 AS INT) * INTERVAL '1' MINUTE AS ts_local,
       TIMESTAMP '2024-01-01 00:00:00' + CAST((conv_id * 7 + turn * 3) * 10 - 60 * (1 + turn % 2) AS INT) * INTERVAL '1' MINUTE AS ts,
       CASE WHEN (conv_id + turn) % 11 = 3 THEN NULL WHEN (conv_id + turn) % 13 = 5 THEN ' ' ELSE text END AS text
FROM {conversations}
"""
MESSAGES_SQL = MESSAGES.format(conversations="conversations")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    flat = spark.sql(MESSAGES, conversations=table(spark, folder, "conversations"))
    nothing = F.lit(None).cast("string")
    user = F.struct(
        F.col("user_id").alias("id"),
        nothing.alias("first_name"),
        nothing.alias("last_name"),
        F.col("username").alias("username"),
        nothing.alias("phone"),
    )
    return flat.select(
        "chat_id",
        F.col("message_id").cast("long").alias("message_id"),
        user.alias("user"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("ts_local").cast("timestamp_ntz").alias("ts_local"),
        "text",
    )


def user_name(user: str = "user") -> Column:
    """A user as text for flat results."""
    return F.concat_ws("/", f"{user}.id", f"{user}.username")


USER_NAME_SQL = "concat_ws('/', user_id, username)"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Posting times; an event of the same author at the same time counts once."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("user"), F.col("ts").cast("timestamp_ntz").alias("ts_local")
    )


def _span_range(k: Column) -> tuple[Column, Column]:
    start = k * SPAN_STEP + k % 3
    return start.cast("int"), (start + 5 + k % 7).cast("int")


def _span_label(k: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in SPAN_LABELS]), k % len(SPAN_LABELS))


def _last_span(length: Column) -> Column:
    return F.floor((length - 21) / SPAN_STEP).cast("int")


def _spans(length: Column) -> Column:
    """A span every SPAN_STEP characters, cut without regard to words."""

    def span(k: Column) -> Column:
        start, end = _span_range(k)
        return F.struct(start.alias("start"), end.alias("end"), _span_label(k).alias("label"))

    spans = F.transform(F.sequence(F.lit(0), _last_span(length)), span)
    return F.when(length > 20, spans).otherwise(F.array().cast("array<struct<start: int, end: int, label: string>>"))


def _relations(length: Column) -> Column:
    """Neighbouring product and price, price and length."""

    def relation(k: Column) -> Column:
        (start1, end1), (start2, end2) = _span_range(k), _span_range(k + 1)
        return F.struct(
            start1.alias("start1"),
            end1.alias("end1"),
            start2.alias("start2"),
            end2.alias("end2"),
            F.when(_span_label(k) == "PROD", PROD_PRICE).otherwise(PRICE_CRIT).alias("label"),
        )

    heads = F.filter(F.sequence(F.lit(0), _last_span(length) - 1), lambda k: _span_label(k).isin("PROD", "MONEY"))
    nothing = F.array().cast("array<struct<start1: int, end1: int, start2: int, end2: int, label: string>>")
    return F.when(length > 20 + SPAN_STEP, F.transform(heads, relation)).otherwise(nothing)


def annotated(df: DataFrame) -> DataFrame:
    length = F.length("text")
    return df.withColumns({"spans": _spans(length), "relations": _relations(length)})


def docs(spark: SparkSession, folder: str) -> DataFrame:
    source = F.col("source")
    split = F.when(source.isin("src1", "src2"), "dev").when(source.isin("src3", "src4"), "test").otherwise("train")
    return annotated(
        table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "source", split.alias("split"))
    )


def marked_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of two sources carry a helper label."""
    helper = F.when(F.col("source") == "src5", "NOT_INCLUDED").when(F.col("source") == "src6", "NO_ANNOTATION")
    extra = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), helper.alias("label"))
    return docs(spark, folder).withColumn(
        "spans", F.when(helper.isNotNull(), F.concat("spans", F.array(extra))).otherwise(F.col("spans"))
    )


def _spans_sql(source: str, key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(SPAN_LABELS))
    return f"""(SELECT {key}, text, k AS pos, p + k % 3 AS s, p + k % 3 + 5 + k % 7 AS e, CASE k % 6 {cases} END AS label
      FROM (SELECT {key}, text, p, p // {SPAN_STEP} AS k FROM (
        SELECT {key}, text, unnest(range(0, length(text) - 20, {SPAN_STEP})) AS p FROM {source})))"""


DOCS_SQL = """docs AS (SELECT doc_id AS id, text, source,
  CASE WHEN source IN ('src1', 'src2') THEN 'dev' WHEN source IN ('src3', 'src4') THEN 'test' ELSE 'train' END AS split
  FROM documents)"""
SPANS_SQL = f"{DOCS_SQL}, spans AS {_spans_sql('docs', 'id')}"
MESSAGE_SPANS_SQL = f"msgs AS ({MESSAGES_SQL}), spans AS {_spans_sql('msgs', 'chat_id, message_id')}"
DOC_RELATIONS_SQL = """doc_rels AS (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY a.pos) - 1 AS rel_pos,
  a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, CASE a.label WHEN 'PROD' THEN 'PROD_PRICE' ELSE 'PRICE_CRIT' END AS label
  FROM spans a JOIN spans b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.label IN ('PROD', 'MONEY'))"""


def class_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("class"), F.col("label")).alias("class"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A vector per word of the part names, picked by the word's letters."""
    words = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    pick = (F.ascii("token") + F.length("token") * 10).cast("long")
    return words.withColumn("vec_id", pick).join(vectors, "vec_id").select("token", "vector")


TOKEN_VECTORS_SQL = """words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part),
  dims AS (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  token_dims AS (SELECT token, dim, x FROM words JOIN dims ON vec_id = ascii(token) + length(token) * 10)"""


def part_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_name").alias("item"))
