"""Queries over messages, entities, profiles, offers and activity."""

from pyspark.sql import functions as F

from stallbook.catalog import inputs
from stallbook.catalog.inputs import (
    ENTITIES_SQL,
    LINES_SQL,
    MESSAGE_SPANS_SQL,
    MESSAGES_SQL,
    PART_FAMILIES,
    RELATIONS_SQL,
    USER_NAME_SQL,
    user_name,
)
from stallbook.catalog.registry import SQL, flat, query, r6
from stallbook.functions.text import LENGTH_PATTERN, NUMBER_WORDS, is_float, normalize_price, normalize_product_name, number_word, subscription_length
from stallbook.operators import activity, corpus, messages, offers, pairing, summaries
from stallbook.plans import jobs
from stallbook.scratch import fresh_dir, stored
from stallbook.sources import chats, profiles

# --- nearest prices and product summaries -------------------------------------------------------------

# Each product end with the best price: smallest distance, then first in the text, then first annotated.
NEAR_SQL = f"""{ENTITIES_SQL},
 prods AS (SELECT * FROM ents WHERE label = 'PROD'),
 money AS (SELECT chat_id, message_id, s, e, text, pos FROM ents WHERE label = 'MONEY'),
 ends AS (SELECT DISTINCT chat_id, message_id, e FROM prods),
 best AS (SELECT d.chat_id, d.message_id, d.e, m.text AS price_text, m.s AS price_s, m.e AS price_e, m.pos AS price_pos,
                 abs(m.s - d.e) AS dist,
                 row_number() OVER (PARTITION BY d.chat_id, d.message_id, d.e
                                    ORDER BY abs(m.s - d.e), m.s, m.pos, m.e, m.text) AS rk,
                 row_number() OVER (PARTITION BY d.chat_id, d.message_id, d.e
                                    ORDER BY abs(m.s - d.e), m.pos, m.s, m.e, m.text) AS rk_pos
          FROM ends d JOIN money m ON d.chat_id = m.chat_id AND d.message_id = m.message_id),
 mentions AS (SELECT p.author, p.chat_id, p.message_id, p.pos, p.text, p.s, p.e, b.price_text, b.price_s, b.price_e
              FROM prods p LEFT JOIN best b ON p.chat_id = b.chat_id AND p.message_id = b.message_id AND p.e = b.e AND b.rk = 1)"""

SUMMARY_SQL = f"""{NEAR_SQL},
 summary AS (SELECT author, lower(text) AS product_key,
   arg_min(text, struct_pack(a := chat_id, b := message_id, c := s, d := text)) AS product,
   count(DISTINCT price_text) AS n_prices, count(DISTINCT struct_pack(a := chat_id, b := message_id)) AS n_messages
   FROM mentions GROUP BY author, lower(text))"""


def mentions(spark, folder):
    return pairing.nearest_price(inputs.entities(spark, folder))


def product_summaries(spark, folder):
    return summaries.product_summary(mentions(spark, folder))


MENTION_COLUMNS = "author, chat_id, message_id, pos, text, s AS start_at, e AS end_at, price_text, price_s AS price_start, price_e AS price_end"


@query("j2_nearest_price", f"WITH {NEAR_SQL} SELECT {MENTION_COLUMNS} FROM mentions")
def j2(spark, folder):
    return flat(mentions(spark, folder))


@query(
    "j3_nearest_price_capped",
    f"""WITH {NEAR_SQL} SELECT p.author, p.chat_id, p.message_id, p.pos, p.text, p.s AS start_at, p.e AS end_at,
        b.price_text, b.price_s AS price_start, b.price_e AS price_end
        FROM prods p JOIN best b ON p.chat_id = b.chat_id AND p.message_id = b.message_id AND p.e = b.e
        WHERE b.rk_pos = 1 AND b.dist < 200""",
)
def j3(spark, folder):
    return flat(pairing.nearest_price(inputs.entities(spark, folder), max_distance=200, tie="annotation"))


@query("a1_product_summary", f"WITH {SUMMARY_SQL} SELECT * FROM summary")
def a1(spark, folder):
    return flat(product_summaries(spark, folder))


@query(
    "a1_product_prices",
    f"WITH {NEAR_SQL} SELECT DISTINCT author, lower(text) AS product_key, price_text FROM mentions WHERE price_text IS NOT NULL",
)
def a1_prices(spark, folder):
    return flat(summaries.product_prices(mentions(spark, folder)))


@query(
    "a1_product_messages",
    f"WITH {NEAR_SQL} SELECT DISTINCT author, lower(text) AS product_key, chat_id, message_id FROM mentions",
)
def a1_messages(spark, folder):
    return flat(summaries.product_messages(mentions(spark, folder)))


@query("w4_sorted_products", f"WITH {SUMMARY_SQL} SELECT * FROM summary ORDER BY author, product, product_key")
def w4(spark, folder):
    return flat(summaries.sorted_products(product_summaries(spark, folder)))


@query(
    "j4_candidate_counts",
    f"""WITH {ENTITIES_SQL}, n AS (SELECT chat_id, message_id, count(*) FILTER (label = 'PROD') AS p,
          count(*) FILTER (label = 'MONEY') AS m, count(*) FILTER (label = 'CRIT') AS c FROM ents GROUP BY ALL)
        SELECT chat_id, message_id, 'PROD' AS head, 'MONEY' AS tail, p * m AS n_pairs FROM n WHERE p * m > 0
        UNION ALL SELECT chat_id, message_id, 'MONEY', 'CRIT', m * c FROM n WHERE m * c > 0""",
)
def j4(spark, folder):
    return pairing.candidate_counts(inputs.entities(spark, folder))


def adjacent_sql(head, tail):
    return f"""{ENTITIES_SQL}, p AS (SELECT DISTINCT chat_id, message_id, s, e, text FROM ents WHERE label = '{head}'),
        other AS (SELECT chat_id, message_id, s, e, text, pos FROM ents WHERE label = '{tail}'),
        sided AS (SELECT p.*, m.text AS price_text, m.s AS price_s, CAST(m.s > p.e AS INT) AS is_after, m.pos, m.e AS price_e
          FROM p JOIN other m ON p.chat_id = m.chat_id AND p.message_id = m.message_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id, s, e, text, is_after
          ORDER BY abs(price_s - e), pos, price_e, price_text) AS rk FROM sided),
        pairs AS (SELECT chat_id, message_id, s, e, text, is_after, price_text, price_s, price_e FROM ranked WHERE rk = 1)"""


PAIR_KINDS = {"candidates": ("PROD", "MONEY", "PROD_PRICE"), "lengths": ("MONEY", "CRIT", "PRICE_CRIT")}
for _name, (_head, _tail, _label) in PAIR_KINDS.items():

    def _j4(spark, folder, pair=(_head, _tail)):
        pairs = pairing.adjacent_candidates(inputs.entities(spark, folder), pair=pair)
        shown = pairs.withColumns({"price_text": F.col("price.text"), "price_start": F.col("price.start")}).drop("price")
        return flat(shown)

    query(
        f"j4_adjacent_{_name}",
        f"""WITH {adjacent_sql(_head, _tail)} SELECT chat_id, message_id, s AS start_at, e AS end_at, text, is_after, price_text,
            price_s AS price_start FROM pairs""",
    )(_j4)

    def _j4_missed(spark, folder, pair=(_head, _tail), label=_label):
        gold = inputs.relations(spark, folder).filter(F.col("label") == label)
        return pairing.missed_relations(pairing.adjacent_candidates(inputs.entities(spark, folder), pair=pair), gold)

    query(
        f"j4_missed_{_name}",
        f"""WITH {adjacent_sql(_head, _tail)}, rels AS{RELATIONS_SQL.split(", rels AS", 1)[1]}, built AS (SELECT DISTINCT chat_id, message_id, s, e, price_s FROM pairs)
            SELECT count(*) AS n_gold, count(*) FILTER (built.s IS NULL) AS n_missed FROM rels r LEFT JOIN built ON r.chat_id = built.chat_id
              AND r.message_id = built.message_id AND r.head_s = built.s AND r.head_e = built.e AND r.tail_s = built.price_s
            WHERE r.label = '{_label}'""",
    )(_j4_missed)


# --- messages and annotated messages ------------------------------------------------------------------

MSG_SQL = f"msgs AS ({MESSAGES_SQL}), m AS (SELECT *, {USER_NAME_SQL} AS author FROM msgs)"


@query("p1_non_blank", f"WITH {MSG_SQL} SELECT chat_id, message_id, author, text FROM m WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')")
def p1(spark, folder):
    found = messages.non_blank(inputs.messages(spark, folder))
    return found.select("chat_id", "message_id", user_name().alias("author"), "text")


@query(
    "j1_messages_per_user",
    f"""WITH {MSG_SQL} SELECT author, count(*) AS n_messages,
        count(*) FILTER (regexp_matches(text, '[^\\s\\p{{Z}}]')) AS n_visible FROM m GROUP BY author""",
)
def j1(spark, folder):
    found = messages.messages_per_user(inputs.messages(spark, folder))
    return found.select(user_name().alias("author"), "n_messages", "n_visible")


ANNOTATED_SQL = f"""{MESSAGE_SPANS_SQL}, ents AS (SELECT m.chat_id, m.message_id, {USER_NAME_SQL} AS author, s.pos, s.label,
  substring(s.text, CAST(s.s + 1 AS BIGINT), CAST(s.e - s.s AS BIGINT)) AS text, s.s, s.e
  FROM spans s JOIN msgs m ON s.chat_id = m.chat_id AND s.message_id = m.message_id)"""
ENTITY_COLUMNS = "chat_id, message_id, author, CAST(pos AS INT) AS pos, label, text, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at"


def annotated_messages(spark, folder):
    return inputs.annotated(inputs.messages(spark, folder))


@query("p11_named_entities", f"WITH {ANNOTATED_SQL} SELECT {ENTITY_COLUMNS} FROM ents")
def p11(spark, folder):
    found = messages.named_entities(annotated_messages(spark, folder))
    return flat(found.withColumn("user", user_name()))


@query(
    "p12_relations",
    f"""WITH {ANNOTATED_SQL} SELECT a.chat_id, a.message_id, a.author, a.text AS head_text, CAST(a.s AS INT) AS head_start,
        CAST(a.e AS INT) AS head_end, b.text AS tail_text, CAST(b.s AS INT) AS tail_start, CAST(b.e AS INT) AS tail_end,
        CASE a.label WHEN 'PROD' THEN 'PROD_PRICE' ELSE 'PRICE_CRIT' END AS label
        FROM ents a JOIN ents b ON a.chat_id = b.chat_id AND a.message_id = b.message_id AND b.pos = a.pos + 1
        WHERE a.label IN ('PROD', 'MONEY')""",
)
def p12(spark, folder):
    found = messages.relation_rows(annotated_messages(spark, folder))
    ends = [F.col(f"{side}.{part}").alias(f"{side}_{part}") for side in ("head", "tail") for part in ("text", "start", "end")]
    return found.select("chat_id", "message_id", user_name().alias("author"), *ends, "label")


@query(
    "j10_line_highlights",
    f"""WITH {ANNOTATED_SQL}, cut AS (SELECT chat_id, message_id, string_split(text, chr(10)) AS ls FROM msgs),
        l0 AS (SELECT chat_id, message_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM cut),
        ls AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY chat_id, message_id ORDER BY line_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l0)
        SELECT e.chat_id, e.message_id, CAST(line_no AS INT) AS line_no, CAST(e.s - o AS INT) AS line_start,
          CAST(least(e.e - o, length(line)) AS INT) AS line_end, e.label,
          substring(line, CAST(e.s - o + 1 AS BIGINT), CAST(least(e.e - o, length(line)) - (e.s - o) AS BIGINT)) AS marked
        FROM ents e JOIN ls ON e.chat_id = ls.chat_id AND e.message_id = ls.message_id AND e.s >= o AND e.s < o + length(line)""",
)
def j10(spark, folder):
    found = annotated_messages(spark, folder)
    return corpus.line_highlights(found, messages.named_entities(found), ["chat_id", "message_id"])


@query(
    "j9_messages_for_product",
    f"""WITH {ANNOTATED_SQL}, pm AS (SELECT DISTINCT author, lower(text) AS product_key, chat_id, message_id FROM ents WHERE label = 'PROD')
        SELECT pm.author, pm.product_key, pm.chat_id, min(pm.message_id) OVER w AS first_id, pm.message_id,
          count(*) OVER w AS n_messages, coalesce(m.text, '') AS text
        FROM pm JOIN msgs m ON pm.chat_id = m.chat_id AND pm.message_id = m.message_id
        WINDOW w AS (PARTITION BY pm.author, pm.product_key, pm.chat_id, coalesce(m.text, ''))""",
)
def j9(spark, folder):
    found = annotated_messages(spark, folder)
    products = messages.products(messages.named_entities(found)).withColumn("user", user_name())
    return flat(summaries.messages_for_product(summaries.product_messages(products), found))


for _label, _name in (("PROD", "products"), ("MONEY", "prices"), ("LOC", "locations"), ("PER", "persons"), ("PAYM", "payment_methods")):

    def _p5(spark, folder, pick=getattr(messages, _name)):
        return flat(pick(inputs.entities(spark, folder)))

    query(
        f"p5_{_name}",
        f"""WITH {ENTITIES_SQL} SELECT author, chat_id, message_id, pos, label, text, s AS start_at, e AS end_at
            FROM ents WHERE label = '{_label}'""",
    )(_p5)

for _label, _name in (("LOC", "locations"), ("PER", "persons"), ("PAYM", "payments")):

    def _a2(spark, folder, label=_label):
        return flat(summaries.mention_map(inputs.entities(spark, folder), label))

    query(
        f"a2_mention_map_{_name}",
        f"WITH {ENTITIES_SQL} SELECT author, text, chat_id, message_id, count(*) AS n FROM ents WHERE label = '{_label}' GROUP BY ALL",
    )(_a2)

    def _a2_counts(spark, folder, label=_label):
        return flat(summaries.mention_counts(inputs.entities(spark, folder), label))

    query(
        f"a2_mention_counts_{_name}",
        f"WITH {ENTITIES_SQL} SELECT author, text, count(*) AS n_mentions FROM ents WHERE label = '{_label}' GROUP BY ALL",
    )(_a2_counts)


def line_times(lines):
    """Ship dates of an author's lines as posting times."""
    return lines.select(F.col("author").alias("user"), F.col("shipped").cast("timestamp_ntz").alias("ts"), F.col("shipped").cast("timestamp_ntz").alias("ts_local"), F.col("prod").alias("text"))


SUMMARIES_SQL = f"""WITH {SUMMARY_SQL},
  people AS (SELECT author, count(*) FILTER (label = 'LOC') AS n_locations, count(*) FILTER (label = 'PER') AS n_persons,
    count(*) FILTER (label = 'PAYM') AS n_payments FROM ents GROUP BY author),
  times AS (SELECT author, count(DISTINCT shipped) AS n_post_times FROM lines GROUP BY author),
  prod AS (SELECT author, count(*) AS n_products, sum(n_prices) AS n_prices, sum(n_messages) AS n_product_messages FROM summary GROUP BY author)
  SELECT CAST(c_custkey AS STRING) AS author, coalesce(n_products, 0) AS n_products, CAST(coalesce(n_prices, 0) AS BIGINT) AS n_prices,
    CAST(coalesce(n_product_messages, 0) AS BIGINT) AS n_product_messages, coalesce(n_locations, 0) AS n_locations,
    coalesce(n_persons, 0) AS n_persons, coalesce(n_payments, 0) AS n_payments, coalesce(n_post_times, 0) AS n_post_times
  FROM customer LEFT JOIN prod ON prod.author = CAST(c_custkey AS STRING)
  LEFT JOIN people ON people.author = CAST(c_custkey AS STRING) LEFT JOIN times ON times.author = CAST(c_custkey AS STRING)"""


@query("a4_summaries", SUMMARIES_SQL)
def a4(spark, folder):
    rows = stored(inputs.lines(spark, folder), "lines")
    entities = inputs.entities(spark, folder, rows)
    users = inputs.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("user"))
    times = summaries.post_times(line_times(rows))
    return flat(summaries.summaries(pairing.nearest_price(entities), entities, times, users))


# Mentions of annotated messages: the same pairing on the conversation spans.
MSG_NEAR_SQL = f"""{ANNOTATED_SQL}, prods AS (SELECT * FROM ents WHERE label = 'PROD'),
  best AS (SELECT p.chat_id, p.message_id, p.pos, m.text AS price_text,
    row_number() OVER (PARTITION BY p.chat_id, p.message_id, p.pos ORDER BY abs(m.s - p.e), m.s, m.pos) AS rk
    FROM prods p JOIN ents m ON p.chat_id = m.chat_id AND p.message_id = m.message_id AND m.label = 'MONEY'),
  mentions AS (SELECT p.*, b.price_text FROM prods p LEFT JOIN best b
    ON p.chat_id = b.chat_id AND p.message_id = b.message_id AND p.pos = b.pos AND b.rk = 1),
  summary AS (SELECT author, lower(text) AS product_key, count(DISTINCT price_text) AS n_prices,
    count(DISTINCT struct_pack(a := chat_id, b := message_id)) AS n_messages FROM mentions GROUP BY ALL)"""
A5_SQL = f"""WITH {MSG_NEAR_SQL},
  people AS (SELECT author, count(*) FILTER (label = 'LOC') AS n_locations, count(*) FILTER (label = 'PER') AS n_persons,
    count(*) FILTER (label = 'PAYM') AS n_payments FROM ents GROUP BY author),
  times AS (SELECT {USER_NAME_SQL} AS author, count(DISTINCT ts) FILTER (regexp_matches(text, '[^\\s\\p{{Z}}]')) AS n_post_times FROM msgs GROUP BY ALL),
  prod AS (SELECT author, count(*) AS n_products, sum(n_prices) AS n_prices, sum(n_messages) AS n_product_messages FROM summary GROUP BY author)
  SELECT t.author, coalesce(n_products, 0) AS n_products, CAST(coalesce(n_prices, 0) AS BIGINT) AS n_prices,
    CAST(coalesce(n_product_messages, 0) AS BIGINT) AS n_product_messages, coalesce(n_locations, 0) AS n_locations,
    coalesce(n_persons, 0) AS n_persons, coalesce(n_payments, 0) AS n_payments, n_post_times
  FROM times t LEFT JOIN prod ON prod.author = t.author LEFT JOIN people ON people.author = t.author"""


@query("a5_extract_profiles", A5_SQL)
def a5(spark, folder):
    tables = jobs.extract_profiles(annotated_messages(spark, folder))
    return flat(tables["summary"].withColumn("user", user_name()))


@query("p7_summary_only", A5_SQL)
def p7(spark, folder):
    return flat(jobs.summary_only(annotated_messages(spark, folder)).withColumn("user", user_name()))


def components(spark, folder):
    return jobs.profile_components(jobs.extract_profiles(annotated_messages(spark, folder)))


def stored_components(spark, folder, rows_per_part=50):
    """Components of all profiles after a round trip; parts are small, so most profiles have several."""
    found = annotated_messages(spark, folder)
    path = fresh_dir(spark, "profiles")
    made = jobs.profile_components(jobs.extract_profiles(found))
    profiles.write_profiles(profiles.nest_profiles(made, messages.users_of(found), rows_per_part), path)
    return profiles.read_profiles(spark, path)


def shown_entities(found):
    columns = [F.col(f"entity.{c}").alias(c) for c in ("label", "text", "start", "end")]
    return flat(found.select(user_name().alias("user"), "chat_id", "message_id", *columns))


def shown_relations(found):
    ends = [F.col(f"{side}.{part}").alias(f"{side}_{part}") for side in ("head", "tail") for part in ("text", "start", "end")]
    return flat(found.select(user_name().alias("user"), "chat_id", "message_id", *ends, "label"))


_ENTS = "author, chat_id, message_id, label, text, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at"
for _kind, _where in (("named_entity", "true"), ("product", "label = 'PROD'"), ("location", "label = 'LOC'"), ("person", "label = 'PER'"), ("payment", "label = 'PAYM'")):

    def _p8(spark, folder, kind=_kind):
        return shown_entities(jobs.components_of(components(spark, folder), kind))

    query(f"p8_{_kind}", f"WITH {ANNOTATED_SQL} SELECT {_ENTS} FROM ents WHERE {_where}")(_p8)

MSG_RELATIONS_SQL = """SELECT a.author, a.chat_id, a.message_id, a.text AS head_text, CAST(a.s AS INT) AS head_start,
        CAST(a.e AS INT) AS head_end, b.text AS tail_text, CAST(b.s AS INT) AS tail_start, CAST(b.e AS INT) AS tail_end,
        CASE a.label WHEN 'PROD' THEN 'PROD_PRICE' ELSE 'PRICE_CRIT' END AS label
        FROM ents a JOIN ents b ON a.chat_id = b.chat_id AND a.message_id = b.message_id AND b.pos = a.pos + 1
        WHERE a.label IN ('PROD', 'MONEY')"""


@query("p8_relation", f"WITH {ANNOTATED_SQL} {MSG_RELATIONS_SQL}")
def p8_relation(spark, folder):
    return shown_relations(jobs.relations_of(components(spark, folder)))


@query("p8_summary", A5_SQL)
def p8_summary(spark, folder):
    return flat(jobs.summaries_of(components(spark, folder)).withColumn("user", user_name()))


@query(
    "p9_profile_for",
    f"""WITH {ANNOTATED_SQL}, chosen AS (SELECT {USER_NAME_SQL} AS author FROM msgs WHERE user_id = 'user_1' ORDER BY username NULLS FIRST LIMIT 1)
        SELECT {_ENTS} FROM ents WHERE author = (SELECT author FROM chosen)""",
)
def p9(spark, folder):
    chosen = messages.profile_for(stored_components(spark, folder, rows_per_part=5), user_id="user_1")
    return shown_entities(jobs.components_of(profiles.components_in(chosen), "named_entity"))


@query("a3_post_times", f"WITH {MSG_SQL} SELECT author, ts, min(ts_local) AS ts_local FROM m WHERE regexp_matches(text, '[^\\s\\p{{Z}}]') GROUP BY author, ts")
def a3(spark, folder):
    return flat(summaries.post_times(inputs.messages(spark, folder)).withColumn("user", user_name()))


@query(
    "a11_message_date_range",
    f"""WITH {MSG_SQL} SELECT min(ts_local) AS first_ts, max(ts_local) AS last_ts,
        date_diff('second', min(ts_local), max(ts_local)) AS seconds FROM m""",
)
def a11(spark, folder):
    found = activity.message_date_range(inputs.messages(spark, folder).withColumn("ts", F.col("ts_local")))
    return found.withColumnsRenamed({"first": "first_ts", "last": "last_ts"})


# --- exports and profile collections ------------------------------------------------------------------

# Exports hold at most this many messages, as their own limit field says.
EXPORT_LIMIT = 500


def write_exports(spark, folder, **options):
    """Conversations as chat exports, one per line; the declared count is twice the number of user turns."""
    rows = inputs.messages(spark, folder)
    message = F.struct(
        F.col("message_id").alias("id"),
        "user",
        F.concat(F.date_format("ts_local", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("message_id") % 2 == 1, "+02:00").otherwise("+0100")).alias("datetime"),
        F.col("text").alias("message"),
        F.lit(None).cast("long").alias("reply_to"),
        F.array(F.lit("text")).alias("type"),
    )
    exports = rows.groupBy("chat_id", F.floor(F.col("message_id") / EXPORT_LIMIT).alias("part")).agg(
        F.sort_array(F.collect_list(message)).alias("messages"),
        F.struct(
            F.lit("2024-03-01T00:00:00+0000").alias("date"),
            (2 * F.count_if(F.col("user.id").startswith("user"))).alias("message_count"),
            F.lit(EXPORT_LIMIT).alias("message_count_limit"),
            F.min("chat_id").alias("source"),
        ).alias("info"),
    )
    path = fresh_dir(spark, "exports")
    if options.get("maxRecordsPerFile"):
        # A file costs more than its bytes show, so all cores write.
        exports = exports.repartition(4 * spark.sparkContext.defaultParallelism, "chat_id", "part")
    exports.select("info", "messages").write.options(**options).json(path)
    return path


@query(
    "s1_read_chat",
    f"""WITH {MSG_SQL} SELECT chat_id AS source, message_id, user_id, username, ts, ts_local, text FROM m""",
)
def s1(spark, folder):
    exports = chats.read_exports(spark, write_exports(spark, folder), multi_line=False)
    # Each export is a chat of its own: its id leads to one source.
    sources = exports.select("chat_id", F.col("info.source").alias("source")).distinct()
    return chats.messages_of(exports).join(sources, "chat_id").select(
        "source",
        "message_id",
        F.col("user.id").alias("user_id"),
        F.col("user.username").alias("username"),
        F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        "ts_local",
        "text",
    )


@query("s1_read_large_chat", SQL["s1_read_chat"])
def s1_large(spark, folder):
    """Exports of one file each, read in byte ranges far smaller than a file."""
    rows = stored(chats.read_ranges(spark, write_exports(spark, folder, maxRecordsPerFile=1), range_bytes=1 << 16), "ranges")
    sources = rows.filter("info IS NOT NULL").select("chat_id", F.col("info.source").alias("source"))
    return chats.ranged_messages(rows).join(sources, "chat_id").select(
        "source",
        "message_id",
        F.col("user.id").alias("user_id"),
        F.col("user.username").alias("username"),
        F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        "ts_local",
        "text",
    )


@query(
    "s2_validate_message_count",
    f"""WITH {MSG_SQL} SELECT chat_id AS source, 2 * count(*) FILTER (user_id LIKE 'user%') AS declared, count(*) AS actual
        FROM m GROUP BY chat_id, message_id // {EXPORT_LIMIT} HAVING 2 * count(*) FILTER (user_id LIKE 'user%') <> count(*)""",
)
def s2(spark, folder):
    exports = chats.read_exports(spark, write_exports(spark, folder), multi_line=False)
    sources = exports.select("chat_id", F.col("info.source").alias("source")).distinct()
    return chats.count_violations(exports).join(sources, "chat_id").drop("chat_id")


@query("s9_profile_round_trip", f"WITH {ANNOTATED_SQL} SELECT {_ENTS} FROM ents")
def s9(spark, folder):
    return shown_entities(jobs.components_of(profiles.components_in(stored_components(spark, folder)), "named_entity"))


@query("s9_stored_relations", f"WITH {ANNOTATED_SQL} {MSG_RELATIONS_SQL}")
def s9_relations(spark, folder):
    return shown_relations(jobs.relations_of(profiles.components_in(stored_components(spark, folder))))


@query("s9_stored_summaries", A5_SQL)
def s9_summaries(spark, folder):
    return flat(jobs.summaries_of(profiles.components_in(stored_components(spark, folder))).withColumn("user", user_name()))


@query(
    "j5_offers_from_profiles",
    f"""WITH {ANNOTATED_SQL}, r AS ({MSG_RELATIONS_SQL}), p AS (SELECT * FROM r WHERE label = 'PROD_PRICE'), c AS (SELECT * FROM r WHERE label <> 'PROD_PRICE')
        SELECT p.author, p.chat_id, p.message_id, p.head_text AS product, p.tail_text AS price, c.tail_text AS crit FROM p LEFT JOIN c
          ON c.author = p.author AND c.chat_id = p.chat_id AND c.message_id = p.message_id
          AND (c.head_text, c.head_start, c.head_end) = (p.tail_text, p.tail_start, p.tail_end)""",
)
def j5_from_profiles(spark, folder):
    relations = jobs.relations_of(profiles.components_in(stored_components(spark, folder)))
    return flat(offers.offer_candidates(relations).withColumn("user", user_name()))


# --- offers and prices --------------------------------------------------------------------------------

_LENGTH = LENGTH_PATTERN
_WORDS = " ".join(f"WHEN '{w}' THEN {n}" for w, n in NUMBER_WORDS.items())


def price_sql(text: str) -> str:
    kept = f"replace(regexp_replace({text}, '[^0-9 .,]', '', 'g'), ',', '.')"
    return f"coalesce(TRY_CAST(regexp_replace({kept}, '\\.$', '') AS DOUBLE), -1.0)"


def word_sql(text: str) -> str:
    return f"coalesce(CASE {text} {_WORDS} END, TRY_CAST({text} AS BIGINT), 1)"


def months_sql(text: str) -> str:
    low = f"lower({text})"
    number = f"regexp_extract({low}, '{_LENGTH}', 1)"
    unit = f"regexp_extract({low}, '{_LENGTH}', 2)"
    return f"""CASE WHEN regexp_matches({low}, '{_LENGTH}') THEN {word_sql(number)} * CASE WHEN contains({unit}, 'ja') THEN 12 ELSE 1 END
      WHEN contains({low}, 'jah') THEN 12 WHEN contains({low}, 'mon') THEN 1 END"""


CANDIDATES_SQL = f"""{RELATIONS_SQL}, cand AS MATERIALIZED (
  SELECT p.author, p.chat_id, p.message_id, p.head_text AS product, p.tail_text AS price, c.tail_text AS crit
  FROM (SELECT * FROM rels WHERE label = 'PROD_PRICE') p LEFT JOIN (SELECT * FROM rels WHERE label <> 'PROD_PRICE') c
  ON p.author = c.author AND p.chat_id = c.chat_id AND p.message_id = c.message_id
  AND p.tail_text = c.head_text AND p.tail_s = c.head_s AND p.tail_e = c.head_e)"""
_FAMILY_ROWS = ", ".join(f"('{name}', '{part}')" for name, part in PART_FAMILIES.items())
OFFERS_SQL = f"""{CANDIDATES_SQL}, fam(type, part) AS (VALUES {_FAMILY_ROWS}),
  o1 AS (SELECT author, chat_id, message_id, product, type, {price_sql('price')} AS price, crit, {months_sql('crit')} AS months
         FROM cand JOIN fam ON contains(lower(product), part)),
  o2 AS (SELECT *, CASE WHEN crit IS NULL THEN 'none' WHEN months IS NOT NULL THEN 'months'
         WHEN contains(lower(crit), 'lif') THEN 'lifetime' END AS crit_kind FROM o1),
  offers AS MATERIALIZED (SELECT author, chat_id, message_id, product, type, price, crit_kind, months AS crit_months,
    CASE WHEN months <> 0 THEN price / months END AS price_per_month, crit_kind = 'months' AS is_normalized, price >= 0 AS is_priced
    FROM o2 WHERE crit_kind IS NOT NULL)"""


def offer_table(spark, folder):
    candidates = offers.offer_candidates(inputs.relations(spark, folder))
    return offers.normalize_offers(candidates, PART_FAMILIES)


def _shown_offers(df):
    return flat(df.withColumns({"price": r6("price"), "price_per_month": r6("price_per_month")}))


_OFFER_COLUMNS = """author, chat_id, message_id, product, type, round(price, 6) + 0.0 AS price, crit_kind, crit_months,
  round(price_per_month, 6) + 0.0 AS price_per_month, is_normalized, is_priced"""


@query("j5_offer_candidates", f"WITH {CANDIDATES_SQL} SELECT author, chat_id, message_id, product, price, crit FROM cand")
def j5(spark, folder):
    return flat(offers.offer_candidates(inputs.relations(spark, folder)))


@query("n5_normalize_offer", f"WITH {OFFERS_SQL} SELECT {_OFFER_COLUMNS} FROM offers")
def n5(spark, folder):
    return _shown_offers(offer_table(spark, folder))


@query("s10_write_offers", f"WITH {OFFERS_SQL} SELECT {_OFFER_COLUMNS} FROM offers")
def s10(spark, folder):
    path = fresh_dir(spark, "offers")
    found = offer_table(spark, folder)
    profiles.write_offers([found.filter("chat_id = 'F'"), found.filter("chat_id <> 'F'")], path)
    return _shown_offers(spark.read.schema(found.schema).parquet(path))


for _name, _pick, _where in (
    ("box", offers.box_offers, "crit_kind = 'months' AND price_per_month < 25 AND price < 100"),
    ("scatter", offers.scatter_offers, "crit_kind = 'months' AND crit_months < 50 AND price_per_month < 25"),
):

    def _p13(spark, folder, pick=_pick):
        return _shown_offers(pick(offer_table(spark, folder)))

    query(f"p13_{_name}_offers", f"WITH {OFFERS_SQL} SELECT {_OFFER_COLUMNS} FROM offers WHERE {_where}")(_p13)

HISTOGRAM_SQL = f"""{OFFERS_SQL}, shown AS (SELECT *, CASE crit_kind WHEN 'none' THEN 'unknown' WHEN 'lifetime' THEN 'lifetime'
    ELSE CAST(crit_months AS STRING) END AS length_class FROM offers),
  hist AS (SELECT * FROM shown WHERE length_class IN ('1', '12', '24', '36', 'lifetime', 'unknown') AND type IN ('Widget', 'Gizmo', 'Bolt'))"""
HISTOGRAM_TYPES = ["Widget", "Gizmo", "Bolt"]


@query("p13_histogram_offers", f"WITH {HISTOGRAM_SQL} SELECT {_OFFER_COLUMNS}, length_class FROM hist")
def p13_histogram(spark, folder):
    return _shown_offers(offers.histogram_offers(offer_table(spark, folder), HISTOGRAM_TYPES))


@query(
    "a16_subscription_histogram",
    f"""WITH {HISTOGRAM_SQL} SELECT type, length_class, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (PARTITION BY type), 6) + 0.0 AS share FROM hist GROUP BY type, length_class""",
)
def a16(spark, folder):
    found = offers.subscription_histogram(offer_table(spark, folder), HISTOGRAM_TYPES)
    return found.withColumn("share", r6("share"))


@query(
    "a17_price_trend",
    f"""WITH {OFFERS_SQL} SELECT type, count(*) AS n, round(regr_slope(price_per_month, log10(crit_months)), 6) + 0.0 AS slope,
        round(regr_intercept(price_per_month, log10(crit_months)), 6) + 0.0 AS intercept,
        round(regr_r2(price_per_month, log10(crit_months)), 6) + 0.0 AS r2
        FROM offers WHERE crit_kind = 'months' AND crit_months < 50 AND price_per_month < 25 GROUP BY type""",
)
def a17(spark, folder):
    found = offers.price_trend(offer_table(spark, folder))
    return found.withColumns({c: r6(c) for c in ("slope", "intercept", "r2")})


def _five_sql(value: str) -> str:
    names = zip(("min", "q1", "median", "q3", "max"), (0, 0.25, 0.5, 0.75, 1))
    return ", ".join(f"round(quantile_cont({value}, {q}), 6) + 0.0 AS {name}_value" for name, q in names)


def _shown_box(df):
    return df.select(*[c for c in df.columns if c not in ("min", "q1", "median", "q3", "max")],
                     *[r6(c).alias(f"{c}_value") for c in ("min", "q1", "median", "q3", "max")])


for _value in ("price", "price_per_month"):

    def _a15(spark, folder, value=_value):
        return _shown_box(offers.box_stats(offers.box_offers(offer_table(spark, folder)), ["type"], value))

    query(
        f"a15_box_stats_{_value}",
        f"""WITH {OFFERS_SQL} SELECT type, count(*) AS n, {_five_sql(_value)} FROM offers
            WHERE crit_kind = 'months' AND price_per_month < 25 AND price < 100 GROUP BY type""",
    )(_a15)

RANGES_SQL = f"""{SUMMARY_SQL}, listed AS (SELECT DISTINCT m.author, lower(m.text) AS product_key, m.price_text FROM mentions m WHERE m.price_text IS NOT NULL),
  priced AS (SELECT trim(regexp_replace(replace(lower(s.product), '  ', ' '), '[^A-Za-z ]', '', 'g')) AS product, {price_sql('price_text')} AS price
    FROM listed l JOIN summary s ON l.author = s.author AND l.product_key = s.product_key),
  kept AS (SELECT * FROM priced WHERE price >= 0),
  ranges AS (SELECT product, price, n_prices FROM (SELECT *, count(*) OVER (PARTITION BY product) AS n_prices FROM kept) WHERE n_prices > 15 AND price < 1000)"""


def price_ranges(spark, folder):
    found = stored(mentions(spark, folder), "mentions")
    names = summaries.product_summary(found).select("user", "product_key", "product")
    return offers.product_price_ranges(summaries.product_prices(found).join(names, ["user", "product_key"]))


@query("a14_product_price_ranges", f"WITH {RANGES_SQL} SELECT product, round(price, 6) + 0.0 AS price, count(*) AS n, n_prices FROM ranges GROUP BY ALL")
def a14(spark, folder):
    return price_ranges(spark, folder).select("product", r6("price").alias("price"), "n", "n_prices")


@query("a15_box_stats_products", f"WITH {RANGES_SQL} SELECT product, count(*) AS n, {_five_sql('price')} FROM ranges GROUP BY product")
def a15_products(spark, folder):
    ranges = price_ranges(spark, folder)
    repeated = ranges.select("product", "price", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    return _shown_box(offers.box_stats(repeated.select("product", "price"), ["product"], "price"))


@query("n1_normalize_price", f"WITH lines AS ({LINES_SQL}) SELECT money, round({price_sql('money')}, 6) + 0.0 AS price, count(*) AS n FROM lines WHERE money IS NOT NULL GROUP BY ALL")
def n1(spark, folder):
    money = inputs.lines(spark, folder).filter("money IS NOT NULL")
    return money.select("money", r6(normalize_price(F.col("money"))).alias("price")).groupBy("money", "price").agg(F.count("*").alias("n"))


@query(
    "n2_normalize_product_name",
    """SELECT p_partkey, trim(regexp_replace(replace(lower(p_brand || '  ' || p_name || ' 2'), '  ', ' '), '[^A-Za-z ]', '', 'g')) AS name FROM part""",
)
def n2(spark, folder):
    text = F.concat("p_brand", F.lit("  "), "p_name", F.lit(" 2"))
    return inputs.table(spark, folder, "part").select("p_partkey", normalize_product_name(text).alias("name"))


@query(
    "n3_number_word",
    f"WITH lines AS ({LINES_SQL}), w AS (SELECT string_split(lower(crit), ' ')[1] AS word FROM lines WHERE crit IS NOT NULL) "
    f"SELECT word, {word_sql('word')} AS number, count(*) AS n FROM w GROUP BY ALL",
)
def n3(spark, folder):
    word = F.split(F.lower("crit"), " ")[0]
    words = inputs.lines(spark, folder).filter("crit IS NOT NULL").select(word.alias("word"))
    return words.groupBy("word", number_word(F.col("word")).alias("number")).agg(F.count("*").alias("n"))


@query(
    "n4_subscription_months",
    f"""WITH lines AS ({LINES_SQL}) SELECT crit, {months_sql('crit')} AS months,
        CASE WHEN {months_sql('crit')} IS NOT NULL THEN 'months' WHEN contains(lower(crit), 'lif') THEN 'lifetime' END AS kind,
        count(*) AS n FROM lines WHERE crit IS NOT NULL GROUP BY ALL""",
)
def n4(spark, folder):
    crits = inputs.lines(spark, folder).filter("crit IS NOT NULL").groupBy("crit").agg(F.count("*").alias("n"))
    length = subscription_length(F.col("crit"))
    return crits.withColumn("l", length).select("crit", "l.months", "l.kind", "n")


@query(
    "n6_product_price_mentions",
    f"WITH {NEAR_SQL} SELECT author, chat_id, message_id, text, round({price_sql('price_text')}, 6) + 0.0 AS price FROM mentions "
    "WHERE contains(lower(text), 'widget') AND price_text IS NOT NULL",
)
def n6(spark, folder):
    found = offers.product_price_mentions(mentions(spark, folder), "widget")
    return flat(found.select("user", "chat_id", "message_id", "text", r6("price").alias("price")))


@query("n15_is_float", f"WITH lines AS ({LINES_SQL}) SELECT replace(money, '€', '') AS text, TRY_CAST(replace(money, '€', '') AS DOUBLE) IS NOT NULL AS is_float, count(*) AS n FROM lines WHERE money IS NOT NULL GROUP BY ALL")
def n15(spark, folder):
    text = F.replace(F.col("money"), F.lit("€"), F.lit(""))
    found = inputs.lines(spark, folder).filter("money IS NOT NULL").select(text.alias("text"))
    return found.groupBy("text", is_float(F.col("text")).alias("is_float")).agg(F.count("*").alias("n"))


# --- activity -----------------------------------------------------------------------------------------

TIMES_SQL = "times AS (SELECT DISTINCT user_id AS author, ts FROM events)"
DAILY_SQL = f"""{TIMES_SQL}, daily AS (SELECT author, CAST(ts AS DATE) AS date, count(*) AS n FROM times GROUP BY ALL),
  days AS (SELECT author, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY author)"""


def post_times(spark, folder):
    return inputs.events(spark, folder).distinct()


@query("n16_local_clock", f"WITH {TIMES_SQL} SELECT author, ts AS ts_local, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M:%S') AS time FROM times")
def n16(spark, folder):
    return flat(activity.local_clock(post_times(spark, folder)))


@query("a18_daily_activity", f"WITH {DAILY_SQL} SELECT d.author, d.date, coalesce(x.n, 0) AS n FROM days d LEFT JOIN daily x ON d.author = x.author AND d.date = x.date")
def a18(spark, folder):
    return flat(activity.daily_activity(post_times(spark, folder)))


# The activities of an author one by one: each has days without an event.
BY_TYPE_SQL = """times AS (SELECT DISTINCT CAST(user_id AS STRING) || event_type AS author, ts FROM events),
  daily AS (SELECT author, CAST(ts AS DATE) AS date, count(*) AS n FROM times GROUP BY ALL),
  span AS (SELECT author, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY author)"""


@query("j11_calendar_fill", f"WITH {BY_TYPE_SQL} SELECT s.author, s.date, coalesce(d.n, 0) AS n FROM span s LEFT JOIN daily d ON s.author = d.author AND s.date = d.date")
def j11(spark, folder):
    events = inputs.table(spark, folder, "events")
    author = F.concat(F.col("user_id").cast("string"), "event_type")
    times = events.select(author.alias("user"), F.col("ts").cast("timestamp_ntz").alias("ts_local")).distinct()
    return flat(activity.calendar_fill(activity.posts_per_day(times)))


@query(
    "a19_hourly_activity",
    f"""WITH {TIMES_SQL}, h AS (SELECT author, unnest(range(24)) AS hour FROM (SELECT DISTINCT author FROM times)),
        c AS (SELECT author, hour(ts) AS hour, count(*) AS n FROM times GROUP BY ALL)
        SELECT h.author, CAST(h.hour AS INT) AS hour, coalesce(c.n, 0) AS n FROM h LEFT JOIN c ON h.author = c.author AND h.hour = c.hour""",
)
def a19(spark, folder):
    return flat(activity.hourly_activity(post_times(spark, folder)))


@query("w3_most_active_profile", f"WITH {TIMES_SQL} SELECT author, count(*) AS n FROM times GROUP BY author ORDER BY n DESC, author LIMIT 1")
def w3(spark, folder):
    return flat(activity.most_active_profile(post_times(spark, folder)))


@query(
    "j5_offers_end_to_end",
    f"""WITH {OFFERS_SQL} SELECT type, crit_kind, count(*) AS n, count(*) FILTER (is_priced) AS n_priced,
        round(sum(price), 2) AS total FROM offers GROUP BY type, crit_kind""",
)
def offers_overview(spark, folder):
    return offer_table(spark, folder).groupBy("type", "crit_kind").agg(
        F.count("*").alias("n"), F.count_if("is_priced").alias("n_priced"), F.round(F.sum("price"), 2).alias("total")
    )


