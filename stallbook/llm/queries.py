"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm import (
    conversation_trie,
    decontamination,
    embedding_dedup,
    exact_dedup,
    language,
    learning,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    secrets,
    spelling,
    token_counts,
    toxicity,
)
from stallbook.llm.tokens import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_line_dedup",
    r"""
WITH cut AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut
), keyed AS (
    SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), judged AS (
    SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    joined = line_dedup.with_bitmaps(table(spark, folder, "documents"))
    return joined.select("row.doc_id", line_dedup.kept_digest("row.text", "keep").alias("d")).select("doc_id", "d.*")


@query(
    "op3_decontamination",
    r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), sized AS (
    SELECT item, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0
), windows AS (
    SELECT DISTINCT item, k, array_to_string(list_slice(ws, s, s + k - 1), ' ') AS g
    FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM sized)
), grams AS (
    SELECT doc_id, s, k, array_to_string(list_slice(ws, s, s + k - 1), ' ') AS g
    FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k)
), hits AS (
    SELECT doc_id, s, k, item FROM grams JOIN windows USING (k, g)
), words AS (
    SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
)
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    index = decontamination.build_index(table(spark, folder, "documents"))
    found = decontamination.matches(index, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        decontamination.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query("op8_mixing")
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixing.per_document(mixed).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query(
    "op9_ngram_join",
    r"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), classes AS MATERIALIZED (
    SELECT ws, min(doc_id) AS rep, count(*) AS copies FROM d WHERE len(ws) > 0 AND doc_id IS NOT NULL GROUP BY ws
), grams AS MATERIALIZED (
    SELECT DISTINCT rep, array_to_string(list_slice(ws, s, s + 4), ' ') AS g FROM (SELECT rep, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM classes)
), sizes AS (
    SELECT rep, count(*) AS n FROM grams GROUP BY rep
), common AS (
    SELECT a.rep AS u, b.rep AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep
), links AS MATERIALIZED (
    SELECT u, v FROM common JOIN sizes x ON x.rep = u JOIN sizes y ON y.rep = v WHERE 10 * c >= 8 * (x.n + y.n - c)
), reach AS (
    SELECT rep AS u, rep AS v FROM classes
    UNION
    SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), roots AS (
    SELECT u, min(v) AS class_id FROM reach GROUP BY u
), linked AS (
    SELECT u, sum(copies) AS n FROM links JOIN classes ON rep = v GROUP BY u
)
SELECT d.doc_id, coalesce(class_id, CASE WHEN len(d.ws) = 0 THEN d.doc_id END) AS class_id, coalesce(rep, CASE WHEN len(d.ws) = 0 THEN d.doc_id END) AS copy_of,
    CAST(coalesce(copies - 1 + coalesce(n, 0), 0) AS BIGINT) AS n_links
FROM d LEFT JOIN classes ON classes.ws = d.ws AND d.doc_id IS NOT NULL LEFT JOIN roots ON roots.u = rep LEFT JOIN linked ON linked.u = rep
""",
)
def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"))


def may_learn(spark: SparkSession, folder: str, folds: int, out: int) -> DataFrame:
    return table(spark, folder, "labels").filter(~learning.held_out(folds, out))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, may_learn(spark, folder, 4, 2)))
    return scored.select("doc_id", learning.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


@query("op4_quality")
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.score(docs, quality.fit(docs, may_learn(spark, folder, 3, 1)))
    return scored.select("doc_id", learning.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labelled = language.label(docs, language.fit(docs.filter(~learning.held_out(4, 2))))
    return labelled.select("doc_id", learning.held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(table(spark, folder, "documents"))))


@query("op10_secrets")
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.per_document(table(spark, folder, "documents"))


@query(
    "op7_embedding_dedup",
    r"""
WITH RECURSIVE sound AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), roots AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts USING (vec_id)
""",
)
def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.similar_vectors(table(spark, folder, "embeddings"))


# crc32 of a string, byte by byte: SQL engines have none. The parts fit into any expression over a list of bytes.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda crc, b:
    list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query(
    "op11_conversation_trie",
    """
WITH RECURSIVE turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS own FROM turns GROUP BY conv_id
), headed AS (
    SELECT *, """
    + _CRC32.format(bytes="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))")
    + """ % 6 AS h FROM convs
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(list_slice(b.own, 1, a.h), []), list_slice(a.own, a.h + 1, len(a.own))) AS seq
    FROM headed a LEFT JOIN convs b ON b.conv_id = a.conv_id - a.conv_id % 100
), members AS (
    SELECT conv_id, len(seq) AS n, d, list_slice(seq, 1, d) AS prefix
    FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
        (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(prefix[d].text) END AS saved, bool_and(n = d) AS leaf
    FROM members GROUP BY prefix, d
), above AS (
    SELECT conv_id, d, conv_id AS at, d AS at_d, prefix FROM nodes
    UNION ALL
    SELECT a.conv_id, a.d, p.conv_id, p.d, p.prefix FROM above a JOIN nodes p ON p.d = a.at_d - 1 AND p.prefix = list_slice(a.prefix, 1, a.at_d - 1)
), totals AS (
    SELECT above.at AS conv_id, above.at_d AS d, sum(n.saved) AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves,
        count(*) FILTER (n.d = above.at_d + 1) AS n_children
    FROM above JOIN nodes n ON n.conv_id = above.conv_id AND n.d = above.d GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, t.n_children, t.n_leaves,
    CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.conv_id = n.conv_id AND t.d = n.d
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = list_slice(n.prefix, 1, n.d - 1)
""",
)
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, folder, "conversations"), family=100, heads=6)


@query(
    "op12_exact_dedup",
    r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW same AS (PARTITION BY text)
""",
)
def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.equal_texts(table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op13_spelling",
    r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
), summed AS (
    SELECT run, n, """.replace("\u00C0", chr(0xC0)).replace("\u00FF", chr(0xFF))
    + _CRC32.format(
        bytes="""list_transform(range(1, octet_length(encode(CAST(doc_id AS VARCHAR) || ':' || run)) + 1),
        lambda i: CAST(('0x' || hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)[i:i])) AS BIGINT))"""
    )
    + """ AS h FROM counted
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM summed
    ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), holes AS (
    SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT DISTINCT a.word, b.word AS other, b.n FROM holes a JOIN holes b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word
), formed AS (
    SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form,
        CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS root, 0 AS step FROM formed
    UNION ALL SELECT walk.word, formed.form, step + 1 FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL
), roots AS (
    SELECT word, last(root ORDER BY step) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
""",
)
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))
