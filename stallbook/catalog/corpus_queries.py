"""Queries over annotated corpora, dictionary tagging and quality reports."""

from pyspark.sql import functions as F

from stallbook.catalog import inputs
from stallbook.catalog.inputs import DOC_RELATIONS_SQL, DOCS_SQL, MESSAGE_SPANS_SQL, SPANS_SQL, USER_NAME_SQL
from stallbook.catalog.profile_queries import adjacent_sql
from stallbook.catalog.registry import flat, query, r6
from stallbook.functions.text import (
    NUMBER_WORDS,
    PRINTABLE,
    TOKEN_PATTERN,
    TOKEN_WITH_GAP_PATTERN,
    WHITESPACE,
    is_number_like,
    lower_corpus_line,
    nonprint_chars,
    or_empty,
    replace_nonprint,
    tokenize,
)
from stallbook.operators import alignment, corpus, evaluation, pairing, tag_counts, tagging
from stallbook.operators.messages import named_entities, users_of
from stallbook.operators.vectors import contextual_profile_vectors
from stallbook.plans import jobs
from stallbook.scratch import fresh_dir, stored
from stallbook.sources import corpora

ID = ["id"]
NOTE = f"'[^{PRINTABLE}]'"


def docs(spark, folder):
    return inputs.docs(spark, folder)


def tokens_sql(source: str, key: str) -> str:
    return f"""(SELECT *, e - length(token) AS s FROM (SELECT {key}, idx, piece, regexp_replace(piece, '^[{WHITESPACE}]+', '') AS token,
      CAST(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY idx) AS INT) AS e
      FROM (SELECT {key}, unnest(ps) AS piece, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS idx
        FROM (SELECT {key}, regexp_extract_all(text, '{TOKEN_WITH_GAP_PATTERN}') AS ps FROM {source}))))"""


TOKENS_SQL = f"{SPANS_SQL}, toks AS {tokens_sql('docs', 'id')}"


def span_tokens_sql(spans: str, tokens: str, key: list[str]) -> str:
    """Spans with the tokens they start and end in, as `ranged`."""
    keys = ", ".join(key)
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key)
    return f"""parts AS (SELECT {keys}, pos, s, e, label, substring(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS part FROM {spans}),
  cutted AS (SELECT *, s + length(part) - length(ltrim(part)) AS from_at,
    e - CASE WHEN trim(part) = '' THEN 0 ELSE length(part) - length(rtrim(part)) END AS to_at FROM parts),
  f AS (SELECT {", ".join("c." + k for k in key)}, c.pos, min(t.idx) AS first_tok FROM cutted c JOIN {tokens} t
    ON {on('c', 't')} AND t.s <= c.from_at AND t.e >= c.from_at GROUP BY ALL),
  l AS (SELECT {", ".join("c." + k for k in key)}, c.pos, min(t.idx) AS to_tok FROM cutted c JOIN {tokens} t
    ON {on('c', 't')} AND t.s <= c.to_at AND t.e >= c.to_at GROUP BY ALL),
  final AS (SELECT {keys}, max(idx) AS last_idx FROM {tokens} GROUP BY ALL),
  ranged AS (SELECT {", ".join("c." + k for k in key)}, CAST(c.pos AS INT) AS pos, c.s, c.e, c.label, first_tok,
    coalesce(to_tok, last_idx) AS last_tok, coalesce(first_tok <= coalesce(to_tok, last_idx), false) AS ok
    FROM cutted c LEFT JOIN f ON {on('c', 'f')} AND c.pos = f.pos LEFT JOIN l ON {on('c', 'l')} AND c.pos = l.pos
    LEFT JOIN final ON {on('c', 'final')})"""


RANGED_SQL = f"{TOKENS_SQL}, {span_tokens_sql('spans', 'toks', ['id'])}"
TAGS_SQL = f"""{RANGED_SQL}, covered AS (SELECT t.id, t.idx, arg_max(CASE WHEN t.idx = r.first_tok THEN 'B-' ELSE 'I-' END || r.label, r.pos) AS tag
    FROM toks t JOIN ranged r ON t.id = r.id AND r.ok AND t.idx BETWEEN r.first_tok AND r.last_tok GROUP BY ALL),
  tagged AS (SELECT t.*, coalesce(c.tag, 'O') AS tag FROM toks t LEFT JOIN covered c ON t.id = c.id AND t.idx = c.idx)"""


def doc_tokens(spark, folder):
    return tokenize(docs(spark, folder), ID)


# --- sources and sinks --------------------------------------------------------------------------------


def write_corpus(spark, folder):
    """Documents as corpus files, one folder per split."""
    path = fresh_dir(spark, "corpus")
    rows = corpora.to_annotated_json(docs(spark, folder).withColumn("file", F.concat("split", F.lit(".jsonl"))))
    corpora.write_jsonl(rows.select("id", "text", "entities", "relations", "file"), path, ("file",))
    return path


_READ_SQL = f"""WITH {SPANS_SQL}, {DOC_RELATIONS_SQL}, n AS (SELECT id, count(*) AS n_spans, sum(s) AS starts, sum(e) AS ends FROM spans GROUP BY id),
  r AS (SELECT id, count(*) AS n_relations, sum(s1 + e2) AS ends FROM doc_rels GROUP BY id)
  SELECT d.id, [columns] md5(text) AS text_md5, coalesce(n_spans, 0) AS n_spans, CAST(coalesce(starts, 0) AS BIGINT) AS starts,
    CAST(coalesce(n.ends, 0) AS BIGINT) AS ends, coalesce(n_relations, 0) AS n_relations, CAST(coalesce(r.ends, 0) AS BIGINT) AS relation_ends
  FROM docs d LEFT JOIN n ON d.id = n.id LEFT JOIN r ON d.id = r.id WHERE regexp_matches(text, '[^{WHITESPACE}]')"""


def _read_facts(df, *extra):
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + f(x))
    return df.select(
        "id",
        *extra,
        F.md5("text").alias("text_md5"),
        F.size("spans").cast("long").alias("n_spans"),
        total("spans", lambda s: s["start"]).alias("starts"),
        total("spans", lambda s: s["end"]).alias("ends"),
        F.size("relations").cast("long").alias("n_relations"),
        total("relations", lambda r: r["start1"] + r["end2"]).alias("relation_ends"),
    )


@query("s3_read_annotated", _READ_SQL.replace("[columns]", ""))
def s3(spark, folder):
    return _read_facts(corpora.read_annotated(spark, write_corpus(spark, folder)))


@query("s5_read_corpus_folder", _READ_SQL.replace("[columns]", "split,"))
def s5(spark, folder):
    return _read_facts(corpora.read_corpus_folder(spark, write_corpus(spark, folder)), "split")


@query(
    "s4_union_corpus",
    f"""WITH {DOCS_SQL} SELECT split, id, count(*) AS n FROM (SELECT split, id FROM docs UNION ALL
        SELECT 'train', id FROM docs WHERE split = 'dev' UNION ALL SELECT split, id FROM docs WHERE split = 'test') GROUP BY ALL""",
)
def s4(spark, folder):
    parts = {s: docs(spark, folder).filter(F.col("split") == s).drop("split") for s in ("train", "dev", "test")}
    both = corpora.union_corpus(
        train=[parts["train"], parts["dev"]], dev=[parts["dev"]], test=[parts["test"], parts["test"]]
    )
    return both.groupBy("split", "id").agg(F.count("*").alias("n"))


@query("s6_write_jsonl", f"WITH {inputs.DOCS_SQL} SELECT id, text, split FROM docs")
def s6(spark, folder):
    path = fresh_dir(spark, "jsonl")
    corpora.write_jsonl(docs(spark, folder).select("id", "text", "split"), path)
    return spark.read.schema("id bigint, text string, split string").json(path)


_STRIP = f"regexp_replace(line, '^[{WHITESPACE}]+|[{WHITESPACE}]+$', '', 'g')"


@query(
    "s7_write_lines",
    f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT {_STRIP} AS value FROM l)
        SELECT value, count(*) AS n FROM s WHERE value <> '' GROUP BY value""",
)
def s7(spark, folder):
    path = fresh_dir(spark, "lines")
    corpora.write_lines(docs(spark, folder), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


def write_label_folder(spark, folder):
    path = fresh_dir(spark, "labels")
    parts = inputs.table(spark, folder, "part")
    file = F.concat(F.lower("p_type"), F.lit("_parts.txt"))
    line = F.concat(F.lit("  "), "p_name", F.lit(" "))
    parts.select(line.alias("value"), file.alias("file")).write.partitionBy("file").text(path)
    return path


@query(
    "s8_read_label_folder",
    "SELECT p_type[1] || lower(p_type[2:]) || ' Parts' AS class, p_name AS item, count(*) AS n FROM part GROUP BY ALL",
)
def s8(spark, folder):
    labelled = corpora.read_label_folder(spark, write_label_folder(spark, folder))
    return labelled.groupBy("class", "item").agg(F.count("*").alias("n"))


@query(
    "j7_attach_item_ids",
    """WITH first AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name)
       SELECT f.id, p.p_name AS text, lower(p.p_type) || '_parts' AS label, count(*) AS n FROM part p JOIN first f ON p.p_name = f.p_name GROUP BY ALL""",
)
def j7(spark, folder):
    items = inputs.table(spark, folder, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("text"))
    labelled = corpora.read_label_folder(spark, write_label_folder(spark, folder), title_case=False)
    found = corpus.attach_item_ids(labelled.withColumnRenamed("item", "text"), items)
    return found.groupBy("id", "text", F.array_join("label", ",").alias("label")).agg(F.count("*").alias("n"))


# --- preparation --------------------------------------------------------------------------------------

MARKED_SQL = f"""{SPANS_SQL}, marked AS (SELECT id, pos, s, e, label FROM spans UNION ALL
  SELECT id, NULL, 0, 0, CASE source WHEN 'src5' THEN 'NOT_INCLUDED' ELSE 'NO_ANNOTATION' END FROM docs WHERE source IN ('src5', 'src6'))"""


@query(
    "p2_drop_excluded",
    f"""WITH {MARKED_SQL} SELECT d.id, count(m.id) FILTER (d.source <> 'src6') AS n_spans FROM docs d LEFT JOIN marked m ON d.id = m.id
        WHERE d.source <> 'src5' GROUP BY d.id""",
)
def p2(spark, folder):
    kept = corpus.drop_excluded(inputs.marked_docs(spark, folder))
    return kept.select("id", F.size("spans").cast("long").alias("n_spans"))


@query(
    "p3_split_by_labels",
    f"""WITH {SPANS_SQL} SELECT d.id, count(DISTINCT s.label) FILTER (s.label IN ('PROD', 'LOC')) = 2 AS has_all
        FROM docs d LEFT JOIN spans s ON d.id = s.id GROUP BY d.id""",
)
def p3(spark, folder):
    having, others = corpus.split_by_labels(docs(spark, folder), ("PROD", "LOC"))
    return having.select("id", F.lit(True).alias("has_all")).unionByName(others.select("id", F.lit(False).alias("has_all")))


@query(
    "p4_prepare_iaa",
    f"""WITH {SPANS_SQL}, {DOC_RELATIONS_SQL} SELECT s.id, count(*) FILTER (label <> 'CRIT') AS n_spans, true AS no_relations
        FROM spans s WHERE s.id IN (SELECT id FROM spans WHERE label = 'CRIT' UNION SELECT id FROM doc_rels) GROUP BY s.id""",
)
def p4(spark, folder):
    kept = corpus.prepare_iaa(docs(spark, folder))
    return kept.select(
        "id", F.size("spans").cast("long").alias("n_spans"), (F.coalesce(F.size("relations"), F.lit(0)) <= 0).alias("no_relations")
    )


@query(
    "w5_train_dev_test_split",
    """WITH n AS (SELECT count(*) AS n, round_even(count(*) * (0.2 + 0.1), 0) AS held FROM documents),
       sizes AS (SELECT held, round_even(held * (0.1 / (0.2 + 0.1)), 0) AS test FROM n),
       ranked AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(CAST(doc_id AS STRING) || '_17'), doc_id) AS rank FROM documents)
       SELECT id, CASE WHEN rank <= (SELECT test FROM sizes) THEN 'test' WHEN rank <= (SELECT held FROM sizes) THEN 'dev' ELSE 'train' END AS split
       FROM ranked""",
)
def w5(spark, folder):
    return corpus.train_dev_test_split(docs(spark, folder).drop("split"), ID, 0.2, 0.1, seed=17).select("id", "split")


@query(
    "w6_set_operations",
    """WITH kinds AS (SELECT count(DISTINCT p_type) AS n FROM part)
       SELECT p_name AS item, count(DISTINCT p_type) AS n_sets, count(DISTINCT p_type) = (SELECT n FROM kinds) AS in_all FROM part GROUP BY p_name""",
)
def w6(spark, folder):
    parts = inputs.table(spark, folder, "part").select(F.col("p_type").alias("set"), F.col("p_name").alias("item"))
    return corpus.set_membership(parts)


@query(
    "n7_replace_nonprint",
    f"""WITH t AS (SELECT page_id, {inputs.dirty_sql('html', 'page_id')} AS html FROM pages)
        SELECT page_id, md5(regexp_replace(html, {NOTE}, ' ', 'g')) AS clean_md5, len(regexp_extract_all(html, {NOTE})) AS n_replaced FROM t""",
)
def n7(spark, folder):
    pages = inputs.table(spark, folder, "pages").withColumn("html", inputs.dirty(F.col("html"), F.col("page_id")))
    return pages.select(
        "page_id",
        F.md5(replace_nonprint(F.col("html"))).alias("clean_md5"),
        F.size(nonprint_chars(F.col("html"))).cast("long").alias("n_replaced"),
    )


@query(
    "a24_sanitize_report",
    f"""WITH t AS (SELECT {inputs.dirty_sql('text', 'doc_id')} AS text FROM documents UNION ALL SELECT {inputs.dirty_sql('html', 'page_id')} FROM pages)
        SELECT hex(char) AS char_hex, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {NOTE})) AS char FROM t) GROUP BY ALL""",
)
def a24(spark, folder):
    pages = inputs.table(spark, folder, "pages").select(inputs.dirty(F.col("html"), F.col("page_id")))
    texts = docs(spark, folder).select(inputs.dirty(F.col("text"), F.col("id")).alias("text")).union(pages)
    return corpus.sanitize_report(texts).select(F.hex("char").alias("char_hex"), "n")


@query(
    "n8_text_corpus",
    f"SELECT doc_id AS id, array_to_string(regexp_extract_all(lower(text), '{TOKEN_PATTERN}'), ' ') AS line FROM documents",
)
def n8(spark, folder):
    return docs(spark, folder).select("id", lower_corpus_line(F.col("text")).alias("line"))


@query(
    "n17_or_empty",
    f"WITH m AS ({inputs.MESSAGES_SQL}) SELECT chat_id, message_id, coalesce(username, '') AS username FROM m",
)
def n17(spark, folder):
    return inputs.messages(spark, folder).select("chat_id", "message_id", or_empty(F.col("user.username")).alias("username"))


# --- statistics ---------------------------------------------------------------------------------------


@query(
    "a9_label_distribution",
    f"""WITH {SPANS_SQL} SELECT split, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) + 0.0 AS share
        FROM spans JOIN docs USING (id) GROUP BY split, label""",
)
def a9(spark, folder):
    return corpus.label_distribution(docs(spark, folder)).withColumn("share", r6("share"))


@query(
    "a12_mention_share",
    f"""WITH {SPANS_SQL} SELECT count(*) FILTER (substring(text, CAST(s + 1 AS BIGINT), 1) = 'e') AS n_at, count(*) AS n_persons,
        round(count(*) FILTER (substring(text, CAST(s + 1 AS BIGINT), 1) = 'e') / count(*), 6) + 0.0 AS share FROM spans WHERE label = 'PER'""",
)
def a12(spark, folder):
    # Every e is an @ here, so that some spans begin with one.
    marked = docs(spark, folder).withColumn("text", F.replace("text", F.lit("e"), F.lit("@")))
    return corpus.mention_share(marked).withColumn("share", r6("share"))


@query(
    "a13_multi_product_docs",
    f"""WITH {SPANS_SQL}, n AS (SELECT d.id, count(s.id) FILTER (label = 'PROD') AS n FROM docs d LEFT JOIN spans s ON d.id = s.id GROUP BY d.id)
        SELECT count(*) FILTER (n > 1) AS n_multi, count(*) AS n_docs FROM n""",
)
def a13(spark, folder):
    return corpus.multi_product_docs(docs(spark, folder))


for _kind, _sql in (
    ("spans", f"WITH {SPANS_SQL} SELECT label, count(*) AS n FROM spans GROUP BY label"),
    ("relations", f"WITH {SPANS_SQL}, {DOC_RELATIONS_SQL} SELECT label, count(*) AS n FROM doc_rels GROUP BY label"),
):

    def _a25(spark, folder, kind=_kind):
        return corpus.label_vocabulary(docs(spark, folder), kind)

    query(f"a25_label_vocabulary_{_kind}", _sql)(_a25)


# --- tokens and spans ---------------------------------------------------------------------------------


@query("n10_tokenize", f"WITH {TOKENS_SQL} SELECT id, idx, token, s AS start_at, e AS end_at FROM toks")
def n10(spark, folder):
    return flat(doc_tokens(spark, folder))


@query("n11_span_to_tokens", f"WITH {RANGED_SQL} SELECT id, pos, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at, label, first_tok, last_tok, ok FROM ranged")
def n11(spark, folder):
    return flat(alignment.span_tokens(docs(spark, folder), ID))


def tagged_tokens(spark, folder):
    return alignment.bio_tags(docs(spark, folder), ID)


@query("n12_bio_tags", f"WITH {TAGS_SQL} SELECT id, idx, token, s AS start_at, e AS end_at, tag FROM tagged")
def n12(spark, folder):
    return flat(tagged_tokens(spark, folder))


@query(
    "a10_corpus_sizes",
    f"""WITH {TAGS_SQL}, n AS (SELECT id, count(*) AS n, count(*) FILTER (tag <> 'O') AS a FROM tagged GROUP BY id)
        SELECT split, count(*) AS n_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens, CAST(coalesce(sum(a), 0) AS BIGINT) AS n_annotated
        FROM docs LEFT JOIN n USING (id) GROUP BY split""",
)
def a10(spark, folder):
    return corpus.corpus_sizes(docs(spark, folder), tagged_tokens(spark, folder), ID)


ALIGNED_SQL = f"""{TOKENS_SQL},
  first_in AS (SELECT p.id, p.pos, min(t.idx) AS first_tok FROM spans p JOIN toks t ON p.id = t.id AND t.s >= p.s GROUP BY ALL),
  last_in AS (SELECT p.id, p.pos, max(t.idx) AS last_tok FROM spans p JOIN toks t ON p.id = t.id AND t.e <= p.e GROUP BY ALL),
  once AS (SELECT p.id, p.pos, p.s, p.e, p.label, p.text, first_tok, last_tok, coalesce(first_tok <= last_tok, false) AS hit
    FROM spans p LEFT JOIN first_in USING (id, pos) LEFT JOIN last_in USING (id, pos)),
  missed AS (SELECT *, greatest(0, s - 25) AS w FROM once WHERE NOT hit),
  searched AS (SELECT *, strpos(substring(lower(text), CAST(w + 1 AS BIGINT), CAST(e + 25 - w AS BIGINT)),
    substring(lower(text), CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))) AS found FROM missed),
  moved AS (SELECT id, pos, w + found - 1 AS s, w + found - 1 + e - s AS e FROM searched WHERE found > 0),
  again AS (SELECT m.id, m.pos, min(t.idx) AS first_tok, max(t.idx) AS last_tok FROM moved m JOIN toks t
    ON m.id = t.id AND t.s >= m.s AND t.e <= m.e GROUP BY ALL),
  aligned AS (SELECT id, CAST(pos AS INT) AS pos, label, first_tok, last_tok, true AS aligned FROM once WHERE hit
    UNION ALL SELECT m.id, CAST(m.pos AS INT), m.label, a.first_tok, a.last_tok, a.first_tok IS NOT NULL FROM missed m LEFT JOIN again a USING (id, pos))"""


@query("n13_align_contract", f"WITH {ALIGNED_SQL} SELECT * FROM aligned")
def n13(spark, folder):
    return flat(alignment.contract_spans(docs(spark, folder), ID))


_DIGITS = "[.,]*\\p{Nd}[\\p{Nd}.,]*"
_WORD_LIST = ", ".join(f"'{w}'" for w in NUMBER_WORDS)


@query(
    "n14_is_number_like",
    f"""WITH {TOKENS_SQL} SELECT token, (regexp_matches(token, '^[+\\-±~]?{_DIGITS}(/{_DIGITS})?$') OR lower(token) IN ({_WORD_LIST})) AS number_like,
        count(*) AS n FROM toks GROUP BY ALL""",
)
def n14(spark, folder):
    tokens = doc_tokens(spark, folder)
    return tokens.groupBy("token", is_number_like(F.col("token")).alias("number_like")).agg(F.count("*").alias("n"))


@query(
    "j14_resolve_relation_heads",
    f"""WITH {RANGED_SQL}, {DOC_RELATIONS_SQL},
        ends AS (SELECT id, rel_pos, 'head' AS side, s1 AS s, e1 AS e, label FROM doc_rels UNION ALL SELECT id, rel_pos, 'tail', s2, e2, label FROM doc_rels),
        owner AS (SELECT e.id, e.rel_pos, e.side, min(struct_pack(f := r.first_tok, p := r.pos)).p AS pos FROM ends e
          JOIN ranged me ON me.id = e.id AND me.s = e.s AND me.e = e.e AND me.ok
          JOIN ranged r ON r.id = e.id AND r.ok AND ((me.first_tok BETWEEN r.first_tok AND r.last_tok) OR (me.last_tok BETWEEN r.first_tok AND r.last_tok))
          GROUP BY ALL)
        SELECT d.id, CAST(d.rel_pos AS INT) AS rel_pos, d.label, h.pos AS head_pos, t.pos AS tail_pos FROM doc_rels d
        LEFT JOIN owner h ON h.id = d.id AND h.rel_pos = d.rel_pos AND h.side = 'head'
        LEFT JOIN owner t ON t.id = d.id AND t.rel_pos = d.rel_pos AND t.side = 'tail'""",
)
def j14(spark, folder):
    found = alignment.resolve_relations(docs(spark, folder), ID)
    return found.select("id", "rel_pos", "label", "head_pos", "tail_pos")


# --- dictionary tagging -------------------------------------------------------------------------------

PATTERNS_SQL = f"""{TOKENS_SQL}, patterns AS (SELECT DISTINCT label, regexp_extract_all(lower(substring(s.text, CAST(s.s + 1 AS BIGINT), CAST(s.e - s.s AS BIGINT))),
    '{TOKEN_PATTERN}') AS tokens FROM spans s JOIN docs d ON s.id = d.id WHERE d.split = 'train' AND label IN ('PROD', 'PER', 'PAYM', 'LOC', 'CRIT')),
  dict AS (SELECT label, tokens, len(tokens) AS n, array_to_string(tokens, ' ') AS phrase FROM patterns WHERE len(tokens) > 0)"""


def train_patterns(spark, folder):
    """Dictionary from the training part of the corpus, used on all documents."""
    return tagging.build_patterns(docs(spark, folder).filter("split = 'train'"))


@query("d1_build_patterns", f"WITH {PATTERNS_SQL} SELECT label, phrase, n AS n_tokens FROM dict")
def d1(spark, folder):
    found = train_patterns(spark, folder)
    return found.select("label", F.array_join("tokens", " ").alias("phrase"), F.size("tokens").cast("long").alias("n_tokens"))


@query(
    "d2_expand_patterns",
    f"""WITH {PATTERNS_SQL}, x AS (SELECT label, phrase, unnest(tokens) AS lower, CAST(generate_subscripts(tokens, 1) - 1 AS INT) AS idx FROM dict)
        SELECT label, phrase, idx, lower, CASE WHEN idx >= 2 THEN '?' END AS op FROM x""",
)
def d2(spark, folder):
    return tagging.pattern_rows(train_patterns(spark, folder))


@query("s15_write_patterns", f"WITH {PATTERNS_SQL} SELECT label, phrase FROM dict")
def s15(spark, folder):
    path = fresh_dir(spark, "patterns")
    corpora.write_patterns(train_patterns(spark, folder), path)
    return corpora.read_patterns(spark, path).select("label", F.array_join("tokens", " ").alias("phrase"))


MATCH_SQL = f"""{PATTERNS_SQL}, ws AS (SELECT id, list_transform(regexp_extract_all(text, '{TOKEN_PATTERN}'), lambda t: lower(t)) AS w FROM docs),
  starts AS (SELECT id, w, unnest(range(len(w))) AS i FROM ws),
  lens AS (SELECT DISTINCT n FROM dict),
  grams AS (SELECT id, i, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS phrase FROM starts JOIN lens ON i + n <= len(w)),
  matched AS (SELECT g.id, CAST(g.i AS INT) AS first_tok, CAST(g.i + g.n - 1 AS INT) AS last_tok, d.label FROM grams g JOIN dict d ON g.n = d.n AND g.phrase = d.phrase)"""


@query("j8_dictionary_match", f"WITH {MATCH_SQL} SELECT * FROM matched")
def j8(spark, folder):
    return flat(tagging.dictionary_match(docs(spark, folder), stored(train_patterns(spark, folder), "patterns"), ID))


# Every match with optional tokens, then rounds that take what ranks best on all its tokens and drop what touches it.
OPTIONAL_SQL = f"""{PATTERNS_SQL}, ws AS (SELECT id, list_transform(regexp_extract_all(text, '{TOKEN_PATTERN}'), lambda t: lower(t)) AS w FROM docs),
  starts AS (SELECT id, i, list_slice(w, i + 1, i + (SELECT max(n) FROM dict)) AS ahead FROM (SELECT id, w, unnest(range(len(w))) AS i FROM ws)),
  heads AS (SELECT label, tokens, least(n, 2) AS h, array_to_string(list_slice(tokens, 1, 2), ' ') AS head FROM dict),
  places AS (SELECT id, i, ahead, h, array_to_string(list_slice(ahead, 1, h), ' ') AS head FROM starts, (VALUES (1), (2)) hs(h) WHERE len(ahead) >= h),
  walk(id, i, label, tokens, ahead, j, m) AS (
    SELECT id, i, label, tokens, ahead, CAST(h AS BIGINT), CAST(h AS BIGINT) FROM places JOIN heads USING (h, head)
    UNION ALL
    SELECT id, i, label, tokens, ahead, j + 1, m + CAST(coalesce(ahead[m + 1] = tokens[j + 1], false) AS BIGINT) FROM walk WHERE j < len(tokens)),
  found AS (SELECT DISTINCT id, i, label, unnest(range(least(len(tokens), 2), m + 1)) AS n FROM walk WHERE j = len(tokens))"""

TAGGED_SQL = f"""{OPTIONAL_SQL},
  ranked AS (SELECT id, i, n, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, i, label) AS rk FROM found),
  rounds(id, i, n, label, rk, win) AS (
    SELECT id, i, n, label, rk, false FROM ranked
    UNION ALL
    SELECT id, i, n, label, rk, wins FROM (
      SELECT id, i, n, label, rk, wins, bool_or(taken) AS touched FROM (
        SELECT *, bool_or(wins) OVER (PARTITION BY id, t) AS taken FROM (
          SELECT *, bool_and(best = rk) OVER (PARTITION BY id, rk) AS wins FROM (
            SELECT *, min(rk) OVER (PARTITION BY id, t) AS best FROM (
              SELECT id, i, n, label, rk, unnest(range(i, i + n)) AS t FROM rounds WHERE NOT win)))) GROUP BY ALL)
    WHERE wins OR NOT touched),
  entities AS (SELECT id, CAST(i AS INT) AS first_tok, CAST(i + n - 1 AS INT) AS last_tok, label FROM rounds WHERE win),
  inside AS (SELECT id, unnest(range(first_tok, last_tok + 1)) AS idx FROM entities),
  matched AS MATERIALIZED (SELECT * FROM entities UNION ALL SELECT id, idx, idx, 'MONEY' FROM toks ANTI JOIN inside USING (id, idx)
    WHERE (regexp_matches(token, '^[+\\-±~]?{_DIGITS}(/{_DIGITS})?$') OR lower(token) IN ({_WORD_LIST})))"""


@query("d2_pattern_matches", f"WITH RECURSIVE {OPTIONAL_SQL} SELECT id, CAST(i AS INT) AS first_tok, CAST(n AS INT) AS n, label FROM found")
def d2_matches(spark, folder):
    return flat(tagging.pattern_matches(docs(spark, folder), stored(train_patterns(spark, folder), "patterns"), ID))


@query(
    "d3_tag_entities",
    f"""WITH RECURSIVE {TAGGED_SQL}, tokens_of AS (SELECT *, unnest(range(first_tok, last_tok + 1)) AS idx FROM matched)
        SELECT id, label, string_agg(CASE WHEN idx = first_tok THEN token ELSE piece END, '' ORDER BY idx) AS text, first_tok, last_tok,
          CAST(min(s) AS INT) AS start_at, max(e) AS end_at FROM tokens_of JOIN toks USING (id, idx) GROUP BY id, label, first_tok, last_tok""",
)
def d3(spark, folder):
    return flat(tagging.tag_entities(docs(spark, folder), stored(train_patterns(spark, folder), "patterns"), ID))


@query("u1_annotate")
def u1(spark, folder):
    return flat(tagging.annotate(inputs.messages(spark, folder), tagging.number_annotator, ["chat_id", "message_id"]))


# --- evaluation ---------------------------------------------------------------------------------------

DOC_NEAR_SQL = f"""{SPANS_SQL}, {DOC_RELATIONS_SQL}, near AS (SELECT p.id, p.s, p.e, m.s AS ms, m.e AS me,
    row_number() OVER (PARTITION BY p.id, p.pos ORDER BY abs(m.s - p.e), m.pos) AS rk, abs(m.s - p.e) AS dist
    FROM spans p JOIN spans m ON p.id = m.id AND p.label = 'PROD' AND m.label = 'MONEY'),
  pred AS (SELECT id, s AS s1, e AS e1, ms AS s2, me AS e2 FROM near WHERE rk = 1 AND dist < 200),
  gold AS (SELECT id, s1, e1, s2, e2 FROM doc_rels WHERE label = 'PROD_PRICE'),
  cnt AS (SELECT id, s1, e1, s2, e2, sum(p) AS p, sum(g) AS g FROM (SELECT *, 1 AS p, 0 AS g FROM pred UNION ALL SELECT *, 0, 1 FROM gold) GROUP BY ALL),
  per_doc AS (SELECT id, CAST(sum(least(p, g)) AS BIGINT) AS tp, CAST(sum(p - least(p, g)) AS BIGINT) AS fp, CAST(sum(g - least(p, g)) AS BIGINT) AS fn FROM cnt GROUP BY id)"""


def relation_matches(spark, folder):
    rows = docs(spark, folder).withColumns(
        {"chat_id": F.lit("docs"), "message_id": F.col("id"), "user": F.lit("")}
    )
    entities = named_entities(rows).withColumnRenamed("message_id", "id")
    pairs = pairing.nearest_price(entities, max_distance=200, tie="annotation", key=ID)
    predicted = pairs.select(
        "id",
        F.col("start").alias("start1"),
        F.col("end").alias("end1"),
        F.col("price_start").alias("start2"),
        F.col("price_end").alias("end2"),
        F.lit("PROD_PRICE").alias("label"),
    )
    gold = docs(spark, folder).select("id", F.inline("relations"))
    return pairing.match_relations(predicted, gold, ID)


@query("j6_match_relations", f"WITH {DOC_NEAR_SQL} SELECT * FROM per_doc")
def j6(spark, folder):
    return relation_matches(spark, folder)


_SCORES = """CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  round(sum(tp) / (sum(tp) + 0.5 * (sum(fp) + sum(fn))), 6) + 0.0 AS f_1, round(sum(tp) / (sum(tp) + sum(fp)), 6) + 0.0 AS precision,
  round(sum(tp) / (sum(tp) + sum(fn)), 6) + 0.0 AS recall"""


def _shown_scores(df):
    return df.withColumns({c: r6(c) for c in ("f_1", "precision", "recall")})


@query("a20_nn_scores", f"WITH {DOC_NEAR_SQL} SELECT {_SCORES} FROM per_doc")
def a20(spark, folder):
    return _shown_scores(pairing.nn_scores(relation_matches(spark, folder)))


@query("s14_write_metrics", f"WITH {DOC_NEAR_SQL} SELECT {_SCORES} FROM per_doc")
def s14(spark, folder):
    scores = pairing.nn_scores(relation_matches(spark, folder))
    path = fresh_dir(spark, "metrics")
    corpora.write_metrics(scores, path)
    return _shown_scores(corpora.read_metrics(spark, path, scores.schema))


def report_sql(gold: str, with_weighted: bool, extra: str = "") -> str:
    return f"""p AS (SELECT DISTINCT id, first_tok, last_tok, label FROM matched), g AS (SELECT DISTINCT id, first_tok, last_tok, label FROM {gold}),
  b AS (SELECT coalesce(p.label, g.label) AS label, p.id IS NOT NULL AS ip, g.id IS NOT NULL AS ig FROM p FULL JOIN g
    ON p.id = g.id AND p.first_tok = g.first_tok AND p.last_tok = g.last_tok AND p.label = g.label),
  c AS (SELECT label, count(*) FILTER (ip AND ig) AS tp, count(*) FILTER (NOT ig) AS fp, count(*) FILTER (NOT ip) AS fn FROM b GROUP BY label),
  t AS (SELECT * FROM c UNION ALL SELECT 'micro avg', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c),
  s AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
    tp / (tp + 0.5 * (fp + fn)) AS f1, tp + fn AS support FROM t),
  rep AS (SELECT * FROM s UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s WHERE label <> 'micro avg'
  {"UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s WHERE label <> 'micro avg'" if with_weighted else ""})
  SELECT label, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, support{extra} FROM rep"""


GOLD_RANGES_SQL = span_tokens_sql("spans", "toks", ["id"])


@query("a21_classification_report", f"WITH {MATCH_SQL}, {GOLD_RANGES_SQL}, okay AS (SELECT * FROM ranged WHERE ok), {report_sql('okay', True)}")
def a21(spark, folder):
    patterns = stored(train_patterns(spark, folder), "patterns")
    counts, _ = tag_counts.tag_counts(docs(spark, folder), patterns, ID, contract=False, entities=False)
    return evaluation.report_of(counts).withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(
    "a22_rule_scores",
    f"WITH {MATCH_SQL}, {ALIGNED_SQL[len(TOKENS_SQL) + 2:]}, okay AS (SELECT * FROM aligned WHERE aligned), "
    + report_sql("okay", False, ", (SELECT round(count(*) FILTER (NOT aligned) / count(*), 6) + 0.0 FROM aligned) AS misaligned"),
)
def a22(spark, folder):
    patterns = stored(train_patterns(spark, folder), "patterns")
    scores = evaluation.scores_of(*tag_counts.tag_counts(docs(spark, folder), patterns, ID, contract=True, entities=False))
    return scores.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "misaligned")})


@query(
    "d4_score_tagger",
    f"WITH RECURSIVE {TAGGED_SQL}, {ALIGNED_SQL[len(TOKENS_SQL) + 2:]}, okay AS (SELECT * FROM aligned WHERE aligned), "
    + report_sql("okay", False, ", (SELECT round(count(*) FILTER (NOT aligned) / count(*), 6) + 0.0 FROM aligned) AS misaligned"),
)
def d4(spark, folder):
    patterns = stored(train_patterns(spark, folder), "patterns")
    return jobs.score_tagger(docs(spark, folder), patterns, ID).withColumns({c: r6(c) for c in ("precision", "recall", "f1", "misaligned")})


# Pairs of both kinds with their features and whether the gold relations join them.
D5_KINDS = (("PROD", "MONEY", "PROD_PRICE"), ("MONEY", "CRIT", "PRICE_CRIT"))


# The line entities have positions but no text; their messages count as lines of this many characters.
LINE_CHARS, LONGEST_MESSAGE = 120, 1200


def labelled_pairs(spark, folder):
    used = ["author", "chat_id", "message_id", "line_no", "prod", "prod_at", "money", "money_at", "crit", "crit_at", "loc", "loc_at", "per", "per_at", "paym", "paym_at"]
    rows = stored(inputs.lines(spark, folder).select(used), "lines")
    # A place, a person and a payment are only counted, whatever their text.
    counted = {c: F.when(F.col(c).isNotNull(), "") for c in ("loc", "per", "paym")}
    breaks = rows.select("chat_id", "message_id").distinct().withColumn("at", F.sequence(F.lit(LINE_CHARS), F.lit(LONGEST_MESSAGE), F.lit(LINE_CHARS)))
    both = rows.drop("author").withColumns(counted).unionByName(breaks, allowMissingColumns=True)
    lines = F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda x: evaluation.item(kind=F.lit(1), start=x))
    items = F.concat(inputs.line_entities(evaluation.item), inputs.line_relations(evaluation.item), lines)
    return evaluation.pairs_of_items(both, items, inputs.entities(spark, folder, rows).count(), D5_KINDS)


def _features_sql(head, tail, label):
    breaks = lambda at: f"floor((greatest({at}, 1) - 1) / {LINE_CHARS})"
    return f"""(WITH {adjacent_sql(head, tail)}, gold AS (SELECT DISTINCT chat_id, message_id, h_s, h_e, t_s FROM ({gold_ends_sql(label)})),
      ranged AS (SELECT *, row_number() OVER () AS pair, CASE WHEN e <= price_s THEN e ELSE price_e END AS low, CASE WHEN e <= price_s THEN price_s ELSE s END AS high FROM pairs),
      inner_edges AS (SELECT * REPLACE (greatest(low, high) AS high) FROM ranged),
      between_count AS (SELECT r.pair, count(*) AS n FROM inner_edges r JOIN ents x ON x.chat_id = r.chat_id AND x.message_id = r.message_id AND x.s >= r.low AND x.s < r.high GROUP BY r.pair)
      SELECT '{label}' AS label, p.chat_id, p.message_id, p.s AS start_at, p.e AS end_at, p.text, p.price_s AS price_start,
        CAST(abs(p.price_s - p.e) AS DOUBLE) AS distance, CAST(is_after AS DOUBLE) AS is_after, CAST(length(p.text) AS DOUBLE) AS product_length,
        CAST(length(p.price_text) AS DOUBLE) AS price_length, CAST(coalesce(b.n, 0) AS DOUBLE) AS entities_between,
        CAST({breaks('high')} = {breaks('low')} AS INT) + 0.0 :: DOUBLE AS same_line, CAST(gold.h_s IS NOT NULL AS INT) + 0.0 :: DOUBLE AS related
      FROM inner_edges p LEFT JOIN between_count b ON b.pair = p.pair
      LEFT JOIN gold ON p.chat_id = gold.chat_id AND p.message_id = gold.message_id AND p.s = gold.h_s AND p.e = gold.h_e AND p.price_s = gold.t_s)"""


def gold_ends_sql(label):
    head, tail = {"PROD_PRICE": ("prod", "money"), "PRICE_CRIT": ("money", "crit")}[label]
    return f"""SELECT chat_id, message_id, {head}_at AS h_s, {head}_at + CAST(length({head}) AS INT) AS h_e, {tail}_at AS t_s
      FROM lines WHERE money IS NOT NULL AND {tail} IS NOT NULL"""


@query("d5_pair_features", " UNION ALL ".join(f"SELECT * FROM {_features_sql(*kind)}" for kind in D5_KINDS))
def d5_features(spark, folder):
    columns = ["label", "chat_id", "message_id", "start", "end", "text", "price_start", *evaluation.PAIR_FEATURES, "related"]
    return flat(labelled_pairs(spark, folder).select(columns))


@query("d5_score_relations")
def d5(spark, folder):
    """Scores of all pairs of both kinds, each kind with a model of its own; the pairs themselves are checked by d5_pair_features."""
    pairs = stored(labelled_pairs(spark, folder), "pairs")
    scored = [evaluation.score_relations(pairs.filter(F.col("label") == label), folds=3) for _, _, label in D5_KINDS]
    columns = ["label", "chat_id", "message_id", "start", "end", "text", "price_start", "related", r6("probability").alias("probability")]
    return flat(scored[0].select(columns).unionByName(scored[1].select(columns)))


# --- vectors in context -------------------------------------------------------------------------------

MESSAGE_TOKENS_SQL = f"{MESSAGE_SPANS_SQL}, toks AS {tokens_sql('msgs', 'chat_id, message_id')}"


@query(
    "v3_contextual_profile_vectors",
    f"""WITH {MESSAGE_TOKENS_SQL}, {span_tokens_sql('spans', 'toks', ['chat_id', 'message_id'])},
        x AS (SELECT r.chat_id, r.message_id, r.pos, avg(length(t.token)) AS x1, avg(t.idx) AS x2, avg(t.s) AS x3 FROM ranged r JOIN toks t
          ON r.chat_id = t.chat_id AND r.message_id = t.message_id AND t.idx BETWEEN r.first_tok AND r.last_tok WHERE r.ok AND r.label = 'PROD' GROUP BY ALL),
        a AS (SELECT DISTINCT {USER_NAME_SQL} AS author FROM msgs),
        y AS (SELECT {USER_NAME_SQL} AS author, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM x JOIN msgs USING (chat_id, message_id) GROUP BY ALL)
        SELECT author, round(coalesce(x1, 0), 6) + 0.0 AS x1, round(coalesce(x2, 0), 6) + 0.0 AS x2, round(coalesce(x3, 0), 6) + 0.0 AS x3 FROM a LEFT JOIN y USING (author)""",
)
def v3(spark, folder):
    key = ["chat_id", "message_id"]
    found = inputs.annotated(inputs.messages(spark, folder)).withColumn("user", inputs.user_name())
    tokens = tokenize(found, key)
    in_context = F.array(F.length("token").cast("double"), F.col("idx").cast("double"), F.col("start").cast("double"))
    spans = alignment.span_tokens(found, key).filter("ok AND label = 'PROD'").join(found.select(*key, "user"), key)
    vectors = contextual_profile_vectors(tokens.withColumn("vector", in_context), spans, users_of(found), key, 3)
    return flat(vectors.select("user", *[r6(F.col("vector")[i]).alias(f"x{i + 1}") for i in range(3)]))
