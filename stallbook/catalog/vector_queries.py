"""Queries over term weights, vectors, similarity joins and clusters."""

from pyspark.sql import functions as F

from stallbook.catalog import inputs
from stallbook.catalog.inputs import LINES_SQL, TOKEN_VECTORS_SQL
from stallbook.catalog.profile_queries import SUMMARY_SQL, product_summaries
from stallbook.catalog.registry import flat, query, r6
from stallbook.functions.text import clean_cluster_name
from stallbook.operators import clustering, components, similarity, summaries, tfidf, vectors
from stallbook.operators.clustering import agglomerative_clusters
from stallbook.plans import jobs
from stallbook.scratch import fresh_dir, stored
from stallbook.sources import corpora, profiles

# The supplied vectors lie far apart, so their clusters need wide thresholds.
CLASSES = [f"class{i}" for i in range(10)]
EDGE, EPS, MIN_SIZE = 0.7, 0.62, 2
DIMS = 64

# --- term weights -------------------------------------------------------------------------------------

FREQUENCIES_SQL = f"""lines AS ({LINES_SQL}), freq AS (SELECT author, trim(prod) AS product, count(*) AS n FROM lines GROUP BY ALL),
  idf AS (SELECT product, count(*) AS df, ln((SELECT count(*) FROM customer) / count(*)) AS idf FROM freq GROUP BY product),
  weights AS (SELECT author, product, n, 0.5 + 0.5 * n / max(n) OVER (PARTITION BY author) AS tf, idf,
    n * (0.5 + 0.5 * n / max(n) OVER (PARTITION BY author)) * idf AS weight FROM freq JOIN idf USING (product))"""


def line_mentions(spark, folder):
    return inputs.lines(spark, folder).select(F.col("author").alias("user"), F.col("prod").alias("text"))


def frequencies(spark, folder):
    return tfidf.product_frequencies(line_mentions(spark, folder))


def users(spark, folder):
    return inputs.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("user"))


@query("a6_product_frequencies", f"WITH {FREQUENCIES_SQL} SELECT * FROM freq")
def a6(spark, folder):
    return flat(frequencies(spark, folder))


@query("a7_document_frequencies", f"WITH {FREQUENCIES_SQL} SELECT product, df FROM idf")
def a7(spark, folder):
    return tfidf.document_frequencies(frequencies(spark, folder))


@query("a8_idf", f"WITH {FREQUENCIES_SQL} SELECT product, df, round(idf, 6) + 0.0 AS idf FROM idf")
def a8(spark, folder):
    return tfidf.idf(frequencies(spark, folder), users(spark, folder).count()).withColumn("idf", r6("idf"))


@query("w1_augmented_tf", f"WITH {FREQUENCIES_SQL} SELECT author, product, n, round(tf, 6) + 0.0 AS tf FROM weights")
def w1(spark, folder):
    return flat(tfidf.augmented_tf(frequencies(spark, folder)).withColumn("tf", r6("tf")))


@query(
    "j12_weight_mentions",
    f"""WITH {FREQUENCIES_SQL} SELECT author, product, n, round(tf, 6) + 0.0 AS tf, round(idf, 6) + 0.0 AS idf, round(weight, 6) + 0.0 AS weight FROM weights""",
)
def j12(spark, folder):
    found = tfidf.weighted_mentions(frequencies(spark, folder), users(spark, folder).count())
    return flat(found.withColumns({c: r6(c) for c in ("tf", "idf", "weight")}))


WORDS_SQL = f"lines AS ({LINES_SQL}), words AS (SELECT author, regexp_replace(prod, '\\s', '-', 'g') AS word, count(*) AS n FROM lines GROUP BY ALL)"
GRAMS_SQL = f"""{WORDS_SQL}, pads AS (SELECT DISTINCT word, ' ' || strip_accents(lower(word)) || ' ' AS p FROM words),
  ks AS (SELECT word, p, unnest(range(1, 5)) AS k FROM pads),
  cuts AS (SELECT word, substring(p, i, k) AS gram FROM (SELECT word, p, k, unnest(range(1, length(p) - k + 2)) AS i FROM ks WHERE k <= length(p))),
  per_word AS (SELECT word, gram, count(*) AS c FROM cuts GROUP BY ALL),
  counts AS (SELECT author, gram, sum(n * c) AS n FROM words JOIN per_word USING (word) GROUP BY ALL),
  df AS (SELECT gram, ln((1 + (SELECT count(*) FROM customer)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY gram),
  raw AS (SELECT author, gram, n * idf AS w FROM counts JOIN df USING (gram))"""


@query("n9_profile_words", f"WITH {WORDS_SQL} SELECT * FROM words")
def n9(spark, folder):
    return flat(tfidf.profile_words(line_mentions(spark, folder)))


@query(
    "v4_char_tfidf",
    f"WITH {GRAMS_SQL} SELECT author, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY author)), 6) + 0.0 AS weight FROM raw",
)
def v4(spark, folder):
    words = tfidf.profile_words(line_mentions(spark, folder))
    found = tfidf.char_tfidf(words, users(spark, folder).count())
    return flat(found.withColumn("weight", r6("weight")))


# Part descriptions as documents of one long word each; equal descriptions are one document.
PART_DOC = "p_brand || ' ' || p_name || ' ' || p_type"
PART_GRAMS_SQL = f"""docs AS (SELECT {PART_DOC} AS id, min(p_partkey) AS k FROM part GROUP BY ALL),
  pads AS (SELECT id, ' ' || lower(regexp_replace(id, '\\s', '-', 'g')) || ' ' AS p FROM docs),
  ks AS (SELECT id, p, unnest(range(1, 5)) AS k FROM pads),
  cuts AS (SELECT id, substring(p, i, k) AS gram FROM (SELECT id, p, k, unnest(range(1, length(p) - k + 2)) AS i FROM ks)),
  counts AS (SELECT id, gram, count(*) AS n FROM cuts GROUP BY ALL),
  df AS (SELECT gram, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY gram),
  raw AS (SELECT id, gram, n * idf AS w FROM counts JOIN df USING (gram)),
  weights AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


def part_weights(spark, folder):
    text = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    documents = inputs.table(spark, folder, "part").select(text.alias("text")).distinct()
    words = tfidf.profile_words(documents.select(F.col("text").alias("user"), "text"))
    weights = tfidf.char_tfidf(words, documents.count())
    return weights.select(F.col("user").alias("id"), F.col("gram").alias("term"), "weight")


@query(
    "j13_sparse_cosine_pairs",
    f"""WITH {PART_GRAMS_SQL} SELECT a.id AS id_a, b.id AS id_b, round(1 - sum(a.w * b.w), 6) + 0.0 AS distance
        FROM weights a JOIN weights b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL HAVING 1 - sum(a.w * b.w) < 0.25""",
)
def j13_sparse(spark, folder):
    weights = stored(part_weights(spark, folder), "weights")
    return similarity.sparse_cosine_pairs(weights, 0.25).withColumn("distance", r6("distance"))


# --- vectors ------------------------------------------------------------------------------------------

ITEM_SQL = f"""{TOKEN_VECTORS_SQL}, item_tokens AS (SELECT p_name AS item, unnest(string_split(p_name, ' ')) AS token FROM (SELECT DISTINCT p_name FROM part)),
  item_dims AS (SELECT item, dim, avg(x) AS x FROM item_tokens JOIN token_dims USING (token) GROUP BY ALL)"""


def long_form(df, key):
    return df.select(*key, F.posexplode("vector").alias("dim", "x")).select(
        *key, (F.col("dim") + 1).cast("long").alias("dim"), r6("x").alias("x")
    )


def item_vectors(spark, folder):
    return vectors.item_vectors(inputs.part_names(spark, folder), inputs.token_vectors(spark, folder))


@query("v1_item_vectors", f"WITH {ITEM_SQL} SELECT item, CAST(dim AS BIGINT) AS dim, round(x, 6) + 0.0 AS x FROM item_dims")
def v1(spark, folder):
    return long_form(item_vectors(spark, folder), ["item"])


def _profile_vectors(spark, folder, use_tf_idf):
    people = users(spark, folder)
    return vectors.profile_vectors(
        line_mentions(spark, folder),
        item_vectors(spark, folder).withColumnRenamed("item", "product"),
        people,
        DIMS,
        people.count(),
        use_tf_idf,
    )


@query(
    "v2_profile_vectors",
    f"""WITH {FREQUENCIES_SQL}, {ITEM_SQL}, pv AS (SELECT author, dim, sum(weight * x) / sum(weight) AS x FROM weights JOIN item_dims ON product = item GROUP BY ALL)
        SELECT CAST(c_custkey AS STRING) AS author, CAST(d.dim AS BIGINT) AS dim, round(coalesce(pv.x, 0), 6) + 0.0 AS x
        FROM customer CROSS JOIN (SELECT DISTINCT dim FROM dims) d LEFT JOIN pv ON pv.author = CAST(c_custkey AS STRING) AND pv.dim = d.dim""",
)
def v2(spark, folder):
    return flat(long_form(_profile_vectors(spark, folder, True), ["user"]))


@query(
    "p10_split_zero_vectors",
    f"""WITH lines AS ({LINES_SQL}), a AS (SELECT DISTINCT author FROM lines)
        SELECT CAST(c_custkey AS STRING) AS author, a.author IS NULL AS is_zero FROM customer LEFT JOIN a ON a.author = CAST(c_custkey AS STRING)""",
)
def p10(spark, folder):
    filled, empty = vectors.split_zero_vectors(_profile_vectors(spark, folder, False))
    return flat(
        filled.select("user", F.lit(False).alias("is_zero")).unionByName(empty.select("user", F.lit(True).alias("is_zero")))
    )


EMB_SQL = "emb AS (SELECT vec_id AS id, 'class' || CAST(label AS STRING) AS class, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CLASS_MEANS_SQL = f"""{EMB_SQL}, cd AS (SELECT class, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM emb),
  means AS (SELECT class, list(x ORDER BY dim) AS m FROM (SELECT class, dim, avg(x) AS x FROM cd GROUP BY ALL) GROUP BY class)"""


@query(
    "v5_cosine_distance",
    f"WITH {CLASS_MEANS_SQL} SELECT id, class, round(1 - list_cosine_similarity(v, m), 6) + 0.0 AS distance FROM emb JOIN means USING (class)",
)
def v5(spark, folder):
    rows = inputs.class_vectors(spark, folder)
    means = vectors.mean_vectors(rows, ["class"]).withColumnRenamed("vector", "b")
    pairs = rows.withColumnRenamed("vector", "a").join(means, "class")
    return vectors.vector_distances(pairs).select("id", "class", r6("distance").alias("distance"))


PAIRS_SQL = f"""{EMB_SQL}, pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.class AS class_a, b.class AS class_b, list_cosine_similarity(a.v, b.v) AS sim
  FROM emb a JOIN emb b ON a.id <> b.id)"""
AFFINITY_SQL = f"{PAIRS_SQL}, aff AS (SELECT class_a, class_b, avg(sim) AS value FROM pairs GROUP BY ALL)"
DIFFERENCE_SQL = f"""{AFFINITY_SQL}, diff AS (SELECT a.class_a, a.class_b, a.value - d.value AS value FROM aff a JOIN aff d
  ON d.class_a = d.class_b AND d.class_a = least(a.class_a, a.class_b))"""


@query(
    "v11_cohesion",
    f"""WITH {AFFINITY_SQL} SELECT class, count(*) AS n, round(min(value), 6) + 0.0 AS cohesion FROM emb
        LEFT JOIN aff ON class_a = class AND class_b = class GROUP BY class""",
)
def v11(spark, folder):
    return vectors.cohesion(inputs.class_vectors(spark, folder)).withColumn("cohesion", r6("cohesion"))


@query("v12_coupling", f"WITH {AFFINITY_SQL} SELECT class_a, class_b, round(value, 6) + 0.0 AS value FROM aff WHERE class_a < class_b")
def v12(spark, folder):
    return vectors.coupling(inputs.class_vectors(spark, folder)).withColumn("value", r6("value"))


@query("v13_affinity_matrix", f"WITH {AFFINITY_SQL} SELECT class_a, class_b, round(value, 6) + 0.0 AS value FROM aff")
def v13(spark, folder):
    return vectors.affinity_matrix(inputs.class_vectors(spark, folder)).withColumn("value", r6("value"))


@query("w2_difference_table", f"WITH {DIFFERENCE_SQL} SELECT class_a, class_b, round(value, 6) + 0.0 AS value FROM diff")
def w2(spark, folder):
    affinity = vectors.affinity_matrix(inputs.class_vectors(spark, folder))
    return vectors.difference_table(affinity).withColumn("value", r6("value"))


@query(
    "w2_difference_margins",
    f"""WITH {DIFFERENCE_SQL}, off AS (SELECT * FROM diff WHERE class_a <> class_b)
        SELECT 'row' AS side, class_a AS class, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS variance FROM off GROUP BY class_a
        UNION ALL SELECT 'column', class_b, round(avg(value), 6) + 0.0, NULL FROM off GROUP BY class_b
        UNION ALL SELECT 'all', 'Mean', round(avg(value), 6) + 0.0, round(var_pop(value), 6) + 0.0 FROM off""",
)
def w2_margins(spark, folder):
    affinity = vectors.affinity_matrix(inputs.class_vectors(spark, folder))
    found = vectors.difference_margins(vectors.difference_table(affinity))
    return found.withColumns({"mean": r6("mean"), "variance": r6("variance")})


_PIVOT = ", ".join(f"round(max(value) FILTER (class_b = '{c}'), 6) + 0.0 AS {c}" for c in CLASSES)


@query("s13_write_matrix_csv", f"WITH {AFFINITY_SQL} SELECT class_a, {_PIVOT} FROM aff GROUP BY class_a")
def s13(spark, folder):
    path = fresh_dir(spark, "matrix")
    affinity = vectors.affinity_matrix(inputs.class_vectors(spark, folder))
    columns = corpora.write_matrix_csv(affinity, path)
    schema = "class_a string, " + ", ".join(f"`{c}` double" for c in columns)
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.select("class_a", *[r6(c).alias(c) for c in columns])


def silhouette_sql(distance: str) -> str:
    return f"""{EMB_SQL}, pd AS (SELECT a.id, a.class AS own, b.class AS other, avg({distance}) AS d FROM emb a JOIN emb b ON a.id <> b.id GROUP BY ALL),
      ab AS (SELECT id, own, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM pd GROUP BY ALL),
      sil AS (SELECT id, own, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


for _metric, _distance in (
    ("cosine", "1 - list_cosine_similarity(a.v, b.v)"),
    ("sqeuclidean", "list_distance(a.v, b.v) * list_distance(a.v, b.v)"),
):

    def _v10(spark, folder, metric=_metric):
        found = clustering.silhouette(inputs.class_vectors(spark, folder), metric)
        return found.withColumn("silhouette", r6("silhouette"))

    query(
        f"v10_silhouette_{_metric}",
        f"WITH {silhouette_sql(_distance)} SELECT round(avg(s), 6) + 0.0 AS silhouette, count(*) AS n FROM sil",
    )(_v10)


@query(
    "v10_silhouette_samples",
    f"WITH {silhouette_sql('1 - list_cosine_similarity(a.v, b.v)')} SELECT id, own AS class, round(s, 6) + 0.0 AS silhouette FROM sil",
)
def v10_samples(spark, folder):
    found = clustering.silhouette_samples(inputs.class_vectors(spark, folder))
    return found.withColumn("silhouette", r6("silhouette"))


@query(
    "v14_embedding_report",
    f"""WITH {silhouette_sql('1 - list_cosine_similarity(a.v, b.v)')}, {DIFFERENCE_SQL[len(EMB_SQL) + 2:]}
        SELECT 'silhouette' AS "table", 'all' AS class_a, 'all' AS class_b, round(avg(s), 6) + 0.0 AS value FROM sil
        UNION ALL SELECT 'affinity', class_a, class_b, round(value, 6) + 0.0 FROM aff
        UNION ALL SELECT 'difference', class_a, class_b, round(value, 6) + 0.0 FROM diff""",
)
def v14(spark, folder):
    return jobs.embedding_report(inputs.class_vectors(spark, folder)).withColumn("value", r6("value"))


@query("v16_train_word_vectors")
def v16(spark, folder):
    found = vectors.train_word_vectors(inputs.docs(spark, folder), dims=16, min_count=20)
    return found.select("token", F.size("vector").alias("dims"))


# --- similarity joins and clusters --------------------------------------------------------------------


def id_vectors(spark, folder):
    return inputs.class_vectors(spark, folder).select("id", "vector")


@query(
    "j13_cosine_pairs",
    f"WITH {PAIRS_SQL} SELECT id_a, id_b, round(1 - sim, 6) + 0.0 AS distance FROM pairs WHERE id_a < id_b AND 1 - sim < {EDGE}",
)
def j13(spark, folder):
    points = stored(similarity.all_vectors(id_vectors(spark, folder)), "points")
    return similarity.cosine_pairs(points, EDGE).withColumn("distance", r6("distance"))


def components_sql(limit: str) -> str:
    return f"""RECURSIVE {PAIRS_SQL}, edges AS (SELECT id_a, id_b FROM pairs WHERE {limit}),
      reach AS (SELECT id_a AS node, id_a AS root FROM edges UNION SELECT e.id_b, r.root FROM reach r JOIN edges e ON e.id_a = r.node),
      comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


@query("v8_connected_components", f"WITH {components_sql(f'1 - sim < {EPS}')} SELECT node, component FROM comp")
def v8(spark, folder):
    rows = id_vectors(spark, folder).filter("id IS NOT NULL AND vector IS NOT NULL")
    points = stored(similarity.distinct_directions(rows)[0], "points")
    links = similarity.cosine_links(points, EPS).unionByName(similarity.copy_links(rows, points))
    return components.connected_components(links)


PRODUCT_CLUSTERS_SQL = f"""{components_sql(f'1 - sim <= {EPS}')}, sized AS (SELECT emb.id, component, count(*) OVER (PARTITION BY component) AS size
    FROM emb LEFT JOIN comp ON node = emb.id),
  clusters AS (SELECT id, CASE WHEN component IS NULL OR size < {MIN_SIZE} THEN -1 ELSE component END AS cluster_id FROM sized)"""


def product_clusters(spark, folder):
    return clustering.cluster_products(id_vectors(spark, folder), EPS, MIN_SIZE)


@query("v7_cluster_products", f"WITH {PRODUCT_CLUSTERS_SQL} SELECT * FROM clusters")
def v7(spark, folder):
    return product_clusters(spark, folder)


@query(
    "s12_write_product_clusters",
    f"""WITH {PRODUCT_CLUSTERS_SQL} SELECT printf('%03d_%04d', cluster_id, count(*) OVER (PARTITION BY cluster_id)) AS cluster_key, 'item ' || CAST(id AS STRING) AS value FROM clusters""",
)
def s12(spark, folder):
    path = fresh_dir(spark, "product-clusters")
    named = product_clusters(spark, folder).withColumn("item", F.concat(F.lit("item "), F.col("id")))
    profiles.write_product_clusters(named, path)
    return spark.read.schema("value string, cluster_key string").text(path).select("cluster_key", "value")


@query(
    "v6_cluster_profiles_single",
    f"""WITH {components_sql(f'1 - sim < {EPS}')}, sized AS (SELECT emb.id, coalesce(component, emb.id) AS c FROM emb LEFT JOIN comp ON node = emb.id)
        SELECT id, CASE WHEN count(*) OVER (PARTITION BY c) < 3 THEN -1 ELSE c END AS cluster_id FROM sized""",
)
def v6_single(spark, folder):
    return clustering.cluster_profiles(id_vectors(spark, folder), EPS, "single", 3)


def agglomerate_sql(measure: str, threshold: float) -> str:
    """Merges the two nearest groups of each component, one step at a time, on top of `pairs` and `comp`: merged (id, c)."""
    return f"""state(step, component, id, c) AS (SELECT 0, component, node, node FROM comp
      UNION ALL
      SELECT s.step + 1, s.component, s.id, CASE WHEN s.c = best.high THEN best.low ELSE s.c END FROM state s JOIN (
        SELECT component, first(low ORDER BY d, low, high) AS low, first(high ORDER BY d, low, high) AS high FROM (
          SELECT a.component, a.c AS low, b.c AS high, {measure}(1 - sim) AS d FROM state a JOIN state b ON a.component = b.component AND a.c < b.c
          JOIN pairs p ON p.id_a = a.id AND p.id_b = b.id GROUP BY ALL HAVING {measure}(1 - sim) < {threshold}) GROUP BY component) best ON s.component = best.component),
    merged AS (SELECT id, c FROM state QUALIFY step = max(step) OVER (PARTITION BY component))"""


def profile_clusters_sql(measure: str) -> str:
    return f"""WITH {components_sql(f'1 - sim < {EDGE}')}, {agglomerate_sql(measure, EDGE)}
      SELECT emb.id, CASE WHEN count(*) OVER (PARTITION BY coalesce(c, emb.id)) < 3 THEN -1 ELSE coalesce(c, emb.id) END AS cluster_id FROM emb LEFT JOIN merged ON merged.id = emb.id"""


for _linkage, _measure in (("average", "avg"), ("complete", "max")):

    def _v6(spark, folder, linkage=_linkage):
        return clustering.cluster_profiles(id_vectors(spark, folder), EDGE, linkage, 3)

    query(f"v6_cluster_profiles_{_linkage}", profile_clusters_sql(_measure))(_v6)


@query("v6_cluster_profiles_by_joins", profile_clusters_sql("avg"))
def v6_joins(spark, folder):
    return clustering.cluster_profiles(id_vectors(spark, folder), EDGE, "average", 3, local_points=2)


@query(
    "a23_cluster_sizes",
    f"""WITH {EMB_SQL} SELECT id, CASE WHEN id IN (SELECT l_suppkey FROM lineitem) THEN -2 WHEN count(*) OVER (PARTITION BY g) < 30 THEN -1 ELSE g END AS cluster_id
        FROM (SELECT id, CASE WHEN id IN (SELECT l_suppkey FROM lineitem) THEN NULL ELSE CAST(class[6:] AS BIGINT) END AS g FROM emb)""",
)
def a23(spark, folder):
    rows = inputs.class_vectors(spark, folder)
    supplied = inputs.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("id")).distinct().withColumn("empty", F.lit(True))
    label = F.regexp_replace("class", "class", "").cast("long")
    clusters = rows.join(supplied, "id", "left").select("id", F.when(F.col("empty").isNull(), label).alias("cluster"))
    return clustering.cluster_sizes(clusters, 30)


NAMES_SQL = f"""{PRODUCT_CLUSTERS_SQL}, {ITEM_SQL},
  iv AS (SELECT item, list(x ORDER BY dim) AS p FROM item_dims GROUP BY item),
  cd AS (SELECT cluster_id, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM clusters JOIN emb USING (id) WHERE cluster_id >= 0),
  means AS (SELECT cluster_id, list(x ORDER BY dim) AS m FROM (SELECT cluster_id, dim, avg(x) AS x FROM cd GROUP BY ALL) GROUP BY cluster_id),
  offered AS (SELECT DISTINCT cluster_id, p_name AS product FROM clusters JOIN part ON p_partkey % (SELECT count(*) FROM embeddings) = id WHERE cluster_id >= 0),
  dist AS (SELECT cluster_id, product, 1 - list_cosine_similarity(p, m) AS d FROM offered JOIN iv ON product = item JOIN means USING (cluster_id)),
  best AS (SELECT cluster_id, product, row_number() OVER (PARTITION BY cluster_id ORDER BY d, product) AS rk FROM dist WHERE d < 1),
  names AS (SELECT cluster_id, coalesce(product, '') AS cluster_name FROM means LEFT JOIN (SELECT * FROM best WHERE rk = 1) USING (cluster_id))"""


def named_clusters(spark, folder, clean=False):
    clusters = stored(product_clusters(spark, folder), "clusters")
    # Every part belongs to a vector: parts are dealt to the vector ids, which count from 0, in turn.
    n = inputs.table(spark, folder, "embeddings").count()
    products = inputs.table(spark, folder, "part").select(F.pmod("p_partkey", F.lit(n)).alias("id"), F.col("p_name").alias("product"))
    names = clustering.cluster_names(
        clusters, id_vectors(spark, folder), products, item_vectors(spark, folder).withColumnRenamed("item", "product"), clean
    )
    return clusters, names


@query("v9_cluster_names", f"WITH {NAMES_SQL} SELECT cluster_id, cluster_name FROM names")
def v9(spark, folder):
    return named_clusters(spark, folder)[1]


CLEAN_NAMES_SQL = NAMES_SQL.replace(
    "best AS (SELECT cluster_id, product, row_number()",
    "clean AS (SELECT cluster_id, regexp_replace(product, '[^\\p{L}\\p{N}_]', '', 'g') AS product, d FROM dist),\n  best AS (SELECT cluster_id, product, row_number()",
).replace("FROM dist WHERE d < 1)", "FROM clean WHERE d < 1 AND product <> '')").replace("coalesce(product, '')", "coalesce(product, 'NO_NAME')")


@query("v9_clean_cluster_names", f"WITH {CLEAN_NAMES_SQL} SELECT cluster_id, cluster_name FROM names")
def v9_clean(spark, folder):
    return named_clusters(spark, folder, clean=True)[1]


@query(
    "s11_write_clusters",
    f"""WITH {NAMES_SQL} SELECT id, cluster_id, CASE WHEN cluster_id = -1 THEN 'NO_CLUSTER' ELSE cluster_name || ' / ' || CAST(cluster_id AS STRING) END AS cluster_name,
        CASE WHEN cluster_id = -1 THEN 'NO_CLUSTER' ELSE trim(left(replace(cluster_name || ' / ' || CAST(cluster_id AS STRING), '/', '_'), 100)) END AS cluster_key
        FROM clusters LEFT JOIN names USING (cluster_id)""",
)
def s11(spark, folder):
    clusters, names = named_clusters(spark, folder)
    unique = names.withColumn("cluster_name", F.concat("cluster_name", F.lit(" / "), "cluster_id"))
    path = fresh_dir(spark, "clusters")
    profiles.write_clusters(clustering.with_names(clusters, unique), path)
    schema = "id bigint, cluster_id bigint, cluster_name string, cluster_key string"
    return spark.read.schema(schema).parquet(path)


@query("v15_cluster_layout")
def v15(spark, folder):
    """Median position of every cluster, and its distance to each cluster that lies close."""
    rows = inputs.class_vectors(spark, folder).withColumnRenamed("class", "cluster")
    layout = stored(clustering.cluster_layout(rows), "layout")
    medians = stored(clustering.cluster_medians(layout), "medians")
    close = clustering.close_clusters(medians)
    both = close.unionByName(close.select(F.col("other").alias("cluster"), F.col("cluster").alias("other"), "distance"))
    shown = medians.join(both, "cluster", "left")
    return shown.select("cluster", r6("x").alias("x"), r6("y").alias("y"), "other", r6("distance").alias("distance"))


@query(
    "n18_clean_cluster_name",
    "SELECT p_partkey, regexp_replace(p_brand || ' ' || p_name, '[^\\p{L}\\p{N}_]', '', 'g') AS name FROM part",
)
def n18(spark, folder):
    text = F.concat_ws(" ", "p_brand", "p_name")
    return inputs.table(spark, folder, "part").select("p_partkey", clean_cluster_name(text).alias("name"))


NORMALIZED_SQL = f"""WITH {SUMMARY_SQL}, n AS (SELECT lower(trim(regexp_replace(regexp_replace(product, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))) AS product FROM summary)
  SELECT DISTINCT product FROM n WHERE length(product) > 1"""


@query("p6_normalized_products", NORMALIZED_SQL)
def p6(spark, folder):
    return summaries.normalized_products(product_summaries(spark, folder))


@query("s16_list_products", NORMALIZED_SQL)
def s16(spark, folder):
    path = fresh_dir(spark, "products")
    summaries.normalized_products(product_summaries(spark, folder)).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "product")


@query(
    "v6_cluster_profile_vectors",
    f"""WITH RECURSIVE {FREQUENCIES_SQL}, {ITEM_SQL}, pv AS (SELECT author, dim, sum(weight * x) / sum(weight) AS x FROM weights JOIN item_dims ON product = item GROUP BY ALL),
      emb AS (SELECT author AS id, list(x ORDER BY dim) AS v FROM pv GROUP BY author HAVING max(abs(x)) > 0),
      pairs AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS sim FROM emb a JOIN emb b ON a.id <> b.id),
      edges AS (SELECT id_a, id_b FROM pairs WHERE 1 - sim < 0.02),
      reach AS (SELECT id_a AS node, id_a AS root FROM edges UNION SELECT e.id_b, r.root FROM reach r JOIN edges e ON e.id_a = r.node),
      comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node), {agglomerate_sql('avg', 0.02)},
      named AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN emb.id IS NOT NULL THEN coalesce(c, emb.id) END AS c
        FROM customer LEFT JOIN emb ON emb.id = CAST(c_custkey AS VARCHAR) LEFT JOIN merged ON merged.id = emb.id)
      SELECT id, CASE WHEN c IS NULL THEN -2 WHEN count(*) OVER (PARTITION BY c) < 3 THEN -1 ELSE CAST(c AS BIGINT) END AS cluster_id FROM named""",
)
def v6_profiles(spark, folder):
    """Profiles clustered on their own product vectors, as the whole job runs on extracted profiles."""
    people = stored(_profile_vectors(spark, folder, True), "profile-vectors").select(F.col("user").alias("id"), "vector")
    clusters = agglomerative_clusters(people, 0.02, "average")
    return clustering.cluster_sizes(clusters.withColumn("cluster", F.col("cluster").cast("long")), 3)


# Part descriptions as profiles that mention one product each: their n-grams differ enough for a cut in between.
TFIDF_CUT = 0.25
TFIDF_SQL = f"""WITH RECURSIVE {PART_GRAMS_SQL}, grams AS MATERIALIZED (SELECT k AS id, gram, w FROM weights JOIN docs USING (id)),
  half AS MATERIALIZED (SELECT a.id AS id_a, b.id AS id_b, sum(a.w * b.w) AS sim FROM grams a JOIN grams b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL),
  near AS (SELECT * FROM half WHERE 1 - sim < {TFIDF_CUT}), edges AS (SELECT id_a, id_b FROM near UNION ALL SELECT id_b, id_a FROM near),
  reach AS (SELECT id_a AS node, id_a AS root FROM edges UNION SELECT e.id_b, r.root FROM reach r JOIN edges e ON e.id_a = r.node),
  comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
  inside AS (SELECT h.* FROM half h JOIN comp a ON a.node = h.id_a JOIN comp b ON b.node = h.id_b AND a.component = b.component),
  pairs AS MATERIALIZED (SELECT id_a, id_b, sim FROM inside UNION ALL SELECT id_b, id_a, sim FROM inside), {agglomerate_sql('avg', TFIDF_CUT)},
  named AS (SELECT k AS id, docs.id AS product, coalesce(c, k) AS c FROM docs LEFT JOIN merged ON merged.id = k),
  clusters AS (SELECT id, product, CASE WHEN count(*) OVER (PARTITION BY c) < 3 THEN -1 ELSE c END AS cluster_id FROM named),
  sums AS (SELECT cluster_id, gram, sum(w) AS t FROM clusters JOIN grams USING (id) WHERE cluster_id >= 0 GROUP BY ALL),
  norms AS (SELECT cluster_id, sqrt(sum(t * t)) AS norm FROM sums GROUP BY cluster_id),
  dist AS (SELECT cluster_id, regexp_replace(product, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS name, round(1 - sum(w * t) / any_value(norm), 9) AS d
    FROM clusters JOIN grams USING (id) JOIN sums USING (cluster_id, gram) JOIN norms USING (cluster_id) GROUP BY cluster_id, product),
  best AS (SELECT cluster_id, first(name ORDER BY d, name) AS name FROM dist WHERE d < 1 AND name <> '' GROUP BY cluster_id)
  SELECT id, cluster_id, CASE cluster_id WHEN -1 THEN 'NO_CLUSTER' ELSE coalesce(name, 'NO_NAME') END AS cluster_name FROM clusters LEFT JOIN best USING (cluster_id)"""


@query("v6_cluster_tfidf", TFIDF_SQL)
def v6_tfidf(spark, folder):
    text = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    people = stored(inputs.table(spark, folder, "part").groupBy(text.alias("user")).agg(F.min("p_partkey").alias("id")), "part-texts")
    clusters, names = jobs.cluster_tfidf(people.select("user", F.col("user").alias("text")), people, TFIDF_CUT, 3)
    return clustering.with_names(clusters, names)
