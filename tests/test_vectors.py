import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallbook.catalog import vector_queries
from stallbook.operators import blocks, clustering, components, linkage, pivot_tree, similarity, text_clusters, tfidf, vectors


def cosine(a, b):
    return 1.0 - a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def crowd(seed, n=120, dims=4, centres=7, noise=0.25):
    """Points around a few directions; a third of them are copies of one."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dims))
    x[rng.random(n) < 0.33] = x[0]
    return x


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")


@pytest.mark.parametrize("rows_of_leaf, fan, threshold", [(1000, 16, 0.2), (7, 4, 0.2), (5, 3, 0.05), (9, 4, 0.9)])
def test_cosine_pairs_equal_brute_force(spark, monkeypatch, rows_of_leaf, fan, threshold):
    monkeypatch.setattr(pivot_tree, "leaf_rows", lambda dims: rows_of_leaf)
    monkeypatch.setattr(pivot_tree, "FAN", fan)
    monkeypatch.setattr(similarity, "VISITS", 2)
    x = crowd(1)
    points, members = similarity.distinct_directions(table(spark, x))
    assert members.count() == len(x) and points.agg(F.sum("copies")).first()[0] == len(x)
    found = [(r["id_a"], r["id_b"]) for r in similarity.cosine_pairs(points, threshold).collect()]
    ids = [r["id"] for r in points.select("id").collect()]
    d = cosine(x, x)
    expected = {(a, b) for a in ids for b in ids if a < b and d[a, b] < threshold}
    assert len(found) == len(set(found)) and set(found) == expected


def test_points_that_no_pivot_parts(spark, monkeypatch):
    monkeypatch.setattr(pivot_tree, "leaf_rows", lambda dims: 5)
    x = np.ones((23, 3)) + 1e-12 * np.arange(69).reshape(23, 3)  # one direction, but for rounding
    points = table(spark, x).withColumnRenamed("vector", "unit").withColumn("unit", F.transform("unit", lambda v: v / math.sqrt(3)))
    found = {(r["id_a"], r["id_b"]) for r in similarity.cosine_pairs(points, 0.1).collect()}
    assert found == {(a, b) for a in range(23) for b in range(a + 1, 23)}


def test_no_points_have_no_pairs(spark):
    points = table(spark, []).withColumnRenamed("vector", "unit")
    assert similarity.cosine_pairs(points, 0.1).count() == 0
    assert tuple(similarity.compared_pairs(points, 0.1).first()) == (0, 0, 0, 0)


def test_tree_covers_its_points(spark, monkeypatch):
    monkeypatch.setattr(pivot_tree, "leaf_rows", lambda dims: 12)
    monkeypatch.setattr(pivot_tree, "FAN", 4)
    x = crowd(3, n=150, dims=6)
    points, _ = similarity.distinct_directions(table(spark, x))
    tree = pivot_tree.build_tree(points)
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    placed = tree.points.collect()
    assert sorted(p["id"] for p in placed) == sorted(r["id"] for r in points.collect())
    assert max(n.count("/") for n in nodes) > 1
    for p in placed:
        node = nodes[p["leaf"]]
        assert node["leaf"] and node["n"] <= 12
        away = np.linalg.norm(np.array(p["unit"]) - np.array(node["pivot"]))
        assert node["low"] - 1e-6 <= away <= node["high"] + 1e-6


@pytest.mark.parametrize("n", [1500, 15000])
def test_grouped_vectors_compare_a_small_part_of_all_pairs(spark, monkeypatch, n):
    monkeypatch.setattr(pivot_tree, "leaf_rows", lambda dims: n // 30)
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(60, 16))
    x = middle[rng.integers(0, 60, n)] + 0.05 * rng.normal(size=(n, 16))
    points, _ = similarity.distinct_directions(table(spark, x))
    work = similarity.compared_pairs(points, 0.02).first()
    assert work["n_points"] == n and work["n_compared"] < 0.1 * n * n / 2


@pytest.mark.parametrize("threshold", [0.1, 0.4])
def test_sparse_pairs_equal_brute_force(spark, threshold):
    r = random.Random(4)
    docs = {f"d{i}": {f"t{min(r.randrange(12), r.randrange(12))}": r.random() + 0.1 for _ in range(r.randrange(1, 6))} for i in range(50)}
    unit = {k: {t: w / math.sqrt(sum(v * v for v in d.values())) for t, w in d.items()} for k, d in docs.items()}
    weights = spark.createDataFrame([(k, t, w) for k, d in unit.items() for t, w in d.items()], "id string, term string, weight double")
    found = {(x["id_a"], x["id_b"]): x["distance"] for x in similarity.sparse_cosine_pairs(weights, threshold).collect()}
    expected = {
        (a, b): 1 - sum(w * unit[b].get(t, 0) for t, w in unit[a].items()) for a in unit for b in unit if a < b
    }
    expected = {k: d for k, d in expected.items() if d < threshold}
    assert set(found) == set(expected)
    assert all(found[k] == pytest.approx(d) for k, d in expected.items())


def test_components_of_chains_stars_and_copies(spark, rows):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    r.shuffle(edges)
    found = components.connected_components(spark.createDataFrame(edges + edges[:9], "u long, v long"))
    assert rows(found) == sorted(((v, root(v)) for v in parent), key=repr)


def brute_clusters(x, threshold, how):
    groups = [[i] for i in range(len(x))]
    d = cosine(x, x)
    measure = {"average": np.mean, "complete": np.max, "single": np.min}[how]
    while True:
        best = min(
            ((measure(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=None
        )
        if best is None or best[0] >= threshold:
            return {frozenset(g) for g in groups}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("how, local_points, n", [("average", 1000, 60), ("complete", 1000, 60), ("single", 1000, 60), ("average", 0, 24), ("complete", 0, 24)])
def test_clusters_equal_brute_force(spark, how, local_points, n):
    x = crowd(9, n=n, noise=0.5)
    found = clustering.agglomerative_clusters(table(spark, x), 0.3, how, local_points).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in groups.values()} == brute_clusters(x, 0.3, how)
    assert all(min(g) == c for c, g in groups.items())


@pytest.mark.parametrize("how", ["average", "complete"])
def test_ties_merge_alike_in_memory_and_by_joins(spark, how):
    # Evenly spaced points on arcs: most distances are equal, and every arc is a component of its own.
    arcs, points, width = 6, 9, 96
    x = np.zeros((arcs * points, 2 * arcs))
    for a in range(arcs):
        angle = 0.2 * np.arange(points)
        x[a * points : (a + 1) * points, 2 * a : 2 * a + 2] = np.column_stack([np.cos(angle), np.sin(angle)])
    assert len(x) < width
    ways = [{r["id"]: r["cluster"] for r in clustering.agglomerative_clusters(table(spark, x), 0.08, how, size).collect()} for size in (1000, 2)]
    assert ways[0] == ways[1] and 1 < len(set(ways[0].values())) < len(x)


def test_sparse_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(13)
    x = np.abs(crowd(13, n=36, dims=6, centres=4, noise=0.3)) * (rng.random((36, 6)) < 0.8) + np.array([0.3, 0, 0, 0, 0, 0])
    x[5] = x[9] = x[20]  # copies
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    weights = spark.createDataFrame([(i, f"t{t}", float(unit[i, t])) for i in range(36) for t in range(6) if unit[i, t] > 0], "id long, term string, weight double")
    found = {}
    for r in text_clusters.sparse_clusters(weights, 0.1).collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in found.values()} == brute_clusters(x, 0.1, "average") and all(min(g) == c for c, g in found.items())


def greedy(similar, weight, bound):
    """Merges of the two nearest groups, one at a time; equal ones in the order of their names."""
    n = len(similar)
    groups = {i: [i] for i in range(n)}

    def value(a, b):
        cells = [similar[i][j] for i in groups[a] for j in groups[b]]
        if weight is None:
            return min(cells) << linkage.MEAN
        return (sum(cells) << linkage.MEAN) // (sum(weight[i] for i in groups[a]) * sum(weight[j] for j in groups[b]))

    while len(groups) > 1:
        far, low, high = min((-value(a, b), a, b) for a in groups for b in groups if a < b)
        if -far <= bound:
            break
        groups[high] += groups.pop(low)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("how", ["average", "complete"])
def test_chain_equals_greedy_merging(seed, how):
    r = random.Random(seed)
    n = r.randrange(1, 14)
    weight = [r.randrange(1, 4) for _ in range(n)]
    few = r.choice([3, 1000])  # three values make most distances equal
    similar = np.zeros((n, n), object)
    for i in range(n):
        for j in range(i):
            similar[i, j] = similar[j, i] = r.randrange(few) * (weight[i] * weight[j] if how == "average" else 1)
    bound = (few // 3) << linkage.MEAN
    group = linkage.nearest_neighbour_chain(similar, weight if how == "average" else None, bound)
    found = {}
    for i in range(n):
        top = i
        while group[top] != top:
            top = group[top]
        found.setdefault(top, set()).add(i)
    assert {frozenset(g) for g in found.values()} == greedy(similar.tolist(), weight if how == "average" else None, bound)


def test_products_of_whole_numbers_are_exact():
    r = random.Random(7)
    x = [[r.randrange(-(2**45), 2**45) for _ in range(5)] for _ in range(4)]
    assert linkage.exact_products(x).tolist() == [[sum(p * q for p, q in zip(a, b)) for b in x] for a in x]


def test_rounds_of_a_chain_graph_are_few(spark):
    n = 120
    angle = 0.02 * np.arange(n)
    points, _ = similarity.distinct_directions(table(spark, np.column_stack([np.cos(angle), np.sin(angle)])))
    edges = similarity.cosine_pairs(points, 0.0003)  # neighbours only
    merges, rounds = linkage.merge_rounds(points, edges, 0.0003, "complete", 2)
    assert merges.count() > n / 3 and 1 <= rounds <= 12


def test_small_clusters_and_zero_vectors(spark):
    x = np.array([[1, 0], [1, 0.01], [1, 0.02], [0, 1], [0, 0]])
    found = {r["id"]: r["cluster_id"] for r in clustering.cluster_profiles(table(spark, x), 0.1, min_size=3).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: -1, 4: -2}


def test_product_clusters(spark):
    x = np.array([[1, 0], [1, 0], [0, 1], [0.05, 1], [0.1, 1], [-1, -1]])
    found = {r["id"]: r["cluster_id"] for r in clustering.cluster_products(table(spark, x), 0.01, 2).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: -1}


def brute_silhouette(x, labels, metric):
    d = cosine(x, x) if metric == "cosine" else ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, 0.0)
    scores = []
    for i, own in enumerate(labels):
        same = [j for j, c in enumerate(labels) if c == own and j != i]
        if not same:
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, [j for j, c in enumerate(labels) if c == other]].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean"])
@pytest.mark.parametrize("chunk", [2048, 2])
def test_silhouette(spark, monkeypatch, metric, chunk):
    monkeypatch.setattr(clustering, "CLASS_CHUNK", chunk)
    x = crowd(5, n=40)
    labels = [f"c{i % 6}" for i in range(39)] + ["alone"]
    df = spark.createDataFrame([(i, c, [float(v) for v in row]) for i, (c, row) in enumerate(zip(labels, x))], "id long, class string, vector array<double>")
    assert clustering.silhouette(df, metric).first()["silhouette"] == pytest.approx(brute_silhouette(x, labels, metric))
    assert clustering.silhouette(df.filter("class = 'c1'"), metric).first()["silhouette"] is None


def test_class_tables(spark):
    x = crowd(6, n=30)
    labels = ["a"] * 15 + ["b"] * 14 + ["c"]
    df = spark.createDataFrame([(i, c, [float(v) for v in row]) for i, (c, row) in enumerate(zip(labels, x))], "id long, class string, vector array<double>")
    s = 1 - cosine(x, x)
    rows_of = lambda c: [i for i, label in enumerate(labels) if label == c]
    inside = lambda c: np.mean([s[i, j] for i in rows_of(c) for j in rows_of(c) if i < j])
    found = {r["class"]: r["cohesion"] for r in vectors.cohesion(df).collect()}
    assert found["a"] == pytest.approx(inside("a")) and found["b"] == pytest.approx(inside("b")) and found["c"] is None
    cells = {(r["class_a"], r["class_b"]): r["value"] for r in vectors.affinity_matrix(df).collect()}
    assert cells[("a", "b")] == pytest.approx(s[np.ix_(rows_of("a"), rows_of("b"))].mean())
    assert cells[("b", "a")] == pytest.approx(cells[("a", "b")])
    diff = {(r["class_a"], r["class_b"]): r["value"] for r in vectors.difference_table(vectors.affinity_matrix(df)).collect()}
    assert diff[("b", "a")] == pytest.approx(cells[("a", "b")] - cells[("a", "a")]) and diff[("b", "b")] == 0.0
    assert diff[("c", "b")] == pytest.approx(cells[("b", "c")] - cells[("b", "b")])


def test_profile_vectors(spark):
    mentions = spark.createDataFrame([("u", "a"), ("u", "a "), ("u", "b"), ("v", "b"), ("w", "c")], "user string, text string")
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "product string, vector array<double>")
    users = spark.createDataFrame([("u",), ("v",), ("w",), ("x",)], "user string")
    found = {r["user"]: r["vector"] for r in vectors.profile_vectors(mentions, items, users, 2, 4).collect()}
    wa, wb = 2 * 1.0 * math.log(4 / 1), 1 * 0.75 * math.log(4 / 2)
    assert found["u"] == pytest.approx([wa / (wa + wb), wb / (wa + wb)])
    assert found["v"] == [0.0, 1.0] and found["w"] == [0.0, 0.0] and found["x"] == [0.0, 0.0]
    plain = {r["user"]: r["vector"] for r in vectors.profile_vectors(mentions, items, users, 2, 4, use_tf_idf=False).collect()}
    assert plain["u"] == pytest.approx([2 / 3, 1 / 3])


def test_profile_vectors_in_blocks_and_slices(spark, monkeypatch):
    rng = random.Random(4)
    made = [(f"u{u}", f"p{rng.randrange(30)}") for u in range(40) for _ in range(1 + u * u // 20)]
    mentions = spark.createDataFrame([*made, (None, "p1")], "user string, text string")
    items = {f"p{p}": [rng.random() for _ in range(8)] for p in range(25)}  # five products have no vector
    frame = spark.createDataFrame(list(items.items()), "product string, vector array<double>")
    users = spark.createDataFrame([(f"u{u}",) for u in range(42)], "user string")
    for limit in (1 << 20, 200):  # one block, then several blocks and profiles of several slices
        monkeypatch.setattr(blocks, "BLOCK_NUMBERS", limit)
        found = {r["user"]: r["vector"] for r in vectors.profile_vectors(mentions, frame, users, 8, 42, use_tf_idf=False).collect()}
        for u in range(42):
            own = [items[p] for v, p in made if v == f"u{u}" and p in items]
            assert found[f"u{u}"] == pytest.approx(np.mean(own, axis=0) if own else np.zeros(8))


def test_profile_vectors_do_not_travel_with_mentions(spark):
    mentions = spark.range(3000).selectExpr("concat('u', id % 500) AS user", "concat('p', id % 7) AS text")
    items = spark.range(7).selectExpr("concat('p', id) AS product", "array(1.0D, id * 1.0D) AS vector")
    plan = vectors.profile_vectors(mentions, items, mentions.select("user").distinct(), 2, 500)._jdf.queryExecution().optimizedPlan().toString()
    # Vectors meet mentions inside a block; no row of a mention with its vector is aggregated.
    assert "FlatMapCoGroupsInArrow" in plan and "SummaryBuilder" not in plan


def test_product_in_every_profile_weighs_nothing(spark):
    mentions = spark.createDataFrame([("u", "a"), ("v", "a")], "user string, text string")
    items = spark.createDataFrame([("a", [1.0, 0.0])], "product string, vector array<double>")
    users = mentions.select("user")
    found = vectors.profile_vectors(mentions, items, users, 2, 2)
    assert all(r["vector"] == [0.0, 0.0] for r in found.collect())


def test_char_grams(spark, rows):
    words = spark.createDataFrame([("u", "É", 2), ("u", "ab", 1)], "user string, word string, n long")
    found = dict((g, n) for _, g, n in rows(tfidf.gram_counts(words)))
    assert found == {" ": 6, "e": 2, " e": 2, "e ": 2, " e ": 2, "a": 1, "b": 1, " a": 1, "ab": 1, "b ": 1, " ab": 1, "ab ": 1, " ab ": 1}
    norms = tfidf.char_tfidf(words, 1).groupBy("user").agg(F.sum(F.col("weight") * F.col("weight")).alias("s"))
    assert norms.first()["s"] == pytest.approx(1.0)


def test_char_weights_in_blocks_and_slices(spark, rows, monkeypatch):
    made = [(None if u == 3 else f"u{u}", f"w{'é' * (w % 3)}{w}-{w * u % 4}", 1 + (u + w) % 3) for u in range(40) for w in range(0, 60, 1 + u)]
    words = spark.createDataFrame([*made, ("u0", "a", 2), ("x", "b", 1)], "user string, word string, n long")
    counts, weights = rows(tfidf.gram_counts(words)), rows(tfidf.char_tfidf(words, 41).withColumn("weight", F.round("weight", 9)))
    joined = words.join(tfidf._word_grams(words, 4), "word").groupBy("user", "gram").agg(F.sum(F.col("n") * F.col("k")).alias("n"))
    assert counts == rows(joined) and len(counts) == len(weights)
    monkeypatch.setattr(blocks, "BLOCK_NUMBERS", 700)  # several blocks, and profiles of several slices
    assert rows(tfidf.gram_counts(words)) == counts
    cut = tfidf.char_tfidf(words, 41)
    assert rows(cut.withColumn("weight", F.round("weight", 9))) == weights


def test_char_weights_move_no_grams(spark):
    words = spark.range(2000).selectExpr("concat('u', id % 500) AS user", "concat('a long product name ', id % 20) AS word", "id % 3 + 1 AS n")
    plan = tfidf.char_tfidf(words, 500)._jdf.queryExecution().optimizedPlan().toString()
    # The grams of a profile come out of the last step; no join or aggregate above it takes them up again.
    assert "CoGroup" in plan.split("\n")[0] and "Aggregate [user" not in plan


def test_cluster_names(spark, rows):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, -1)], "id long, cluster_id long")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.2]), (3, [0.0, 1.0]), (4, [1.0, 1.0])], "id long, vector array<double>")
    products = spark.createDataFrame([(1, "shoe"), (2, "zoo"), (1, "far"), (3, "away"), (4, "x")], "id long, product string")
    items = spark.createDataFrame([("shoe", [1.0, 0.1]), ("zoo", [2.0, 0.2]), ("far", [0.0, 1.0]), ("away", [0.0, -1.0])], "product string, vector array<double>")
    names = clustering.cluster_names(clusters, vecs, products, items)
    assert rows(names) == [(1, "shoe"), (3, "")]
    shown = clustering.with_names(clusters, names)
    assert rows(shown.select("id", "cluster_name")) == [(1, "shoe"), (2, "shoe"), (3, ""), (4, "NO_CLUSTER")]


def test_close_clusters(spark, rows):
    medians = spark.createDataFrame([("a", 0.1, 0.1), ("b", 0.9, -0.2), ("c", 1.95, 0.1), ("d", -0.5, 0.6)], "cluster string, x double, y double")
    points = {r["cluster"]: (r["x"], r["y"]) for r in medians.collect()}
    expected = sorted((a, b) for a in points for b in points if a < b and math.dist(points[a], points[b]) < 1)
    assert rows(clustering.close_clusters(medians).select("cluster", "other")) == expected


def test_local_merge_handles_weights():
    units = np.array([[1.0, 0.0], [math.cos(0.5), math.sin(0.5)], [math.cos(1.0), math.sin(1.0)]])

    def groups(copies):
        whole = [[round(x * 2**linkage.SCALE) * n for x in row] for row, n in zip(units.tolist(), copies)]
        group = linkage.nearest_neighbour_chain(linkage.exact_products(whole), copies, linkage._least_similarity(0.3))
        return [int(g if group[g] == g else group[g]) for g in group]

    even, heavy = groups([1, 1, 1]), groups([50, 1, 1])
    assert len(set(even)) == 1 and len(set(heavy)) == 2


@pytest.mark.parametrize("inclusive", [False, True])
def test_links_have_the_components_of_all_pairs_and_few_edges(spark, monkeypatch, inclusive):
    monkeypatch.setattr(pivot_tree, "leaf_rows", lambda dims: 9)
    monkeypatch.setattr(similarity, "LEAST_HOME_VALUES", 80)
    monkeypatch.setattr(similarity, "VISITS", 3)
    x = crowd(17, n=150, dims=5)
    points, _ = similarity.distinct_directions(table(spark, x))
    pairs = similarity.cosine_pairs(points, 0.15, inclusive).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    links = similarity.cosine_links(points, 0.15, inclusive)
    n, homes = points.count(), 3
    assert links.count() < min(homes * n, pairs.count())
    found, expected = (sorted(map(tuple, components.connected_components(e).collect())) for e in (links, pairs))
    assert found == expected and len({c for _, c in found}) > 1


def test_a_vector_visits_no_more_tasks_than_there_are_homes(spark, monkeypatch):
    monkeypatch.setattr(pivot_tree, "leaf_rows", lambda dims: 10)
    monkeypatch.setattr(similarity, "LEAST_HOME_VALUES", 64)
    monkeypatch.setattr(similarity, "VISITS", 4)
    x = np.random.default_rng(4).normal(size=(300, 8))  # no grouping: every leaf meets every other
    points, _ = similarity.distinct_directions(table(spark, x))
    coming, homes = similarity._met_homes(points, 0.9)
    assert homes == 4 and coming.agg(F.sum("n")).first()[0] <= 4 * 300


@pytest.mark.parametrize("how", ["average", "complete"])
def test_rounds_need_connected_edges_and_no_pairs(spark, how):
    points, _ = similarity.distinct_directions(table(spark, crowd(19, n=30, noise=0.5)))
    links = similarity.cosine_links(points, 0.3).select(F.col("u").alias("id_a"), F.col("v").alias("id_b"))
    ways = [sorted(map(tuple, linkage.agglomerate(points, links, 0.3, how, size).collect())) for size in (1000, 2)]
    assert ways[0] == ways[1] and 1 < len({c for _, c in ways[0]}) < len(ways[0])


def test_copies_but_for_rounding_are_one_point(spark):
    x = np.array([[0.3, 0.4, 0.5], [0.3 + 5e-16, 0.4, 0.5], [0.3, 0.4 - 5e-16, 0.5], [0.3, 0.4, 0.6]])
    assert similarity.distinct_directions(table(spark, x))[0].count() > 2
    points, members = similarity.distinct_directions(table(spark, x), linkage.SCALE)
    assert sorted((r["id"], r["copies"]) for r in points.collect()) == [(0, 3), (3, 1)]
    assert sorted(map(tuple, members.collect())) == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_words_are_learned_on_all_cores(spark, monkeypatch):
    used, learner = [], vectors.Word2Vec
    monkeypatch.setattr(vectors, "Word2Vec", lambda **given: used.append(given["numPartitions"]) or learner(**given))
    docs = spark.range(60).select(F.concat(F.lit("Red ring "), F.col("id")).alias("text")).coalesce(1)
    found = {r["token"]: len(r["vector"]) for r in vectors.train_word_vectors(docs, dims=4, min_count=60).collect()}
    assert found == {"red": 4, "ring": 4} and used == [spark.sparkContext.defaultParallelism]


def test_copies_are_pairs_and_linked_nodes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pivot_tree, "leaf_rows", lambda dims: 4)
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [0.0, 3.0]), (5, [-1.0, -1.0]), (6, [0.0, 0.0]), (7, [0.0, 0.0]), (8, None), (None, [1.0, 0.0])]
    vectors_of = spark.createDataFrame([(i, 0, v) for i, v in rows], "vec_id long, label int, embedding array<double>")
    vectors_of.write.parquet(f"{tmp_path}/embeddings.parquet")
    near = {tuple(r) for r in vector_queries.j13(spark, str(tmp_path)).select("id_a", "id_b").collect()}
    assert near == {(0, 1), (0, 2), (1, 2), (3, 4)}
    assert {tuple(r) for r in vector_queries.v8(spark, str(tmp_path)).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)}


def test_many_copies_are_all_paired_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIR_ROWS", 50)
    points = similarity.all_vectors(table(spark, np.ones((60, 3))))
    found = similarity.cosine_pairs(points, 0.1).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in found) == [(a, b) for a in range(60) for b in range(a + 1, 60)]
