"""Line dedup, decontamination, n-gram join and embeddings against brute force, and their defined cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallbook.llm import decontamination, embedding_dedup, line_dedup, ngram_join

# The extra columns have names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, keep string, words string, hi long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "w", 2) for i, t in rows], DOCS)


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = [line(8) for _ in range(12)]
    out = []
    for i in range(120):
        lines = [str(rng.choice(shared)) if rng.random() < 0.3 else line(rng.integers(1, 30)) for _ in range(rng.integers(1, 9))]
        out.append((i, "\n".join(lines)))
    for i in range(120, 170):  # copies and near copies of earlier texts
        base = out[int(rng.integers(0, 40))][1].split(" ")
        for _ in range(int(rng.integers(0, 4))):
            base[int(rng.integers(0, len(base)))] = str(rng.choice(vocabulary))
        out.append((i, " ".join(base)))
    long = line(30000)
    return [*out, (170, long), (171, long + " Ende"), (172, None), (173, ""), (174, "..."), (175, "a"), (176, "A"), (None, out[3][1]), (5, out[5][1])]


def test_lines_equal_brute_force(spark, texts):
    held = {}
    key = lambda line: line.translate(LOWER).strip(" \t\n\x0b\x0c\r")
    for i, t in texts:
        for line in (t or "").split("\n") if i is not None else ():
            held[key(line)] = min(held.get(key(line), i), i)
    expected = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or held[key(x)] == i]
        expected.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    joined = line_dedup.with_bitmaps(frame(spark, texts))
    found = [tuple(r) for r in joined.select("row.doc_id", line_dedup.kept_digest("row.text", "keep").alias("d")).select("doc_id", "d.*").collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_line_that_fills_partitions_has_one_first_document(spark, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = frame(spark, [(i, f"one very common line\nline number {i}\nÄß short") for i in range(400)])
        cut = line_dedup.drop_repeated_lines(docs)
        assert cut.columns == docs.columns
        assert [r[0] for r in cut.filter(F.col("text").contains("common")).select("doc_id").collect()] == [0]
        assert cut.filter(F.col("text").contains("short")).count() == 400 and cut.filter("n_chars = char_length(text)").count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bitmaps_are_bits():
    packed = line_dedup._pack.func(__import__("pandas").Series([[1, 9]])).iloc[0]
    assert line_dedup.kept_lines("\n".join("abcdefghijkl"), packed) == (list("acdefghikl"), 12)


def test_phrases_equal_brute_force(spark, texts):
    items = [(1, texts[0][1]), (2, " ".join(words_of(texts[1][1])[2:9])), (2, "a"), (3, None), (None, texts[2][1]), (4, "... !"), (5, texts[170][1][:400]), (6, "nowhere " * 3)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = set()
    for i, t in items:
        w = words_of(t)
        windows |= {(str(i), tuple(w[a : a + 10])) for a in range(max(1, len(w) - 9))} if w and i is not None else set()
    expected = []
    for i, t in texts:
        w, hit, found = words_of(t), set(), set()
        for item, g in windows:
            for a in range(len(w) - len(g) + 1):
                if w[a] == g[0] and tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    found.add(item)
        expected.append((i, len(w), len(hit), sorted(found)))
    index = decontamination.build_index(frame(spark, texts).repartition(3))
    for block in (decontamination.BLOCK_WINDOWS, 40):  # one pass, and several
        found = decontamination.matches(index, benchmark, block_windows=block)
        rows = [(r[0], r[1], r[2], sorted(r[3])) for r in found.select("doc_id", "n_words", decontamination.n_hit(), "items").collect()]
        assert sorted(rows, key=repr) == sorted(expected, key=repr)
    clean = decontamination.drop_contaminated(frame(spark, texts), benchmark)
    assert clean.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r[0] for r in clean.select("doc_id").collect()), key=repr) == sorted((e[0] for e in expected if not e[2]), key=repr)


def test_proximity(spark):
    docs = frame(spark, [(1, "x red y blue z green"), (2, "green blue red"), (3, "red a b c d blue e f green"), (4, "red blue")])
    item = spark.createDataFrame([(7, "red blue green")], "item_id long, text string")
    index = decontamination.build_index(docs)
    near = lambda slop: {r[0]: [tuple(s) for s in r[1]] for r in decontamination.matches(index, item, slop=slop).filter("size(spans) > 0").select("doc_id", "spans").collect()}
    assert near(0) == {}
    assert near(2) == {1: [(1, 6)], 2: [(0, 3)]}
    assert set(near(6)) == {1, 2, 3}


def brute_links(texts, threshold=8):
    sets = {}
    for i, t in texts:
        w = words_of(t)
        if i is not None and w:
            sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))}
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if a < b and common * 10 >= threshold * (len(sets[a]) + len(sets[b]) - common):
                links[a].add(b)
                links[b].add(a)
    return links


def smallest_reachable(links, i):
    seen, todo = {i}, [i]
    while todo:
        for j in links.get(todo.pop(), ()):
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return min(seen)


@pytest.mark.parametrize("block", [1024, 8])
def test_similar_documents_equal_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)  # groups of one block, and of many
    some = [(i, t) for n, (i, t) in enumerate(texts) if n < len(texts) - 1]  # without the repeated doc_id
    extra = [(1000 + i, " ".join(f"w{n}" for n in range(200)) + f" tail {i}") for i in range(30)]
    links = brute_links(some + extra)
    found = {r["doc_id"]: r for r in ngram_join.similar_documents(frame(spark, some + extra)).collect()}
    for i, _ in some + extra:
        if i is not None:
            assert (found[i]["n_links"], found[i]["class_id"]) == (len(links.get(i, ())), smallest_reachable(links, i)), i
    assert (found[None]["n_links"], found[None]["class_id"]) == (0, None)
    kept = ngram_join.keep_one(frame(spark, some + extra))
    assert sorted(r[0] for r in kept.filter("doc_id is not null").select("doc_id").collect()) == sorted(i for i, _ in some + extra if i is not None and smallest_reachable(links, i) == i)
    assert kept.filter("doc_id is null").count() == 1


def test_bands_serve_every_threshold(spark):
    assert ngram_join.rows_and_bands(0.8) == (6, 32)
    for threshold in (0.01, 0.3, 0.5, 0.6, 0.7, 0.9, 0.99):
        rows, bands = ngram_join.rows_and_bands(threshold)
        assert (1 - threshold**rows) ** bands <= ngram_join.MISS * 1.001
    assert ngram_join.rows_and_bands(1.0)[1] == 1
    for threshold in (0, -1, 1.1):
        with pytest.raises(ValueError):
            ngram_join.rows_and_bands(threshold)
    # Pairs of 60 words of which the first 46 are equal: 42 of 70 5-grams, a similarity of 0.6.
    words = lambda i, k, a, b: [f"{k}{i}x{n}" for n in range(a, b)]
    rows = [(2 * i + side, " ".join(words(i, "w", 0, 46) + words(i, "ab"[side], 0, 14))) for i in range(300) for side in (0, 1)]
    found = ngram_join.similar_documents(frame(spark, rows), threshold=0.6).collect()
    assert [r["doc_id"] for r in found if r["n_links"] != 1] == []


def test_rows_with_one_doc_id_are_one_node(spark):
    long = " ".join(f"w{n}" for n in range(50))
    docs = frame(spark, [(5, long), (5, long), (9, long + " x"), (5, "something else"), (7, "something else")])
    found = {(r["doc_id"], r["class_id"]) for r in ngram_join.similar_documents(docs).collect()}
    assert found == {(5, 5), (9, 5), (7, 5)}


def template_corpus(n, seed=4):
    """Texts of one template and words of their own: a similarity of about 0.42 with each other."""
    rng = np.random.default_rng(seed)
    template = " ".join(f"t{i}" for i in range(94))
    return [(i, template + " " + " ".join(f"o{i}x{w}" for w in rng.integers(0, 10**6, 62))) for i in range(n)]


def test_a_shared_template_forms_no_group(spark):
    docs = frame(spark, template_corpus(3000)).select("doc_id", F.col("text").cast("binary").alias("text"))
    signed = docs.mapInArrow(ngram_join._signatures(5, 0.8), "doc_id long, words binary, bands array<long>, sketch binary")
    shared = signed.select("doc_id", F.explode("bands").alias("key")).groupBy("key").count().filter("count > 1")
    assert shared.count() > 0  # buckets are shared, groups are not
    _, nodes = ngram_join.candidate_groups(signed, 0.8, 1e-6)
    assert nodes.count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_blocks_of_a_bucket_connect_all_that_link(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", block)
    rows = [(i, " ".join(f"w{n}" for n in range(200)) + f" tail {i}") for i in range(60)]
    found = ngram_join.similar_documents(frame(spark, rows)).collect()
    assert {(r["class_id"], r["n_links"]) for r in found} == {(0, 59)}


def test_the_threshold_is_the_decimal_fraction(spark):
    # 13 of 16 n-grams: 0.8125 is reached, 0.8126 is not.
    words = [f"w{n}" for n in range(17)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "a", "b", "c"]))]
    links = lambda t: {r["n_links"] for r in ngram_join.similar_documents(frame(spark, rows), threshold=t).collect()}
    assert links(0.8125) == {1} and links(0.8126) == {0}


def test_posterior_bound():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert least[32] < 32 * 0.8 and least[256] < 256 * 0.8 and all(0 < least[n] for n in least)


VECTORS = "vec_id long, embedding array<float>, label int, component string, rep long"


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(32).tolist(), int(i % 3)) for i in range(300)]
    for i in range(300, 420):
        base = np.array(rows[int(rng.integers(0, 30))][1])
        rows.append((i, (base + rng.standard_normal(32) * rng.choice([0, 0.05, 0.3])).tolist(), int(rng.integers(0, 3))))
    rows += [(500, None, 1), (501, [0.0] * 32, 1), (502, [float("nan")] * 32, 1), (503, [1.0, None] + [0.0] * 30, 1), (504, rows[0][1], None), (505, [], 0)]
    rows += [(506, [2.0, 1.0], 0), (507, [4.0, 2.0], 0), (508, [float("inf")] * 32, 0), (None, rows[0][1], 0)]
    vectors = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)
    good = {i: (np.array(v, np.float32).astype(float), k) for i, v, k in rows if i is not None and v and k is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i in good}
    for a, (x, k) in good.items():
        for b, (y, m) in good.items():
            if a != b and k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a].add(b)
    found = {r["vec_id"]: r for r in embedding_dedup.similar_vectors(vectors).collect()}
    total = sum(map(len, links.values()))
    assert sum(found[i]["n_links"] for i in links) >= 0.99 * total > 0
    for i, _, _ in rows:
        if i is None:
            assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, None, True)
        else:
            assert found[i]["n_links"] <= len(links.get(i, ()))
            assert smallest_reachable(links, i) <= found[i]["component_id"] <= i
            assert found[i]["kept"] == (found[i]["component_id"] == i)


@pytest.mark.parametrize("largest", [10**3, 10**6, 10**8])
def test_buckets_hold_pairs_at_the_threshold_at_any_size(largest):
    rng = np.random.default_rng(6)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 6000, 64)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    n = len(x)
    table = {"rep": np.arange(n), "copies": np.ones(n, np.int64), "label": np.zeros(n, np.int64), "dims": np.full(n, 64)}
    keys = []
    for side in (x, y):
        batch = pa.RecordBatch.from_pydict(table | {"embedding": pa.array(side.tolist())})
        keys.append(np.array(next(embedding_dedup._code(0.93, largest, 0.995)(iter([batch]))).column("keys").to_pylist()))
    assert (keys[0] != keys[1]).all(axis=1).mean() < 0.009  # 0.005 is promised


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    x, y = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 64)))
    y = 0.9 * x + np.sqrt(1 - 0.81) * (y - (y @ x) * x) / np.linalg.norm(y - (y @ x) * x)
    errors, inside = [], 0
    for seed in range(200):
        q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((256, 256)))
        turned = np.stack([x, y]) @ q[:64]
        signs = (turned[1:] >= 0).astype(np.uint8)
        factor = np.abs(turned[1:]).sum(axis=1) / 16
        guess, width = embedding_dedup.estimates(turned[:1], signs, factor)
        errors.append(guess[0, 0] - x @ y)
        inside += abs(errors[-1]) <= width[0]
    assert abs(np.mean(errors)) < 0.01 and inside == 200


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert ngram_join.similar_documents(none).count() == 0
    assert embedding_dedup.similar_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert decontamination.matches(decontamination.build_index(none), items).count() == 0
    assert decontamination.drop_contaminated(frame(spark, [(1, "a b")]), items).count() == 1
