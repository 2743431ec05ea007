"""Toxicity, quality and language: held-out accuracy on small texts, exact parts against brute force, defined cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallbook.llm import language, learning, quality, toxicity
from stallbook.llm.tokens import split_words

DOCS = "doc_id long, text string, lang string, source string, y int, row long"
SYLLABLES = {"aa": ["ba", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "keit", "ver", "eß"], "cc": ["ción", "os", "que", "lla", "ñe"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(400):
        lang = ["aa", "bb", "cc"][i % 3]
        words = text_of(rng, lang, int(rng.integers(5, 80))).split(" ")
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["zork", "blaxx", "quorg"])))
        out.append((i, " ".join(words), lang, int(toxic)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", y, 1) for i, t, lang, y in rows], DOCS)


ODD = [(900, None, None, None), (901, "", "aa", None), (902, "123 ... 456", None, None), (903, "x" * 200000, None, None), (None, "zork blaxx", None, None), (904, "ba lo", None, None), (904, "ba lo", None, None)]


def test_folds(spark):
    found = spark.range(50).toDF("doc_id").select(F.col("doc_id").alias("id"), learning.held_out(4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in found)


def test_sample_is_bounded_and_knows_its_share(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)] + [(None, 1), (300, 7), (301, None), (5, 1), (5, 0)], "doc_id long, y int")
    found = learning.sampled(labels.withColumnRenamed("y", "toxic"), "toxic", 30).collect()
    by = {y: [r for r in found if r["y"] == y] for y in (0, 1)}
    assert len(by[0]) == 30 and len(by[1]) == 20 and by[1][0]["share"] == 1.0
    assert by[0][0]["share"] == pytest.approx(30 / 179)  # document 5 has two labels


def test_words_are_those_of_the_pattern():
    import re

    texts = ["Ab-9é x\x00y", "", "ÄÖ Z", "a", "b b"]
    words = split_words(pa.array([t.encode() for t in texts], pa.binary()))
    terms = words.terms.to_pylist()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        expected = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
        assert [terms[c].decode() for c in words.codes[words.starts[i] : words.starts[i + 1]]] == expected


def test_toxicity(spark, rows):
    docs = frame(spark, rows + ODD)
    labels = docs.filter("doc_id % 4 <> 1").select("doc_id", F.col("y").alias("toxic"), F.lit("x").alias("text"))
    model = toxicity.fit(docs, labels)
    assert b"zork" in model.terms and b"ba" not in model.terms
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((found[i]["score"] >= 0.3) == bool(y) for i, _, _, y in rows)
    assert found[None]["score"] >= 0.3 and all(found[i]["score"] < 0.3 for i in (900, 901, 902, 903, 904))
    assert found[0]["evidence"] and all(0 <= r["score"] <= 1 for r in found.values())
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 320 + 6
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r["doc_id"] for r in toxicity.score(docs, model).filter("score < 0.3").collect()), key=repr)
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_nearest_examples_are_exact(spark, rows):
    docs = frame(spark, rows)
    model = toxicity.fit(docs, docs.select("doc_id", F.col("y").alias("toxic")))
    n, rng = len(model.ids), np.random.default_rng(6)
    full = np.zeros((n, len(model.idf)))
    for t in range(len(model.idf)):
        full[model.example[model.ptr[t] : model.ptr[t + 1]], t] = model.weight[model.ptr[t] : model.ptr[t + 1]]
    assert np.allclose((full**2).sum(axis=1), 1)
    for _ in range(50):
        own = rng.choice(len(model.idf), int(rng.integers(1, len(model.idf) + 1)), replace=False)
        weights = rng.random(len(own))
        weights /= np.linalg.norm(weights)
        _, cosines = toxicity.nearest(model, own, weights, 15)
        assert np.allclose(cosines, np.sort(full[:, own] @ weights)[::-1][: len(cosines)])


def test_rates_rise(spark):
    x, y = np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1.0])
    at, rate = toxicity.monotone(x, y, np.ones(5), 0.5)
    assert (np.diff(at) > 0).all() and (np.diff(rate) >= 0).all()


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None)]])
def test_labels_of_one_class(spark, rows, labels):
    docs = frame(spark, rows[:20])
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    expected = 1.0 if any(y for _, y in labels) else 0.5
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, given)).collect()} == {expected}
    ranked = quality.fit(docs, given.withColumnRenamed("toxic", "quality"))
    assert {r["score"] for r in quality.score(docs, ranked).collect()} == {expected}


def test_quality(spark, rows):
    junk = [(1000 + i, t.upper().replace(" ", "!! "), lang, 0) if i % 2 else (1000 + i, " | ".join(t.split(" ")[:4] * 9), lang, 0) for i, t, lang, _ in rows[:120]]
    marked = [(i, t, lang, 1) for i, t, lang, _ in rows] + junk
    docs = frame(spark, marked + ODD)
    model = quality.fit(docs, docs.filter("doc_id % 3 <> 1").select("doc_id", F.col("y").alias("quality")))
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(i, y) for i, _, _, y in marked if i % 3 == 1]
    assert np.mean([(found[i] >= 0.5) == bool(y) for i, y in held]) >= 0.97
    assert all(0 <= s <= 1 for s in found.values()) and set(found) >= {900, 901, 902, 903, None}


def test_ranking_sample_is_whole(spark, monkeypatch):
    seen = {}

    def rank(x, better, worse):
        seen.update(rows=len(x), pairs=len(better), features=x.shape[1])
        return np.zeros(x.shape[1])

    monkeypatch.setattr(quality, "rank", rank)
    rare = {0: "#", 1: "@"}  # held by one example each
    labels = spark.createDataFrame([(i, i % 2) for i in range(7000)], "doc_id long, quality int")
    docs = lambda marks: frame(spark, [(i, f"word {i % 7} more words" + marks.get(i, ""), "en", i % 2) for i in range(7000)])
    quality.fit(docs({}), labels)
    assert (seen["rows"], seen["pairs"]) == (7000, 7000 * 8)
    plain = seen["features"]
    quality.fit(docs(rare), labels)
    assert seen["features"] > plain


def test_ranking_maximises_the_pair_likelihood():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((60, 3))
    better, worse = rng.integers(0, 60, 500), rng.integers(0, 60, 500)
    swap = rng.random(500) > 1 / (1 + np.exp(-(x[better] - x[worse]) @ np.array([1.0, -2.0, 0.0])))
    better, worse = np.where(swap, worse, better), np.where(swap, better, worse)
    w = quality.rank(x, better, worse, block=64)
    loss = lambda v: np.log1p(np.exp(-(x[better] - x[worse]) @ v)).sum() + (v**2).sum() / 2
    assert all(loss(w) <= loss(w + d) for d in 0.01 * rng.standard_normal((20, 3)))
    assert w[0] > 0.5 and w[1] < -1


def test_language(spark, rows):
    switched = " ".join([rows[0][1]] * 3 + [rows[1][1]] * 3)
    docs = frame(spark, rows + ODD + [(950, switched, None, None)])
    model = language.fit(docs.filter("doc_id % 4 <> 2"))
    assert model.languages == ["aa", "bb", "cc"]
    found = {r["doc_id"]: r for r in language.label(docs, model, runs=True).collect()}
    clean = [(i, lang) for i, _, lang, y in rows if i % 4 == 2 and not y]
    assert np.mean([found[i]["lang_pred"] == lang for i, lang in clean]) >= 0.98
    for i in (900, 901, 902):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert {r["lang"] for r in found[950]["runs"]} >= {"aa", "bb"}
    ends = [(r["start"], r["end"]) for r in found[950]["runs"]]
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[-1][1] == len(switched.split())


def test_language_without_languages(spark):
    docs = frame(spark, [(1, "ba lo", None, None)])
    assert [tuple(r) for r in language.label(docs, language.fit(docs)).collect()] == [(1, "und", 0.0)]


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(8)
    scores, steps, first = rng.standard_normal((2, 4, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    lengths = np.array([4, 2])
    own, expected, log_z = language.marginals(scores, lengths, steps, first)
    counted = np.zeros((3, 3))
    for s, n in enumerate(lengths):
        paths = {p: np.exp(first[p[0]] + sum(scores[s, t, p[t]] for t in range(n)) + sum(steps[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=int(n))}
        z = sum(paths.values())
        assert np.log(z) == pytest.approx(log_z[s])
        for t in range(n):
            assert own[s, t] == pytest.approx([sum(v for p, v in paths.items() if p[t] == c) / z for c in range(3)])
        for p, v in paths.items():
            for a, b in zip(p, p[1:]):
                counted[a, b] += v / z
    assert expected == pytest.approx(counted)


def test_quality_threshold_comes_from_all_labelled_rows(spark):
    good, bad = "A plain line of words that reads well.\n", "##|| %% zz $$ @@ ||##\n"
    docs = [(i, (good if i % 5 == 0 else bad) * (1 + i % 3) + "x" * (i % 7)) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in docs], "doc_id long, quality int")
    model = quality.fit(frame, labels, examples=6)
    scores = sorted(r["score"] for r in quality.score(frame, model).collect())
    assert model.base == 24 / 120
    # As many rows lie below the threshold as are labelled 0, and it is the middle of the gap.
    assert scores[95] < 0.5 < scores[96]
    assert np.log(scores[95] / (1 - scores[95])) == pytest.approx(-np.log(scores[96] / (1 - scores[96])), rel=1e-6)


def test_quality_texts_do_not_meet_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word {i}" + "!" * (i % 2)) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    plans, store = [], quality.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(quality, "stored", stored)
    quality.fit(docs, labels)
    # Texts become numbers below the join, so the join moves no text.
    assert len(plans) == 1 and plans[0].index("Join") < plans[0].index("MapInArrow")
