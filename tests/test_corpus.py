import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stallbook.functions.text import tokenize
from stallbook.operators import alignment, corpus
from stallbook.sources import corpora

DOCS = """id long, text string, spans array<struct<start: int, end: int, label: string>>,
    relations array<struct<start1: int, end1: int, start2: int, end2: int, label: string>>"""


def frame(spark, *docs):
    return spark.createDataFrame([(i, d[0], d[1], d[2] if len(d) > 2 else []) for i, d in enumerate(docs)], DOCS)


def write(path, *records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


def test_read_annotated(spark, tmp_path, rows):
    path = write(
        tmp_path / "train.jsonl",
        {"id": 1, "text": "abc 5", "labels": [[0, 3, "PROD"], [4, 5, "MONEY"]], "relations": [[0, 3, 4, 5, "PROD_PRICE"]], "meta": {}},
        {"id": 2, "text": " \n "},
        {"id": 3, "text": "x"},
    )
    found = corpora.read_annotated(spark, path, label_column="labels")
    assert rows(found.select("id", F.size("spans"), F.size("relations"), "file")) == [(1, 2, 1, "train.jsonl"), (3, None, None, "train.jsonl")]
    assert tuple(found.select(F.inline("relations")).first()) == (0, 3, 4, 5, "PROD_PRICE")


def test_corpus_folder_finds_its_splits(spark, tmp_path, rows):
    for name in ("my_train.jsonl", "testa.jsonl", "testb.jsonl", "other.jsonl"):
        write(tmp_path / name, {"id": 1, "text": name, "entities": []})
    found = corpora.read_corpus_folder(spark, str(tmp_path)).select("split", "text")
    assert rows(found) == [("dev", "testa.jsonl"), ("test", "testb.jsonl"), ("train", "my_train.jsonl")]


@pytest.mark.parametrize("files", [{"train": 3}, {"dev": 2, "test": 1}, {"train": 1, "dev": 1, "test": 3}])
def test_union_keeps_every_given_file(spark, files):
    seven = spark.range(7)
    found = corpora.union_corpus(**{split: [seven] * n for split, n in files.items()})
    assert {r["split"]: r["count"] for r in found.groupBy("split").count().collect()} == {split: 7 * n for split, n in files.items()}


def test_union_of_nothing():
    with pytest.raises(RuntimeError, match="no data provided"):
        corpora.union_corpus()


# 25 rows: 25 * 0.1 = 2.5 and 25 * 0.5 = 12.5 round to the even neighbour.
# 29 * (0.1 / 0.2) is 14.5 and 43 * (0.1 / 0.2) is 21.5: the quotient comes first.
CUTS = [(25, 0.05, 0.05, (1, 2)), (25, 0.25, 0.25, (6, 12)), (200, 0.1, 0.3, (60, 80)), (7, 0.0, 0.3, (2, 2)), (213, 0.1, 0.1, (22, 43))]


@pytest.mark.parametrize("n, dev, test, cuts", CUTS + [(n, 0.1, 0.1, (14, 29)) for n in range(143, 148)])
def test_cut_ranks(n, dev, test, cuts):
    assert corpus.cut_ranks(n, dev, test) == cuts


def test_split_is_exact_and_repeatable(spark):
    ids = spark.range(500)
    found = corpus.train_dev_test_split(ids, ["id"], 0.1, 0.3, seed=3)
    assert {r["split"]: r["count"] for r in found.groupBy("split").count().collect()} == {"train": 300, "dev": 50, "test": 150}
    again = corpus.train_dev_test_split(ids.repartition(3), ["id"], 0.1, 0.3, seed=3)
    assert sorted(found.collect()) == sorted(again.collect())
    other = corpus.train_dev_test_split(ids, ["id"], 0.1, 0.3, seed=4)
    assert sorted(found.collect()) != sorted(other.collect())


@pytest.mark.parametrize("n, dev, test", [(40, 0.7, 0.6), (2, 0.4, 0.4), (12, 0.3, 0.0)])
def test_impossible_splits(n, dev, test):
    with pytest.raises(ValueError, match="cannot be cut"):
        corpus.cut_ranks(n, dev, test)


def test_excluded_documents(spark, rows):
    docs = frame(
        spark,
        ("a", [(0, 1, "PROD")]),
        ("b", [(0, 0, "NOT_INCLUDED"), (0, 0, "NO_ANNOTATION")]),
        ("c", [(0, 0, "NO_ANNOTATION"), (0, 1, "PROD")]),
    )
    assert rows(corpus.drop_excluded(docs).select("text", F.size("spans"))) == [("a", 1), ("c", 0)]


def test_split_by_labels(spark, rows):
    docs = frame(spark, ("a", [(0, 1, "PROD"), (0, 1, "MONEY")]), ("b", [(0, 1, "PROD")]), ("c", []))
    both, others = corpus.split_by_labels(docs)
    assert rows(both.select("text")) == [("a",)] and rows(others.select("text")) == [("b",), ("c",)]


def test_prepare_iaa(spark, rows):
    docs = frame(
        spark,
        ("crit", [(0, 1, "CRIT"), (0, 1, "PROD")]),
        ("rel", [(0, 1, "PROD")], [(0, 1, 2, 3, "PROD_PRICE")]),
        ("none", [(0, 1, "PROD")]),
    )
    assert rows(corpus.prepare_iaa(docs).select("text", F.size("spans"), F.size("relations"))) == [("crit", 1, 0), ("rel", 1, None)]


def ranges(spark, text, spans):
    docs = frame(spark, (text, spans))
    found = alignment.span_tokens(docs, ["id"]).orderBy("pos").collect()
    return [(r["first"], r["last"], r["ok"]) for r in found]


@pytest.mark.parametrize(
    "text, span, expected",
    [
        ("Wo gibt es Schuhe", (11, 17), (3, 3, True)),
        ("Wo gibt es Schuhe?", (11, 17), (3, 3, True)),
        ("Wo gibt es Schuhe?", (11, 18), (3, 4, True)),
        ("Wo gibt es Schuhe?", (10, 18), (3, 4, True)),
        ("a-b c", (1, 2), (0, 1, True)),
        ("ab  cd ", (4, 7), (1, 1, True)),
        ("ab cd", (3, 3), (1, 1, True)),
        ("ab cd", (20, 22), (None, 1, False)),
    ],
)
def test_span_to_tokens(spark, text, span, expected):
    assert ranges(spark, text, [(*span, "PROD")]) == [expected]


def test_random_spans_equal_brute_force(spark):
    r = random.Random(11)
    texts = ["".join(r.choice("ab ,.x ") for _ in range(60)) + "e" for _ in range(6)]
    data = [(t, [(s := r.randrange(55), s + r.randrange(1, 9), "PROD") for _ in range(15)]) for t in texts]
    docs = frame(spark, *data)
    tokens = tokenize(docs, ["id"])
    by_doc = {}
    for t in tokens.orderBy("idx").collect():
        by_doc.setdefault(t["id"], []).append(t)
    for found in alignment.span_tokens(docs, ["id"]).collect():
        text, toks = texts[found["id"]], by_doc[found["id"]]
        start, end = found["start"], found["end"]
        while text[start:end].startswith(" "):
            start += 1
        while text[start:end].endswith(" "):
            end -= 1
        hit = lambda at: next((t["idx"] for t in toks if t["start"] <= at <= t["end"]), None)
        last = hit(end) if hit(end) is not None else toks[-1]["idx"]
        assert (found["first"], found["last"]) == (hit(start), last)
    for found in corpus.contract_to_tokens(docs, tokens, ["id"]).filter("aligned").collect():
        s, e, _ = data[found["id"]][1][found["pos"]]
        inside = [t["idx"] for t in by_doc[found["id"]] if t["start"] >= s and t["end"] <= e]
        if inside:
            assert (found["first"], found["last"]) == (inside[0], inside[-1])


def test_later_spans_overwrite_tags(spark):
    docs = frame(spark, ("a b c d", [(0, 5, "PROD"), (2, 7, "LOC")]))
    tokens = tokenize(docs, ["id"])
    tagged = alignment.bio_tags(docs, ["id"]).orderBy("idx")
    assert [r["tag"] for r in tagged.collect()] == ["B-PROD", "B-LOC", "I-LOC", "I-LOC"]
    sizes = corpus.corpus_sizes(docs.withColumn("split", F.lit("train")), tagged, ["id"])
    assert tuple(sizes.first()) == ("train", 1, 4, 4)


def test_contract_searches_nearby(spark, rows):
    docs = frame(spark, ("der Schuh und der Hut", [(0, 9, "PROD"), (5, 8, "PROD"), (20, 21, "PROD"), (9, 10, "PROD")]))
    found = corpus.contract_to_tokens(docs, tokenize(docs, ["id"]), ["id"])
    assert rows(found.select("pos", "first", "last", "aligned")) == [(0, 0, 1, True), (1, None, None, False), (2, None, None, False), (3, None, None, False)]
    shifted = frame(spark, ("x Hut Hut", [(3, 6, "PROD")]), ("ein huT", [(4, 7, "PROD")]))
    again = corpus.contract_to_tokens(shifted, tokenize(shifted, ["id"]), ["id"])
    assert rows(again.select("id", "first", "aligned")) == [(0, None, False), (1, 1, True)]


def test_spans_contract_inside_the_row(spark, rows):
    docs = frame(
        spark,
        ("der Schuh und der Hut", [(0, 9, "PROD"), (5, 8, "PROD"), (20, 21, "PROD"), (9, 10, "PROD"), (3, 3, "LOC"), (10, 90, "LOC")]),
        ("x Hut Hut", [(3, 6, "PROD"), (2, 9, "PROD")]),
        ("ein huT", [(4, 7, "PROD")]),
        ("äö üß  ÄÖ\n3,5 €x", [(a, b, "PER") for a in range(0, 14) for b in range(a, 16)]),
        ("", [(0, 2, "PROD")]),
    )
    found = alignment.contract_spans(docs, ["id"])
    assert rows(found) == rows(corpus.contract_to_tokens(docs, tokenize(docs, ["id"]), ["id"]))
    found.collect()
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_relations_without_a_span_are_reported(spark, rows):
    docs = frame(
        spark, ("Netflix fuer 5 Euro", [(0, 7, "PROD"), (13, 14, "MONEY")], [(13, 14, 0, 7, "PROD_PRICE"), (0, 7, 8, 12, "PROD_PRICE")])
    )
    found = alignment.resolve_relations(docs, ["id"])
    assert rows(found.select("rel_pos", "head_pos", "tail_pos")) == [(0, 1, 0), (1, 0, None)]


def test_line_highlights(spark, rows):
    messages = spark.createDataFrame([(1, "ab cd\n\nefg h")], "id long, text string")
    entities = spark.createDataFrame([(1, 3, 5, "A"), (1, 7, 12, "B"), (1, 8, 30, "C"), (1, 5, 6, "D")], "id long, start int, end int, label string")
    found = corpus.line_highlights(messages, entities, ["id"]).select("label", "line_no", "line_start", "line_end", "marked")
    assert rows(found) == [("A", 0, 3, 5, "cd"), ("B", 2, 0, 5, "efg h"), ("C", 2, 1, 5, "fg h")]


def test_sanitize(spark, rows):
    docs = frame(spark, ("a‍b‍", []), ("c️", []))
    assert rows(corpus.sanitize(docs).select("text")) == [("a b ",), ("c ",)]
    assert rows(corpus.sanitize_report(docs)) == [("‍", 2), ("️", 1)]


def test_statistics(spark, rows):
    docs = frame(spark, ("@max und tom", [(0, 4, "PER"), (9, 12, "PER")]), ("x y", [(0, 1, "PROD"), (2, 3, "PROD")]), ("z", []))
    assert rows(corpus.mention_share(docs)) == [(1, 2, 0.5)]
    assert rows(corpus.multi_product_docs(docs)) == [(1, 3)]
    assert rows(corpus.label_vocabulary(docs)) == [("PER", 2), ("PROD", 2)]
    assert rows(corpus.label_distribution(docs.withColumn("split", F.lit("dev")))) == [("dev", "PER", 2, 0.5), ("dev", "PROD", 2, 0.5)]


def test_item_ids(spark, rows):
    items = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos int, text string")
    labelled = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b")], "class string, text string")
    assert rows(corpus.attach_item_ids(labelled, items)) == [(0, "a", ["x"]), (0, "a", ["y"]), (1, "b", ["x"])]
    missing = spark.createDataFrame([("x", "q")], "class string, text string")
    assert corpus.unknown_items(missing, items).count() == 1
    with pytest.raises(PySparkException, match="not in the item list: q"):
        corpus.attach_item_ids(missing, items).collect()


def test_label_folder(spark, tmp_path, rows):
    (tmp_path / "social_media.txt").write_text(" views \nlikes\n")
    assert rows(corpora.read_label_folder(spark, str(tmp_path))) == [("Social Media", "likes"), ("Social Media", "views")]


def test_lines(spark, tmp_path, rows):
    docs = frame(spark, (" a \n\n b", []), ("c", []))
    corpora.write_lines(docs, str(tmp_path / "t"))
    assert rows(spark.read.text(str(tmp_path / "t"))) == [("a",), ("b",), ("c",)]
