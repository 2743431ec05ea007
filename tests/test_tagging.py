import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallbook.catalog import inputs
from stallbook.operators import alignment, evaluation, pairing, tag_counts, tagging, token_trie
from stallbook.sources import corpora

PATTERNS = "label string, tokens array<string>"


def variants(tokens):
    """All phrases a pattern stands for: two fixed tokens, every later one optional."""
    out = [tuple(tokens[:2])]
    for t in tokens[2:]:
        out += [v + (t,) for v in out]
    return set(out)


def brute_matches(words, patterns):
    return {
        (i, len(v), label)
        for label, tokens in patterns
        for v in variants(tokens)
        for i in range(len(words) - len(v) + 1)
        if tuple(words[i : i + len(v)]) == v
    }


def brute_tags(matches):
    used, kept = set(), []
    for i, n, label in sorted(matches, key=lambda m: (-m[1], m[0], m[2])):
        if not used & set(range(i, i + n)):
            used |= set(range(i, i + n))
            kept.append((i, i + n - 1, label))
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_and_tags_equal_brute_force(spark, rows, seed):
    r = random.Random(seed)
    patterns = list({(r.choice(["PROD", "LOC"]), tuple(r.choice("abc") for _ in range(r.choice([1, 2, 3, 4, 5])))) for _ in range(12)})
    texts = [" ".join(r.choice("abcd") for _ in range(40)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(label, list(tokens)) for label, tokens in patterns], PATTERNS)
    found = rows(tagging.pattern_matches(docs, table, ["id"]).select("id", "first", "n", "label"))
    expected = {(d, *m) for d, t in enumerate(texts) for m in brute_matches(t.split(), patterns)}
    assert set(found) == expected and len(found) == len(expected)
    tags = rows(tagging.tag_entities(docs, table, ["id"]).select("id", "first", "last", "label"))
    wanted = [(d, *m) for d, t in enumerate(texts) for m in brute_tags(brute_matches(t.split(), patterns))]
    assert tags == sorted(wanted, key=repr)
    whole = rows(tagging.dictionary_match(docs, table, ["id"]).select("id", "first", "last", "label"))
    assert set(whole) == {(d, i, i + n - 1, label) for d, t in enumerate(texts) for label, p in patterns for i in range(41 - len(p)) for n in [len(p)] if tuple(t.split()[i : i + n]) == p}


def test_numbers_only_outside_entities(spark, rows):
    docs = spark.createDataFrame([(1, "Air Max 90 fuer 80,50 oder zehn")], "id int, text string")
    table = spark.createDataFrame([("PROD", ["air", "max", "90"])], PATTERNS)
    found = tagging.tag_entities(docs, table, ["id"]).select("label", "text", "start", "end")
    assert rows(found) == [("MONEY", "80,50", 16, 21), ("MONEY", "zehn", 27, 31), ("PROD", "Air Max 90", 0, 10)]


def test_patterns_round_trip(spark, tmp_path, rows):
    docs = spark.createDataFrame(
        [("Air Max 90 in Bonn", [(0, 10, "PROD"), (14, 18, "LOC"), (0, 3, "MONEY")]), ("air max 90", [(0, 10, "PROD")])],
        "text string, spans array<struct<start: int, end: int, label: string>>",
    )
    patterns = tagging.build_patterns(docs)
    assert rows(patterns) == [("LOC", ["bonn"]), ("PROD", ["air", "max", "90"])]
    assert rows(tagging.pattern_rows(patterns).filter("label = 'PROD'").select("idx", "lower", "op")) == [(0, "air", None), (1, "max", None), (2, "90", "?")]
    corpora.write_patterns(patterns, str(tmp_path / "p"))
    assert rows(corpora.read_patterns(spark, str(tmp_path / "p"))) == rows(patterns)


def test_annotator_runs_once_per_partition(spark, rows):
    messages = spark.createDataFrame([(1, "2 Stück für zehn"), (2, "nichts")], "id long, text string")
    found = tagging.annotate(messages, tagging.number_annotator, ["id"])
    assert rows(found) == [(1, 0, "MONEY", "2", 0, 1), (1, 1, "MONEY", "zehn", 12, 16)]


def test_reports(spark):
    schema = "id long, first int, last int, label string"
    gold = spark.createDataFrame([(1, 0, 0, "A"), (1, 1, 2, "A"), (2, 0, 0, "B")], schema)
    predicted = spark.createDataFrame([(1, 0, 0, "A"), (1, 1, 1, "A"), (2, 0, 0, "A")], schema)
    report = {r["label"]: r for r in evaluation.classification_report(predicted, gold, ["id", "first", "last"]).collect()}
    assert report["A"]["precision"] == pytest.approx(1 / 3) and report["A"]["recall"] == 0.5 and report["A"]["support"] == 2
    assert report["B"]["f1"] == 0.0 and report["micro avg"]["f1"] == pytest.approx(1 / 3)
    assert report["macro avg"]["recall"] == 0.25 and report["weighted avg"]["recall"] == pytest.approx(1 / 3)
    aligned = gold.withColumn("aligned", F.col("first") == 0)
    scores = evaluation.rule_scores(predicted, gold, ["id", "first", "last"], aligned)
    assert scores.select("misaligned").distinct().first()[0] == pytest.approx(1 / 3)


def test_annotate_skips_null_and_blank_messages(spark):
    messages = spark.createDataFrame([(1, "zwei 3,5"), (2, None), (3, " \n")], "id long, text string")
    found = tagging.annotate(messages, tagging.number_annotator, ["id"]).select("id", "text").collect()
    assert [tuple(r) for r in found] == [(1, "zwei"), (1, "3,5")]


@pytest.mark.parametrize("limit", [4, 1 << 20])
def test_matches_of_a_frequent_first_word_in_several_tries(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(token_trie, "TRIE_TOKENS", limit)
    phrases = [("PROD", ["a", x, y]) for x in "ab" for y in "abc"] + [("LOC", ["a"]), ("PROD", ["b", "a", "a", "b", "c", "a"])]
    text = "a a b c a b a b c a a a b d a b"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "d d")], "id int, text string")
    table = spark.createDataFrame([(label, tokens) for label, tokens in phrases] + [("PER", [])], PATTERNS)
    found = rows(tagging.pattern_matches(docs, table, ["id"]).select("first", "n", "label"))
    assert found == sorted(brute_matches(text.split(), phrases), key=repr)
    tags = rows(tagging.tag_entities(docs, table, ["id"]).select("first", "last", "label"))
    assert tags == sorted(brute_tags(brute_matches(text.split(), phrases)), key=repr)


def test_no_patterns_leave_numbers(spark, rows):
    docs = spark.createDataFrame([(1, "zehn x 5")], "id int, text string")
    table = spark.createDataFrame([], PATTERNS)
    assert rows(tagging.tag_entities(docs, table, ["id"]).select("label", "text")) == [("MONEY", "5"), ("MONEY", "zehn")]
    assert tagging.dictionary_match(docs, table, ["id"]).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_longest_first_equals_taking_one_at_a_time(seed):
    r = np.random.default_rng(seed)
    m = int(r.integers(0, 60))
    first, n, order = r.integers(5, 40, m), r.integers(1, 7, m), r.permutation(m)
    used, expected = set(), np.zeros(m, bool)
    for i in sorted(range(m), key=lambda i: (-n[i], first[i], order[i])):
        place = set(range(first[i], first[i] + n[i]))
        if not place & used:
            used |= place
            expected[i] = True
    assert token_trie.longest_first(first, n, order).tolist() == expected.tolist()


def test_between_features_equal_a_scan(spark, rows):
    r = random.Random(11)
    spots = [(m, s, s + r.randrange(1, 9)) for m in range(4) for s in sorted(r.sample(range(120), 25))]
    breaks = [(m, at) for m in range(3) for at in sorted(r.sample(range(130), 6))]
    chosen = [(i, *r.choice(spots)[1:], *r.choice(spots)[1:]) for i in range(4) for _ in range(40)]
    entities = spark.createDataFrame(spots + spots[:5], "m int, start int, end int")
    pairs = spark.createDataFrame([(m, a, b, (c, d)) for m, a, b, c, d in set(chosen)], "m int, start int, end int, price struct<start: int, end: int>")
    found = evaluation.between_features(pairs, entities, spark.createDataFrame(breaks, "m int, at int"), ["m"])
    expected = []
    for m, a, b, c, d in set(chosen):
        low, high = (b, c) if b <= c else (d, a)
        n = sum(m == x and low <= s < high for x, s, _ in spots + spots[:5])
        expected.append((m, a, b, c, float(n), float(not any(m == x and low <= at < high for x, at in breaks))))
    assert rows(found.select("m", "start", "end", "price.start", "entities_between", "same_line")) == sorted(expected, key=repr)


def test_no_pair_is_scored_by_a_model_that_saw_it(spark):
    r = random.Random(12)
    data = [("c", m, i, float(r.random()), float(m % 2)) for m in range(60) for i in range(3)]
    # Outside its own message, a feature says nothing about the label: only a model that saw the pair could score it well.
    pairs = spark.createDataFrame(data, "chat_id string, message_id long, i int, distance double, related double")
    zero = {name: F.lit(0.0) for name in evaluation.PAIR_FEATURES if name != "distance"}
    scored = evaluation.score_relations(pairs.withColumns(zero), folds=4).select("message_id", "i", "fold", "probability").collect()
    assert len(scored) == len(data) and len({(x["message_id"], x["i"]) for x in scored}) == len(data)
    assert all(len({x["fold"] for x in scored if x["message_id"] == m}) == 1 for m in range(60)) and {x["fold"] for x in scored} == {0, 1, 2, 3}
    assert all(0 < x["probability"] < 1 for x in scored)


def test_many_matches_of_a_text_in_several_tries(spark, monkeypatch):
    words = ["a", "b", "c", "d"]
    text = " ".join(words[i % 4] for i in range(60_000))
    phrases = [("PROD", [words[(i + k) % 4] for k in range(3)]) for i in range(4)] + [("LOC", ["a", "b", "d"]), ("LOC", ["a", "b", "c", "d"])]
    docs, patterns = spark.createDataFrame([(1, text), (2, None), (3, "a b")], "id long, text string"), spark.createDataFrame(phrases, "label string, tokens array<string>")
    expected = tagging.pattern_matches(docs, patterns, ["id"]).groupBy("id", "n", "label").count().collect()
    monkeypatch.setattr(token_trie, "TRIE_TOKENS", 4)
    started = time.monotonic()
    found = tagging.pattern_matches(docs, patterns, ["id"])
    assert sorted(found.groupBy("id", "n", "label").count().collect()) == sorted(expected)
    assert time.monotonic() - started < 30  # work in proportion to the matches of a row, not to their square


def test_pairs_of_all_kinds_come_from_one_shuffle(spark, rows):
    rng = random.Random(5)
    data, gold = [], []
    for m in range(40):
        for _ in range(rng.randrange(0, 14)):
            label, start = rng.choice(["PROD", "MONEY", "CRIT", "LOC"]), rng.randrange(0, 30)
            data += [("c", m, rng.randrange(100), label, rng.choice("xyz") * rng.randrange(1, 6), start, start + rng.randrange(1, 6))] * rng.choice([1, 1, 2])
        for label, head, tail in (("PROD_PRICE", "PROD", "MONEY"), ("PRICE_CRIT", "MONEY", "CRIT")):
            ends = lambda kind: [r for r in data if r[1] == m and r[3] == kind]  # noqa: B023, E731
            gold += [("c", m, (a[4], a[5], a[6]), (b[4], b[5], b[6]), label) for a in ends(head) for b in ends(tail) if rng.random() < 0.3]
    entities = spark.createDataFrame(data, "chat_id string, message_id int, pos int, label string, text string, start int, end int")
    end = "struct<text: string, start: int, end: int>"
    relations = spark.createDataFrame(gold, f"chat_id string, message_id int, head {end}, tail {end}, label string")
    breaks = spark.createDataFrame([("c", m, at) for m in range(40) for at in (7, 15, 16)], "chat_id string, message_id int, at int")
    kinds = (("PROD", "MONEY", "PROD_PRICE"), ("MONEY", "CRIT", "PRICE_CRIT"))
    shown = ["chat_id", "message_id", "start", "end", "text", "price", *evaluation.PAIR_FEATURES, "price_start", "related"]
    found = evaluation.related_pairs(entities, relations, breaks, kinds)
    for head, tail, label in kinds:
        pairs = evaluation.between_features(evaluation.pair_features(pairing.adjacent_candidates(entities, pair=(head, tail))), entities, breaks)
        expected = evaluation.label_pairs(pairs, relations.filter(F.col("label") == label)).select(shown)
        assert rows(found.filter(F.col("label") == label).select(shown)) == rows(expected)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("+- Exchange ") == 1


@pytest.mark.parametrize("entities", [False, True])
@pytest.mark.parametrize("contract", [False, True])
def test_counts_inside_the_texts_equal_a_join_of_all_matches(spark, rows, monkeypatch, contract, entities):
    monkeypatch.setattr(token_trie, "TRIE_TOKENS", 4)
    monkeypatch.setattr(token_trie, "GROUP_TOKENS", 9)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["red", "ring", "Bonn", "zehn", "a"]) for _ in range(rng.randrange(0, 12))) for _ in range(12)]
    data = [(i % 9 if i < 11 else None, t or None, [(s, s + rng.randrange(2, 9), rng.choice(["PROD", "LOC", "MONEY"])) for s in range(0, len(t), 5)]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "id long, text string, spans array<struct<start: int, end: int, label: string>>")
    table = spark.createDataFrame([("PROD", ["red", "ring", "a"]), ("PROD", ["ring"]), ("LOC", ["bonn"]), ("LOC", ["a", "bonn"]), ("PROD", ["bonn"])], PATTERNS)
    counts, misaligned = tag_counts.tag_counts(docs, table, ["id"], contract, entities)
    found = tagging.tag_entities(docs, table, ["id"]) if entities else tagging.dictionary_match(docs, table, ["id"])
    gold = (alignment.contract_spans(docs, ["id"]) if contract else alignment.span_tokens(docs, ["id"])).withColumn("fits", F.col("aligned" if contract else "ok"))
    assert rows(counts) == rows(evaluation.label_counts(found, gold.filter("fits"), ["id", "first", "last"]))
    assert misaligned.first()[0] == pytest.approx(gold.filter("NOT fits").count() / gold.count())


def test_one_map_stage_holds_all_tries(spark, monkeypatch):
    monkeypatch.setattr(token_trie, "TRIE_TOKENS", 2)
    docs = spark.createDataFrame([(1, "red ring a b c")], "id long, text string")
    table = spark.createDataFrame([("PROD", [x]) for x in "abcdefgh"], PATTERNS)
    for found, n in ((tagging.dictionary_match(docs, table, ["id"]), 3), (tagging.tag_entities(docs, table, ["id"]), 3)):
        assert found.count() == n
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_words_of_one_hash_stay_apart(spark, rows, monkeypatch):
    monkeypatch.setattr(token_trie, "word_hashes", lambda words: np.full(len(words), 7, np.uint64))
    phrases = pa.table({"label": ["PROD", "LOC"], "tokens": [["a", "b"], ["c"]]})
    trie = token_trie.build_trie(phrases, True)
    words = pa.array(["c", "x", "b", "a"])
    ids = trie.numbers(words, token_trie.word_hashes(words))
    assert trie.twins == 3 and ids[1] == -1 and trie.words.take(pa.array(ids[[0, 2, 3]])).to_pylist() == ["c", "b", "a"]


def test_pairs_of_lines_equal_pairs_of_their_entities_and_move_less(spark, rows):
    rng = random.Random(7)
    some = lambda *given: rng.choice([*given, None])
    names = ["prod", "money", "crit", "loc", "per", "paym"]
    data = [("c", m, n, *[x for name in names for x in ("Ring" if name == "prod" else some("a", "bcd"), rng.randrange(40))]) for m in range(8) for n in range(rng.randrange(1, 6))]
    lines = spark.createDataFrame(data, "chat_id string, message_id long, line_no int, " + ", ".join(f"{c} string, {c}_at int" for c in names)).withColumn("author", F.lit("u"))
    breaks = lines.select("chat_id", "message_id").distinct().withColumn("at", F.array(F.lit(10), F.lit(30)))
    kinds = (("PROD", "MONEY", "PROD_PRICE"), ("MONEY", "CRIT", "PRICE_CRIT"))
    expected = evaluation.related_pairs(inputs.entities(spark, "", lines), inputs.relations(spark, "", lines), breaks.withColumn("at", F.explode("at")), kinds)
    marks = F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda x: evaluation.item(kind=F.lit(1), start=x))
    items = F.concat(inputs.line_entities(evaluation.item), inputs.line_relations(evaluation.item), marks)
    found = evaluation.pairs_of_items(lines.drop("author").unionByName(breaks, allowMissingColumns=True), items, 50, kinds)
    assert rows(found) == rows(expected) and found.count() > 20
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.index("Generate inline") < plan.rindex("Exchange")  # the items are made behind the shuffle
