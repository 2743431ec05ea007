import random

import pytest
from pyspark.sql import functions as F

from stallbook.operators import pairing, summaries

SCHEMA = "user string, chat_id string, message_id long, pos int, label string, text string, start int, end int"


def random_entities(seed, n=400, messages=12):
    r = random.Random(seed)
    out = []
    for i in range(n):
        label = r.choice(["PROD", "MONEY", "PROD", "CRIT"])
        start = r.randrange(0, 300)
        # One message holds a third of all entities.
        message = 0 if r.random() < 0.33 else r.randrange(messages)
        out.append(("u", "c", message, i, label, f"{label[0]}{r.randrange(20)}", start, start + r.randrange(1, 8)))
    return out


def nearest(prod, prices, limit, tie):
    best = None
    order = (lambda p: (p[6], p[3])) if tie == "text" else (lambda p: (p[3], p[6]))
    for p in sorted(prices, key=order):
        distance = abs(p[6] - prod[7])
        if (limit is None or distance < limit) and (best is None or distance < best[0]):
            best = (distance, p)
    return best and best[1]


@pytest.mark.parametrize("limit, tie", [(None, "text"), (40, "annotation"), (200, "annotation")])
def test_nearest_price_equals_brute_force(spark, limit, tie):
    data = random_entities(3)
    found = pairing.nearest_price(spark.createDataFrame(data, SCHEMA), limit, tie).collect()
    expected = {}
    for e in data:
        if e[4] == "PROD":
            price = nearest(e, [p for p in data if p[4] == "MONEY" and p[2] == e[2]], limit, tie)
            if price or limit is None:
                expected[e[3]] = (price[5], price[6], price[7]) if price else (None, None, None)
    assert {r["pos"]: (r["price_text"], r["price_start"], r["price_end"]) for r in found} == expected


def test_candidate_counts(spark, rows):
    data = [("u", "c", 1, i, label, "x", i, i + 1) for i, label in enumerate(["PROD", "PROD", "MONEY", "MONEY", "MONEY", "CRIT"])]
    assert rows(pairing.candidate_counts(spark.createDataFrame(data, SCHEMA))) == [("c", 1, "MONEY", "CRIT", 3), ("c", 1, "PROD", "MONEY", 6)]


def test_relations_match_as_multisets_in_both_directions(spark, rows):
    schema = "id long, start1 int, end1 int, start2 int, end2 int, label string"
    predicted = spark.createDataFrame([(1, 0, 4, 10, 12, "PROD_PRICE"), (1, 0, 4, 10, 12, "PROD_PRICE"), (1, 5, 6, 10, 12, "PROD_PRICE")], schema)
    gold = spark.createDataFrame(
        [(1, 10, 12, 0, 4, "PROD_PRICE"), (1, 20, 22, 0, 4, "PROD_PRICE"), (2, 0, 1, 2, 3, "PROD_PRICE"), (2, 0, 1, 2, 3, "PRICE_CRIT")], schema
    )
    matches = pairing.match_relations(predicted, gold, ["id"])
    assert rows(matches) == [(1, 1, 2, 1), (2, 0, 0, 1)]
    scores = pairing.nn_scores(matches).first()
    assert (scores["tp"], scores["fp"], scores["fn"]) == (1, 2, 2)
    assert scores["f_1"] == pytest.approx(1 / 3) and scores["precision"] == pytest.approx(1 / 3)


def test_scores_without_any_relation(spark):
    empty = spark.createDataFrame([], "id long, tp long, fp long, fn long")
    assert pairing.nn_scores(empty).select("f_1").first()[0] is None


def test_adjacent_candidates_take_both_sides(spark, rows):
    data = [("u", "c", 1, 0, "MONEY", "a", 0, 1), ("u", "c", 1, 1, "PROD", "p", 3, 5), ("u", "c", 1, 2, "MONEY", "b", 9, 10), ("u", "c", 1, 3, "MONEY", "c", 20, 21)]
    found = pairing.adjacent_candidates(spark.createDataFrame(data, SCHEMA))
    assert rows(found.select("is_after", F.col("price.text"))) == [(0, "a"), (1, "b")]


def test_a_task_sorts_a_bounded_number_of_entities(spark, monkeypatch, rows):
    data = [("u", "c", m, i, "PROD" if i % 2 else "MONEY", f"t{i}", 10 * i, 10 * i + 3) for m in range(40) for i in range(5)]
    entities = spark.createDataFrame(data, "user string, chat_id string, message_id long, pos int, label string, text string, start int, end int")
    few = rows(pairing.nearest_price(entities))
    monkeypatch.setattr(pairing, "TASK_ROWS", 10)
    dealt, tasks = pairing._dealt(entities, "PROD", "MONEY")
    assert tasks == 20 and pairing._nearest_positions(dealt, tasks, pairing.MESSAGE_KEY).rdd.getNumPartitions() == 20
    assert rows(pairing.nearest_price(entities)) == few and len(few) == 80


def test_nearest_price_moves_the_rows_once(spark):
    data = [*random_entities(5), ("u", None, 1, 1, "PROD", "P", 0, 3), ("u", None, 1, 2, "MONEY", "M", 5, 6)]
    found = pairing.nearest_price(spark.createDataFrame(data, SCHEMA))
    assert found.filter("chat_id IS NULL").first()["price_text"] is None  # rows without a message have no neighbours
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_product_summary_counts_distinct_prices_and_messages(spark, rows):
    r = random.Random(8)
    data = [(r.choice(["u", "v", None]), "c", r.choice([1, 2, 3, None]), r.choice(["Ring", "ring", "Hat"]), r.randrange(5), r.choice(["1", "2", None])) for _ in range(60)]
    mentions = spark.createDataFrame(data, "user string, chat_id string, message_id long, text string, start int, price_text string")
    order = lambda x: (x[2] is not None, x[2] or 0, x[4], x[3])
    expected = []
    for user, product in {(d[0], d[3].lower()) for d in data}:
        of = [d for d in data if (d[0], d[3].lower()) == (user, product)]
        expected.append((user, product, min(of, key=order)[3], len({d[5] for d in of} - {None}), len({d[2] for d in of} - {None})))
    found = summaries.product_summary(mentions)
    assert rows(found) == sorted(expected, key=repr)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Expand" not in plan
