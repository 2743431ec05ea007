import numpy as np
import pytest
from pyspark.sql import functions as F

from stallbook.functions import ranks
from stallbook.functions.ranks import exact_quantiles
from stallbook.operators import offers

CANDIDATES = "user string, chat_id string, message_id long, product string, price string, crit string"


@pytest.fixture
def table(spark):
    data = [
        ("u", "c", 1, "Netflix Account", "24€", "1 jahr"),
        ("u", "c", 1, "whisky", "10,5", None),
        ("u", "c", 2, "NordVPN + Netflix", "5", "lifetime"),
        ("u", "c", 3, "Sky", "20 - 30€", "3 monate"),
        ("u", "c", 4, "Sky", "20", "jährlich"),
        ("u", "c", 5, "Sky", "20", "0 monate"),
        ("u", "c", 6, "Radio", "20", None),
    ]
    return offers.normalize_offers(spark.createDataFrame(data, CANDIDATES))


def test_offers(table, rows):
    found = table.select("message_id", "type", "price", "crit_kind", "crit_months", "price_per_month", "is_normalized", "is_priced")
    assert rows(found) == [
        (1, "Netflix", 24.0, "months", 12, 2.0, True, True),
        (1, "Sky", 10.5, "none", None, None, False, True),
        (2, "Netflix", 5.0, "lifetime", None, None, False, True),
        (2, "NordVPN", 5.0, "lifetime", None, None, False, True),
        (3, "Sky", -1.0, "months", 3, pytest.approx(-1 / 3), True, False),
        (5, "Sky", 20.0, "months", 0, None, True, True),
    ]


def test_offer_candidates(spark, rows):
    point = "struct<text: string, start: int, end: int>"
    data = [
        ("u", "c", 1, ("p", 0, 1), ("5", 2, 3), "PROD_PRICE"),
        ("u", "c", 1, ("q", 4, 5), ("5", 6, 7), "PROD_PRICE"),
        ("u", "c", 1, ("5", 2, 3), ("1 jahr", 8, 9), "PRICE_CRIT"),
        ("u", "c", 1, ("5", 2, 3), ("lifetime", 10, 11), "PRICE_CRIT"),
        ("v", "c", 1, ("5", 6, 7), ("2 jahre", 8, 9), "PRICE_CRIT"),
    ]
    relations = spark.createDataFrame(data, f"user string, chat_id string, message_id long, head {point}, tail {point}, label string")
    found = offers.offer_candidates(relations).select("product", "price", "crit")
    assert rows(found) == [("p", "5", "1 jahr"), ("p", "5", "lifetime"), ("q", "5", None)]


def test_histogram_shares(table, rows):
    found = offers.subscription_histogram(table, ["Netflix", "Sky"])
    assert rows(found) == [("Netflix", "12", 1, 0.5), ("Netflix", "lifetime", 1, 0.5), ("Sky", "unknown", 1, 1.0)]


def test_price_ranges(spark, rows):
    data = [("Uhren!", f"{i}€") for i in range(16)] + [("Views", "5")] * 15 + [("uhren", "VB"), ("UHREN", "5000")]
    found = offers.product_price_ranges(spark.createDataFrame(data, "product string, price_text string"))
    assert rows(found.agg(F.min("product"), F.sum("n"), F.max("price"), F.max("n_prices"))) == [("uhren", 16, 15.0, 17)]


@pytest.mark.parametrize("accuracy", [4, 50, 10_000])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = np.random.default_rng(5)
    # Half of the values are one and the same, and some are negative.
    data = [("a", float(v)) for v in rng.normal(3, 20, 301).round(2)] + [("a", 7.0)] * 300 + [("b", 1.5), (None, 1.0), (None, 2.0), ("c", None)]
    data += [(f"s{n}", float(v)) for n in range(2, 14) for v in rng.random(n)]
    df = spark.createDataFrame(data, "g string, x double")
    q = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "x", q).collect()}
    assert set(found) == {g for g, v in data if v is not None}
    for group, shown in found.items():
        assert shown == pytest.approx(list(np.quantile([v for g, v in data if g == group and v is not None], q)))


def test_quantiles_of_many_distinct_ratios(spark):
    values = spark.range(1_000_000).select((F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 1_000_003).alias("x"))
    x = np.sort((np.arange(1_000_000) * 7919 % 1_000_003) / 1_000_003)
    q = [0.0, 0.25, 0.5, 0.999, 1.0]
    row = exact_quantiles(values, [], "x", q).first()
    assert row["n"] == 1_000_000 and row["q"] == pytest.approx(list(np.quantile(x, q)), abs=1e-12)


def test_price_trend(spark):
    data = [("Sky", "months", m, 10.0 - 2.0 * np.log10(m)) for m in (1, 12, 24)] + [("Sky", "months", 60, 1.0), ("Sky", "none", None, None)]
    df = spark.createDataFrame([(a, b, c, float(d) if d is not None else None) for a, b, c, d in data], "type string, crit_kind string, crit_months long, price_per_month double")
    fit = offers.price_trend(df).first()
    assert (fit["n"], round(fit["slope"], 6), round(fit["intercept"], 6), round(fit["r2"], 6)) == (3, -2.0, 10.0, 1.0)
