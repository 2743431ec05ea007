import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallbook.functions import text


def value(spark, column, **inputs):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()] or [F.lit(1)])
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, price",
    [("30€", 30.0), ("1.234,56 €", -1.0), ("5.", 5.0), ("20 - 30€", -1.0), ("VB", -1.0), ("10,5", 10.5), ("", -1.0), (" 7 ", 7.0)],
)
def test_price(spark, raw, price):
    assert value(spark, text.normalize_price(F.lit(raw))) == price


@pytest.mark.parametrize(
    "raw, kind, months",
    [
        ("1 jahr", "months", 12),
        ("2 Jahre", "months", 24),
        ("eins jahr", "months", 1),
        ("30 tage", "months", 30),
        ("keine", "months", 1),
        ("24 monate", "months", 24),
        ("zwölf Monate", "months", 12),
        ("lifetime", "lifetime", None),
        ("jährlich", None, None),
        ("pro jahr", "months", 12),
        ("pro Monat", "months", 1),
        ("0 monate", "months", 0),
        ("dauerhaft", None, None),
    ],
)
def test_subscription_length(spark, raw, kind, months):
    found = value(spark, text.subscription_length(F.lit(raw)))
    assert (found["kind"], found["months"]) == (kind, months)


@pytest.mark.parametrize("raw, clean", [("Nord  VPN", "nord vpn"), (" T-Shirts 2 ", "tshirts"), ("Ölbild", "lbild")])
def test_product_name(spark, raw, clean):
    assert value(spark, text.normalize_product_name(F.lit(raw))) == clean


def test_product_key(spark):
    assert value(spark, text.normalize_product_key(F.lit(" Air-Max  90! "))) == "air max 90"


@pytest.mark.parametrize("raw, number", [("ein", 1), ("funf", 5), ("zwölf", 12), ("36", 36), ("viele", 1)])
def test_number_word(spark, raw, number):
    assert value(spark, text.number_word(F.lit(raw))) == number


@pytest.mark.parametrize("raw, visible", [("", False), (None, False), (" \t\n", False), ("  ", False), (" a ", True)])
def test_blank(spark, raw, visible):
    assert value(spark, text.is_not_blank(F.lit(raw).cast("string"))) is visible


def test_strip(spark):
    assert value(spark, text.strip(F.lit(" \n a b \t"))) == "a b"


def test_nonprint(spark):
    raw = "ok‍️→😀é\u0000x́"
    assert value(spark, text.replace_nonprint(F.lit(raw))) == "ok  →😀é x "
    assert value(spark, text.nonprint_chars(F.lit(raw))) == ["‍", "️", "\u0000", "́"]


@pytest.mark.parametrize("token, like", [("12", True), ("1.234,5", True), ("3/4", True), ("+5", True), ("zehn", True), ("a1", False), (".", False), ("1/2/3", False)])
def test_number_like(spark, token, like):
    assert value(spark, text.is_number_like(F.lit(token))) is like


def test_tokens_keep_their_places(spark):
    raw = "  Air-Max 1.50€, neu 😀!\nEnde "
    docs = spark.createDataFrame([(1, raw), (2, ""), (3, " \n")], "id long, text string")
    found = text.tokenize(docs, ["id"]).orderBy("id", "idx").collect()
    assert [r["token"] for r in found] == ["Air", "-", "Max", "1.50", "€", ",", "neu", "😀", "!", "Ende"]
    assert all(raw[r["start"] : r["end"]] == r["token"] for r in found)
    assert [r["idx"] for r in found] == list(range(10))


def test_numbers_are_not_java_literals(spark):
    from stallbook.functions.text import is_float

    given = {"1": True, "-2.5": True, ".5": True, "3.": True, "1e3": True, "1d": False, "1f": False, "2.0D": False, "": False, "x": False, "1,5": False}
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert {r["t"]: r["f"] for r in df.select("t", is_float(F.col("t")).alias("f")).collect()} == given


def test_texts_cross_in_bounded_batches(spark):
    docs = spark.range(4000).select("id", F.repeat(F.lit("word "), 2000).alias("text")).coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    found = [r["n"] for r in text.spread(docs).mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 4000 * 10000 and max(found) < 2 * text.BATCH_BYTES
