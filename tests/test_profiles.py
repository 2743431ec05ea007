import io
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stallbook.operators import activity, messages, summaries
from stallbook.plans import jobs
from stallbook.sources import chats, export_ranges, profiles

USER = "struct<id: string, first_name: string, last_name: string, username: string, phone: string>"
ANNOTATED = f"""chat_id string, message_id long, user {USER}, ts timestamp, ts_local timestamp_ntz, text string,
    spans array<struct<start: int, end: int, label: string>>,
    relations array<struct<start1: int, end1: int, start2: int, end2: int, label: string>>"""


def user(i, name=None):
    return (str(i), None, None, name, None)


@pytest.fixture
def annotated(spark):
    from datetime import datetime

    t = lambda m: datetime(2024, 1, 1, 10, m)
    data = [
        ("c", 1, user(1), t(0), "Netflix 5€ oder netflix 7€", [(0, 7, "PROD"), (8, 10, "MONEY"), (16, 23, "PROD"), (24, 26, "MONEY")], [(0, 7, 8, 10, "PROD_PRICE")]),
        ("c", 2, user(1), t(0), "Sky in Köln, Köln", [(0, 3, "PROD"), (7, 11, "LOC"), (13, 17, "LOC")], []),
        ("c", 3, user(1, "neu"), t(1), "hallo @max", [(6, 10, "PER")], []),
        ("c", 4, user(2), t(2), " \n", [], []),
        ("c", 5, user(2), t(3), None, [], []),
    ]
    return spark.createDataFrame([(*row[:3], row[3], *row[3:]) for row in data], ANNOTATED)


def test_summary_per_full_user(annotated):
    found = {(r["user"]["id"], r["user"]["username"]): r for r in jobs.extract_profiles(annotated)["summary"].collect()}
    assert set(found) == {("1", None), ("1", "neu"), ("2", None)}
    first = found[("1", None)]
    assert (first["n_products"], first["n_prices"], first["n_product_messages"]) == (2, 2, 2)
    assert (first["n_locations"], first["n_post_times"]) == (2, 1)
    assert found[("1", "neu")]["n_persons"] == 1
    assert all(v == 0 for k, v in found[("2", None)].asDict().items() if k != "user")


def test_product_summary_shows_first_spelling(annotated, rows):
    tables = jobs.extract_profiles(annotated)
    found = summaries.product_summary(tables["products"]).select("product_key", "product", "n_prices", "n_messages")
    assert rows(found) == [("netflix", "Netflix", 2, 1), ("sky", "Sky", 0, 1)]
    assert rows(summaries.product_prices(tables["products"]).select("product_key", "price_text")) == [("netflix", "5€"), ("netflix", "7€")]


def test_mentions_keep_repeats(annotated, rows):
    entities = jobs.extract_profiles(annotated)["entities"]
    assert rows(summaries.mention_map(entities, "LOC").select("text", "message_id", "n")) == [("Köln", 2, 2)]
    assert rows(summaries.mention_counts(entities, "LOC").select("text", "n_mentions")) == [("Köln", 2)]


def test_relations_have_texts(annotated, rows):
    found = jobs.extract_profiles(annotated)["relations"].select("head.text", "tail.text", "label")
    assert rows(found) == [("Netflix", "5€", "PROD_PRICE")]


def test_profile_lookup(annotated):
    users = messages.messages_per_user(annotated)
    assert messages.profile_for(users, user_id="1").first()["n_messages"] == 2
    assert messages.profile_for(users, user_id="9").count() == 0
    whole = F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("id", "first_name", "last_name", "username", "phone"), user(1, "neu"))])
    assert messages.profile_for(users, user=whole).first()["n_messages"] == 1


def test_large_profiles_are_stored_in_parts(spark, annotated, tmp_path, rows):
    components = jobs.profile_components(jobs.extract_profiles(annotated))
    nested = profiles.nest_profiles(components, messages.users_of(annotated), rows_per_part=2)
    assert nested.filter("user.id = '1' AND user.username IS NULL").count() > 1
    # The lookup returns every part of the first user with that id, and nothing of the renamed one.
    whole = components.filter("user.id = '1' AND user.username IS NULL").count()
    assert profiles.components_in(messages.profile_for(nested, user_id="1")).count() == whole
    profiles.write_profiles(nested, str(tmp_path / "p"))
    back = profiles.components_in(profiles.read_profiles(spark, str(tmp_path / "p")))
    assert rows(back) == rows(components.select(back.columns))
    assert rows(jobs.relations_of(back).select("head.text", "tail.text", "label")) == [("Netflix", "5€", "PROD_PRICE")]
    assert sorted(r["n_products"] for r in jobs.summaries_of(back).collect()) == [0, 0, 2]


def export(n_declared, texts, offset="+0200"):
    return {
        "info": {"date": "2024-01-01T00:00:00+0000", "message_count": n_declared, "message_count_limit": 10, "source": "s"},
        "messages": [
            {"id": i, "user": {"id": "7"}, "datetime": f"2024-01-01T23:30:00{offset}", "message": t, "reply_to": None, "type": ["text"]}
            for i, t in enumerate(texts)
        ],
    }


def test_chat_file(spark, tmp_path):
    (tmp_path / "market.json").write_text(json.dumps(export(2, ["a", None]), indent=2))
    found = chats.read_chat(spark, str(tmp_path)).orderBy("message_id").collect()
    assert [r["text"] for r in found] == ["a", None] and found[0]["chat_id"] == "market.json"
    assert found[0]["ts_local"].hour == 23 and found[0]["user"]["id"] == "7"
    assert chats.read_chat(spark, str(tmp_path)).select(F.hour("ts")).first()[0] == 21


def test_two_exports_of_one_file_are_two_chats(spark, tmp_path):
    (tmp_path / "two.jsonl").write_text("\n".join(json.dumps(export(1, [t])) for t in ("a", "b")))
    found = chats.read_chat(spark, str(tmp_path), multi_line=False).collect()
    assert {r["text"] for r in found} == {"a", "b"} and len({r["chat_id"] for r in found}) == 2
    assert all(r["chat_id"].startswith("two.jsonl#") for r in found)


@pytest.mark.parametrize("offset, hour", [("+02:00", 21), ("+0200", 21), ("+02", 21), ("Z", 23), ("", 23), (".250+02:00", 21), ("-0130", 25)])
def test_iso_stamps(spark, tmp_path, offset, hour):
    (tmp_path / "a.json").write_text(json.dumps(export(1, ["a"], offset)))
    found = chats.read_chat(spark, str(tmp_path)).select(F.hour("ts"), F.hour("ts_local")).first()
    assert tuple(found) == (hour % 24, 23)


def test_unreadable_stamp_names_the_message(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(export(1, ["a"], " tomorrow")))
    with pytest.raises(PySparkException, match="in message 0"):
        chats.read_chat(spark, str(tmp_path)).collect()


def test_post_times_are_instants(spark, annotated):
    twice = annotated.filter("message_id = 1")
    later = twice.withColumn("ts", F.expr("ts + INTERVAL '1' HOUR"))
    assert summaries.post_times(twice.unionByName(later)).count() == 2
    assert summaries.post_times(twice.unionByName(twice)).count() == 1


def test_wrong_message_count(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(export(3, ["a"])))
    exports = chats.read_exports(spark, str(tmp_path))
    assert [tuple(r) for r in chats.count_violations(exports).collect()] == [("a.json", 3, 1)]
    with pytest.raises(PySparkException, match="3 but found 1"):
        chats.read_chat(spark, str(tmp_path)).collect()


TRICKY = ['{"id": 1, "user"', '\\"}, {"id":5', "}]", "äöü€ 😀 {", '", "info": {"message_count": 9}', None, "", "[{", '\\', ':"x"', "{" * 30 + "}"]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [1, 7, 64, 333, 10**6])
def test_ranges_of_any_size_find_every_object_once(indent, size, monkeypatch):
    monkeypatch.setattr(export_ranges, "BLOCK_BYTES", 16 if size < 100 else 1 << 20)
    for ascii_only in (True, False):
        whole = export(len(TRICKY), TRICKY)
        raw = json.dumps(whole, indent=indent, ensure_ascii=ascii_only).encode()
        found = [x for at in range(0, len(raw), size) for x in export_ranges.objects_of(io.BytesIO(raw), at, min(at + size, len(raw)))]
        assert [json.loads(body) for _, kind, body in found if kind == "message"] == whole["messages"]
        assert [json.loads(body) for _, kind, body in found if kind == "info"] == [whole["info"]]


def test_a_torn_export_fails():
    raw = json.dumps(export(1, ["a"])).encode()[:-30]
    with pytest.raises(ValueError, match="ends inside"):
        list(export_ranges.objects_of(io.BytesIO(raw), 0, len(raw)))


def test_large_chats_equal_whole_ones(spark, tmp_path):
    for name, texts in (("a.json", TRICKY * 3), ("b.json", ["x", "y"])):
        (tmp_path / name).write_text(json.dumps(export(len(texts), texts), indent=1, ensure_ascii=False))
    whole = sorted(map(repr, chats.read_chat(spark, str(tmp_path)).collect()))
    split = chats.read_large_chat(spark, str(tmp_path), 500)
    assert sorted(map(repr, split.collect())) == whole
    assert chats.read_ranges(spark, str(tmp_path), 500).rdd.getNumPartitions() > 4
    assert sorted(map(repr, chats.read_large_chat(spark, f"file://{tmp_path}/a.json").collect())) == [r for r in whole if "a.json" in r]


def test_large_chat_of_a_wrong_count(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(export(3, ["a"])))
    with pytest.raises(PySparkException, match="3 but found 1"):
        chats.read_large_chat(spark, str(tmp_path)).collect()


def test_activity(spark, rows):
    times = spark.sql(
        "SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01 10:00:00'), ('a', TIMESTAMP_NTZ '2024-01-01 11:00:00'),"
        " ('a', TIMESTAMP_NTZ '2024-01-04 10:30:00'), ('b', TIMESTAMP_NTZ '2024-01-02 00:00:00') AS t(user, ts_local)"
    )
    daily = activity.daily_activity(times).select("user", F.col("date").cast("string"), "n")
    assert rows(daily) == [("a", "2024-01-01", 2), ("a", "2024-01-02", 0), ("a", "2024-01-03", 0), ("a", "2024-01-04", 1), ("b", "2024-01-02", 1)]
    hourly = activity.hourly_activity(times)
    assert hourly.count() == 48 and rows(hourly.filter("n > 0")) == [("a", 10, 2), ("a", 11, 1), ("b", 0, 1)]
    assert tuple(activity.most_active_profile(times).first()) == ("a", 3)


def test_small_files_share_a_task_and_large_ones_do_not():
    small = [(f"f{i}", 0, 2_000) for i in range(1_000)]
    large = [("g", at, at + export_ranges.RANGE_BYTES) for at in range(0, 4 * export_ranges.RANGE_BYTES, export_ranges.RANGE_BYTES)]
    tasks = export_ranges.dealt(small + large)
    assert [r for task in tasks for r in task] == small + large and all(tasks)
    assert len(tasks) <= 24 and all(len(task) == 1 for task in tasks[-4:])
    assert export_ranges.dealt([]) == []
