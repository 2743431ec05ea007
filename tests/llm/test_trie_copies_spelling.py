"""Conversation trie, exact dedup and spelling variants against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallbook.llm import conversation_trie, exact_dedup, spelling

# ---- conversation trie


def brute_trie(rows, family=None, heads=0):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    seqs = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % heads if heads else 0
        base = own.get(c - int(np.fmod(c, family)), []) if family else []
        seqs[c] = tuple(base[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    out = []
    for node, ids in members.items():
        under = below[node]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in under)
        ends = ",".join(map(str, sorted(c for c in ids if len(seqs[c]) == len(node))))
        leaves = sum(1 for x in under if len(below[x]) == 1)
        children = sum(len(x) == len(node) + 1 for x in under)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string, keys string, sizes string, family long, depth long, part int"


def talk(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "k", "s", 1, 2, 3) for r in rows], TURNS).repartition(parts)


def nodes(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, alphabet, family", [(1, 3, None), (2, 2, 10), (3, 1, None), (4, 40, 100)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, alphabet, family):
    monkeypatch.setattr(conversation_trie, "PART_ROWS", 9)  # many partitions: most prefixes cross an edge
    monkeypatch.setattr(conversation_trie, "CANDIDATES", 16)
    monkeypatch.setattr(conversation_trie, "CHUNK_IDS", 3)
    r = random.Random(seed)
    rows = []
    for c in range(-30, 130):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", None, ""]), r.choice([None, "", *(f"té{i}" * i for i in range(alphabet))])))
    rows += rows[:20]  # repeated rows
    rows += [(None, 1, "user", "nobody"), (500, 3, "user", "a" * 200_000), (501, 3, "user", "a" * 200_000)]
    rows += [(600 + i, 0, "system", "everywhere") for i in range(90)]  # one very common conversation
    heads = 6 if family else 0
    assert nodes(conversation_trie.prefix_trie(talk(spark, rows), family, heads)) == brute_trie(rows, family, heads)


def test_trie_of_ties_and_of_cut_roles(spark):
    rows = [(1, 1, "b", "x"), (1, 1, "a", "y"), (2, None, "a", "y"), (2, None, "b", "x"), (3, 1, "ab", "c"), (4, 1, "a", "bc")]
    assert nodes(conversation_trie.prefix_trie(talk(spark, rows))) == brute_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    # Conversation 105 has no base and fewer turns than it gives away; it is a member of the root alone.
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(short, 0, "user", "gone")]
    assert nodes(conversation_trie.prefix_trie(talk(spark, rows), 100, 6)) == brute_trie(rows, 100, 6)
    assert nodes(conversation_trie.prefix_trie(talk(spark, []), 100, 6)) == []


def test_extents_equal_a_scan():
    r = np.random.default_rng(5)
    values = r.integers(0, 5, 200)
    table = conversation_trie._Minima(values)
    at, depth = r.integers(0, 200, 300), r.integers(0, 6, 300)
    for i, d, left, right in zip(at, depth, table.left_extent(at, depth), table.right_extent(at, depth)):
        scan = i
        while scan + 1 < 200 and values[scan + 1] >= d:
            scan += 1
        assert right == scan
        scan = i
        while scan > 0 and values[scan] >= d:
            scan -= 1
        assert left == scan
    lo, hi = np.minimum(at, at[::-1]), np.maximum(at, at[::-1])
    assert table.least(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi)]


# ---- exact dedup

DOCS = "doc_id long, text string, lang string, hash long, bucket int, page string, kept string, sha256 string, owner int"


def documents(spark, rows, parts=6):
    return spark.createDataFrame([(*r, "en", 1, 2, "p", "k", "s", 3) for r in rows], DOCS).repartition(parts)


def brute_copies(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append((doc is None, doc or 0, i))
    out = []
    for text, found in groups.items():
        found.sort()
        keep = rows[found[0][2]][0]
        for place, (_, _, i) in enumerate(found):
            out.append((rows[i][0], keep, len(found), place == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def copies(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def copied():
    r = random.Random(8)
    spaces = [" ", "  ", "\t", "\n\r", " \x0b\x0c", " ", " "]
    rows = []
    for i in range(400):
        words = [r.choice(["a", "bb", "é", "ccc"]) for _ in range(r.randrange(0, 4))]
        rows.append((r.randrange(10_000), r.choice(["", " ", "\n"]) + "".join(w + r.choice(spaces) for w in words)))
    rows += [(20_000 + i, "one  text\tfor a third of all rows") for i in range(300)]
    rows += [(30_000, "x" * 300_000), (30_001, "x" * 300_000 + " "), (30_002, "x" * 300_000), (None, "nobody"), (None, "nobody"), (5, None), (6, ""), (7, "   ")]
    return rows + rows[:30]


@pytest.mark.parametrize("most_rows", [(1 << 10, 1 << 17), (16, 16)])
def test_copies_equal_brute_force(spark, monkeypatch, copied, most_rows):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", most_rows)  # the small one splits buckets and chains pages
    assert copies(exact_dedup.equal_texts(documents(spark, copied))) == brute_copies(copied)


def test_texts_of_one_key_are_told_apart_by_their_bytes(monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    # Workers import the module anew, so the stages are called here.
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: 42)
    directory = exact_dedup.Directory(0, np.zeros(1, int), np.zeros(1, np.int8), np.array([1]), np.zeros(1, int), 1)
    shared = type("Shared", (), {"value": directory})
    routed = list(exact_dedup._route(shared)(iter(text_batches(rows))))
    assert {x for b in routed for x in b.column("hash").to_pylist()} == {42}
    found = [row for b in exact_dedup._chains(shared)(iter(routed)) for row in b.to_pylist()]
    assert sorted((x["doc_id"], x["keep_id"], x["group_size"], x["first"]) for x in found) == sorted((i, i % 7, 9 if i % 7 < 4 else 8, i < 7) for i, _ in rows)
    assert len({x["chain"] for x in found}) == 7


def text_batches(rows):
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t.encode() for _, t in rows], pa.binary())})
    return table.to_batches(max_chunksize=11)


def test_directory_splits_only_overfull_buckets():
    rows = np.zeros(64)
    rows[:4], rows[40] = 5, 100  # an even corner and one bucket of copies
    found = exact_dedup.split_buckets(6, rows, rows, 10, 1e9)
    assert found.depth == 6
    held = np.bincount(found.bucket, rows)
    assert sorted(held[held > 0]) == [10, 10, 100] and found.pages[held == 100] == 10 and (found.pages[held < 100] == 1).all()
    assert (np.diff(found.bucket) >= 0).all() and (np.diff(found.owner) >= 0).all() and found.n_owners > found.owner.max()
    lone = exact_dedup.split_buckets(3, np.ones(8), np.ones(8), 10, 10)
    assert (lone.depth, lone.n_owners, lone.slot(1 << 63)) == (0, 1, 0)


def test_index_on_shared_files_finds_copies(spark, copied, tmp_path):
    path = exact_dedup.write_index(documents(spark, copied), f"file://{tmp_path}/index")
    asked = documents(spark, [(1, "one text for a third of\nall rows"), (2, "something else"), (3, None), (4, " ")])
    assert sorted(tuple(r) for r in exact_dedup.find_copies(asked, path).collect()) == [(1, 20_000), (2, None), (3, 5), (4, 7)]


def test_no_documents_have_no_copies(spark):
    assert copies(exact_dedup.equal_texts(documents(spark, []))) == []


# ---- spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows, every=97):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=repr)


def spelled(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.fixture(scope="module")
def prose():
    r = random.Random(3)
    words = ["".join(r.choice("abÀé÷") for _ in range(r.randrange(4, 8))) for _ in range(150)] + ["Straße", "STRASSE", "strase"]
    rows = [(i, "; ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(150)]
    rows += [(1000 + i, "hotword " * 200 + "hotwort hotwordĀhotwor") for i in range(4)]  # one word holds a third
    long = "ab" * 40_000
    rows += [(2000, f"{long} {long} {long}"), (2001, f"{long}c {long}c {long}c {long}c {long}c {long}c"), (2002, None), (2003, ""), (None, "hotwort " * 5)]
    return rows + rows[:10]


@pytest.mark.parametrize("block, work, every", [(1024, 8192, 97), (5, 8192, 3), (7, 40, 97)])
def test_spelling_equals_brute_force(spark, monkeypatch, prose, block, work, every):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "WORK", work)  # the small one needs many classes
    docs = spark.createDataFrame([(i, t, "en", 1, "c") for i, t in prose], "doc_id long, text string, word string, n long, cell string").repartition(4)
    assert spelled(spelling.spelling_variants(docs, every=every)) == brute_spelling(prose, every)


def test_more_words_make_more_classes(spark, monkeypatch):
    words = spark.range(3000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "qwertyuiop"), F.lit("xyz")).alias("word"))
    counts = []
    for work in (10**9, 4000, 500):
        monkeypatch.setattr(spelling, "WORK", work)
        counts.append(spelling.number_of_classes(words))
    assert counts[0] == 1 and counts == sorted(counts) and counts[2] > 1


def test_no_documents_have_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelled(spelling.spelling_variants(docs)) == []
