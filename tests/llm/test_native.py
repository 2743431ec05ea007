"""Token counts, mixing, secrets and the pipeline: brute force, invariants and defined cases."""

import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallbook.llm import mixing, secrets, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, m int, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, 1, "t", 2, "k") for i, t, s in rows], DOCS)


@pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="needs the vocabulary file")
def test_token_counts(spark):
    import tiktoken

    texts = ["Hello world", "", None, "<|endoftext|> naïve", "a" * 50000, "Hello world", "one two three four five", "éè 12345 !!"]
    lengths = token_counts.encoded_lengths(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    with open(token_counts.VOCABULARY, "rb") as file:
        encoder = token_counts._encoder(file.read(), token_counts.PATTERN)
    assert isinstance(encoder, tiktoken.Encoding)
    n = [len(encoder.encode_ordinary(t or "")) for t in texts]
    assert sorted(r["n_tokens"] for r in lengths.collect()) == sorted(n)
    assert all(encoder.decode(encoder.encode_ordinary(t)) == t for t in texts if t)
    sums = token_counts.suffix_sums(token_counts.histogram(lengths)).cache()
    for r in sums.collect():
        limit = r["n_tokens"]
        assert r["n_docs"] == n.count(limit) and r["docs_at_least"] == sum(x >= limit for x in n)
        assert r["tokens_at_least"] == sum(x for x in n if x >= limit)
        assert r["truncated_total"] == sum(min(x, limit) for x in n)
        assert r["share_at_most"] == pytest.approx(sum(x <= limit for x in n) / len(n))
    for limit in (0, 1, 3, 4, 1024, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in n)
    assert token_counts.quantile(sums, 0.5) == sorted(n)[3] and token_counts.quantile(sums, 1.0) == max(n)


def poured(sizes, weights, cap=3.0):
    """Targets by pouring: as long as one is above its cap, stop it there and share again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: dict = {}
    while True:
        open_ones = [s for s in names if s not in full]
        rest = sum(sizes.values()) - sum(full.values())
        total = sum(weight[s] for s in open_ones)
        target = full | {s: rest * weight[s] / total for s in open_ones}
        above = [s for s in open_ones if target[s] > cap * sizes[s]]
        if not above:
            return target
        full |= {s: cap * sizes[s] for s in above}


def test_mixing(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        source = ["big", "b", "é", "small", None][int(rng.choice(5, p=[0.6, 0.2, 0.15, 0.02, 0.03]))]
        rows.append((i, " ".join(["w"] * int(rng.lognormal(3, 1.2))), source))
    rows += [(2000, None, "b"), (2001, " \t\n", "b"), (2002, "x " * 20000, "big"), (3000, "a b c", "é"), (3000, "a b c", "é"), (None, "a b c", None), (4000, "", "none")]
    docs = frame(spark, rows)
    found = mixing.per_document(mixing.mix(docs)).collect()
    assert len(found) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r["doc_id"], r["size"]) for r in found), key=repr) == sorted(((i, words(t)) for i, t, _ in rows), key=repr)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = poured(sizes, (1, 2, 3))
    taken: dict = {}
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 5), s
    assert sorted(map(tuple, mixing.per_document(mixing.mix(docs.repartition(5))).collect()), key=repr) == sorted(map(tuple, found), key=repr)
    kept = mixing.mixed_documents(docs)
    assert kept.columns == [*docs.columns, "n_copies"] and kept.agg(F.sum(F.col("n_copies") * mixing.n_words())).first()[0] == sum(taken.values())
    clashing = mixing.mixed_documents(docs.withColumn("N_copies", F.lit("x")))
    assert clashing.columns == [*docs.columns, "n_copies"] and clashing.count() == kept.count()


def test_tilts_solve_the_dual(spark):
    sizes = spark.createDataFrame([("a", s, n) for s, n in ((1, 50), (10, 30), (100, 5))] + [("b", s, n) for s, n in ((2, 10), (50, 10))], "source string, size long, n long")
    targets = mixing.targets(sizes).withColumn("target", F.when(F.col("source") == "a", 1500.0).otherwise(200.0))
    for r in mixing.solve(sizes, targets).collect():
        rows = [(s, n) for name, s, n in (tuple(x) for x in sizes.collect()) if name == r["source"]]
        reached = sum(n * s * min(3.0, np.exp(r["tilt"] * s / r["mean"])) for s, n in rows)
        assert reached == pytest.approx(r["target"], abs=0.3)


def test_secrets_equal_brute_force(spark):
    base = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    rng = np.random.default_rng(10)
    parts = ["token = \"abcdef123\"", "Secret: token:abcdefgh", "api_key='x'", "PASSWD==a.b/c+d", "AKIA" + "A1" * 8, "AKIA12", "xAKIAAKIA" + "Z" * 16, "0123456789abcdef" * 2, "fade", "é😀", " ", "\n", "password", "apikey: ", "deadbeef" * 3 + "token=" + "a" * 30]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(1, 12)))), "s") for i in range(150)] + [(900, None, "s"), (901, "", "s"), (902, "token: abcdef " * 300, "s"), (5, "token: abcdef", "s"), (5, "token: abcdef", "s"), (None, "AKIA" + "B" * 30, "s")]
    expected = []
    for i, t, _ in rows:
        spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, ok) in enumerate(base) for m in p.finditer(t or "") if ok(m))
        expected.append((i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest(), ",".join(s[2] for s in spans)))
    found = [tuple(r) for r in secrets.per_document(frame(spark, rows)).collect()]
    only_base = lambda spans: ",".join(s for s in spans.split(",") if not s.startswith("random"))
    assert sorted([(*r[:5], only_base(r[5])) for r in found], key=repr) == sorted(expected, key=repr)
    assert secrets.per_document(frame(spark, [])).count() == 0


def test_random_tokens_are_told_from_regular_ones(spark):
    rng = np.random.default_rng(11)
    alphabet = np.array(list(secrets.ALPHABETS["base62"]))
    good = ["".join(rng.choice(alphabet, int(rng.integers(24, 60)))) for _ in range(200)]
    bad = ["Ab1" * 12, "a1B2c3D4e5F6g7H8i9J0" * 2, "aaaaaaaaaaaaaaaaaaaaaaaaA1", "Abcdefghijklmnopqrstuvwxyz0123456789", "0000000000000000000000aZ00000000"]
    plain = ["donaudampfschifffahrtsgesellschaft", "a-very-long-hyphenated-expression-here"]
    docs = frame(spark, [(i, f"see {t} there", "s") for i, t in enumerate(good + bad + plain)])
    marked = {r["doc_id"] for r in secrets.spans(docs).filter("kind = 'random'").collect()}
    assert len(marked & set(range(200))) >= 190
    assert not marked & set(range(200, 207))
    spans = {r["doc_id"]: r["spans"] for r in secrets.per_document(docs).collect()}
    assert spans[min(marked)] == f"random:4:{4 + len(good[min(marked)])}"


def test_p_values_are_fair(spark):
    """Under the tests' own hypothesis a p-value below 0.1 is seen in about a tenth of the tokens or less."""
    rng = np.random.default_rng(12)
    alphabet = np.array(list(secrets.ALPHABETS["base62"]))
    tokens = spark.createDataFrame([("".join(rng.choice(alphabet, 48)),) for _ in range(800)], "token string")
    p = np.array([r["p"] for r in secrets.battery(tokens).select("p").collect()])
    assert len(p) > 700 and (p < 0.1).mean() < 0.14 and (p < 0.01).mean() < 0.025


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the supplied tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER).cache()
        counts.append(after.count())
        assert after.columns[: len(before.columns)] == before.columns
        docs = after
    assert before.count() > counts[0] == counts[1] >= counts[2] > counts[3] > 0 and docs.columns[-1] == "n_copies"
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, docs.collect()))
