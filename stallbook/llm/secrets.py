"""Secrets in texts: three fixed patterns, and tokens that a battery of randomness tests finds random. DataFrame operations only.

Base kinds: `assign` (a name such as password, a sign and a value of 6 characters or more), `access` (AKIA and 20 characters or more in all) and
`hex` (24 hexadecimal digits or more). Matches are leftmost and do not overlap within a kind; assignments that are too short are dropped
afterwards. Runs of the other kinds are maximal, so their patterns ask for the length at once: a run that is too short holds no later match. Positions are code points: a text is split at its matches, and the lengths of the pieces are summed up.

Random tokens are runs of at least `MIN_TOKEN` characters of [A-Za-z0-9+/_-] outside the base spans whose characters name an
encoding: hexadecimal, base32, base36, base62 or base64. Three tests compare each token with independent uniform draws from its
encoding's alphabet: chi-squared uniformity (symbols in classes of about four expected each), the number of runs above and below the
alphabet's middle, and the serial correlation of neighbours. The smallest p-value times three is the token's. Tokens whose p-value the
step-up procedure at level `LEVEL` rejects, within their length class over the whole table, are not random; all others become spans
of kind `random`. P-values are rounded up to a fine grid, so the procedure needs one row for each class and grid value.

Defined cases: a null or empty text has no spans. Rows with equal doc_id and text have equal answers. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallbook.scratch import stored

# The kinds in the order in which they are listed, each with its pattern and its smallest length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
BASE = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))

MIN_TOKEN = 20
LEVEL = 0.01
#: Steps of the p-value grid in a power of ten.
GRID = 20
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Matches of a pattern with the text piece before each."""
    return F.when(
        F.regexp_like(text, F.lit(pattern)),
        F.transform(
            F.filter(
                F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), F.split(text, pattern, -1).alias("before")),
                lambda m: m["found"].isNotNull(),
            ),
            lambda m: F.struct(F.lit(kind).alias("kind"), m["found"].alias("found"), m["value"].alias("value"), F.char_length(m["before"]).alias("before")),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,found:string,value:string,before:int>>"))


def _matches(docs: DataFrame) -> DataFrame:
    """doc_id, row, kind, found, value, start, end of all matches of all four patterns, each text once."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    patterns = [(kind, pattern, 2 if kind == "assign" else 0) for kind, pattern, _ in BASE] + [("random", _TOKEN, 0)]
    some = F.regexp_like(text, F.lit(ASSIGN))
    for pattern in (ACCESS, HEX, _TOKEN):
        some = some | F.regexp_like(text, F.lit(pattern))
    hits = rows.filter(some).dropDuplicates(["doc_id", "row"])
    # One pass over a text for all kinds; places rise within a kind.
    found = F.concat(*(_found(text, kind, pattern, group) for kind, pattern, group in patterns))
    exploded = hits.select("doc_id", "row", F.posexplode(found).alias("place", "m"))
    so_far = Window.partitionBy("doc_id", "row", "m.kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.char_length("m.found")
    placed = exploded.withColumn("end", F.sum(F.col("m.before") + length).over(so_far))
    return placed.select("doc_id", "row", "m.kind", "m.found", "m.value", (F.col("end") - length).alias("start"), "end")


def _normal_tail(z: Column) -> Column:
    """Two-sided normal tail probability, by the complementary error function of a numerical table (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the published Chebyshev fit.
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    return F.least(t * F.exp(-x * x + fit), F.lit(1.0))


def _upper_tail(z: Column) -> Column:
    return F.when(z > 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)


def encoding() -> Column:
    """Name of the smallest alphabet that holds the token, if it mixes what its encoding mixes."""
    has = lambda pattern: F.col("token").rlike(pattern)
    digit, low, up = has("[0-9]"), has("[a-z]"), has("[A-Z]")
    return (
        F.when(digit & low & has("^[0-9a-f]+$"), "hex")
        .when(digit & up & has("^[0-9A-F]+$"), "HEX")
        .when(digit & up & has("^[A-Z2-7]+$"), "base32")
        .when(digit & low & has("^[0-9a-z]+$"), "base36")
        .when(digit & up & has("^[0-9A-Z]+$"), "BASE36")
        .when(digit & low & up & has("^[0-9A-Za-z]+$"), "base62")
        .when(digit & low & up & has("^[0-9A-Za-z+/]+$"), "base64")
        .when(digit & low & up & has("^[0-9A-Za-z_-]+$"), "base64url")
    )


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, p (that of the battery) and length_class to rows with a token; rows without an encoding go."""
    named = tokens.withColumn("encoding", encoding()).filter("encoding is not null")
    alphabet = F.element_at(F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair)), F.col("encoding"))
    symbols = F.transform(F.split("token", ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    coded = named.withColumn("alphabet", alphabet).withColumn("x", F.filter(symbols, lambda v: v >= 0)).withColumn("n", F.size("x").cast("double")).withColumn("a", F.char_length("alphabet").cast("double"))

    # Chi-squared over classes of neighbouring symbols, four draws expected in each.
    classes = F.greatest(F.least(F.floor(F.col("n") / 4), F.col("a")), F.lit(2.0))
    first = lambda j: F.ceil(j * F.col("a") / F.col("k"))  # noqa: E731  symbols first(j) .. first(j + 1) - 1 are class j
    share = lambda j: (first(j + 1) - first(j)) / F.col("a")
    seen = lambda j: F.size(F.filter("x", lambda v: (v >= first(j)) & (v < first(j + 1))))
    terms = F.transform(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")), lambda j: F.pow(seen(j) - F.col("n") * share(j), F.lit(2.0)) / (F.col("n") * share(j)))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    df = F.col("k") - 1
    chi_z = (F.pow(F.col("chi") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # cube-root normal approximation

    # Runs above and below the middle of the alphabet.
    above = F.transform("x", lambda v: v >= F.col("a") / 2)
    pairs = lambda values: F.arrays_zip(F.slice(values, 1, F.size(values) - 1).alias("l"), F.slice(values, 2, F.size(values) - 1).alias("r"))
    runs = F.size(F.filter(pairs(F.col("up")), lambda p: p["l"] != p["r"])) + 1
    n1 = F.size(F.filter("up", lambda v: v)).cast("double")
    n2 = F.col("n") - n1
    mean = 2 * n1 * n2 / F.col("n") + 1
    variance = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    runs_z = F.when(variance > 0, (runs - mean) / F.sqrt(variance)).otherwise(F.lit(10.0))

    # Correlation of each symbol with the next.
    centre = total(F.col("x")) / F.col("n")
    spread = total(F.transform("x", lambda v: (v - F.col("centre")) * (v - F.col("centre"))))
    product = total(F.transform(pairs(F.col("x")), lambda p: (p["l"] - F.col("centre")) * (p["r"] - F.col("centre"))))
    serial_z = F.when(spread > 0, (product / spread + 1 / F.col("n")) * F.sqrt(F.col("n"))).otherwise(F.lit(10.0))

    tested = (
        coded.withColumn("k", classes.cast("double"))
        .withColumn("chi", total(terms))
        .withColumn("up", above)
        .withColumn("centre", centre)
        .withColumn("p_uniform", _upper_tail(chi_z))
        .withColumn("p_runs", _normal_tail(runs_z))
        .withColumn("p_serial", _normal_tail(serial_z))
    )
    smallest = F.least(F.least("p_uniform", "p_runs", "p_serial") * 3, F.lit(1.0))
    return tested.withColumn("p", smallest).withColumn("length_class", F.floor(F.log2("n"))).drop("alphabet", "x", "n", "a", "k", "chi", "up", "centre")


def structured_limits(tested: DataFrame, level: float = LEVEL) -> DataFrame:
    """length_class, limit: tokens with `grid` >= limit are not random. Step-up false-discovery control within each length class."""
    counted = tested.groupBy("length_class", "grid").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("length_class").orderBy(F.col("grid").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy("length_class")
    p = F.pow(F.lit(10.0), -F.col("grid") / GRID)
    passed = counted.withColumn("rejected", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(everything)).filter(p * F.col("all") <= level * F.col("rejected"))
    return passed.groupBy("length_class").agg(F.min("grid").alias("limit"))


def spans(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, row (hash of the text), kind, start, end of all secrets; code points, end exclusive."""
    found = stored(_matches(docs), "secret_matches")
    size = F.when(F.col("kind") == "assign", F.char_length("value")).otherwise(F.char_length("found"))
    long = F.lit(False)
    for kind, _, least in BASE:
        long = long | ((F.col("kind") == kind) & (size >= least))
    near = found.withColumn("base", long).filter("base or kind = 'random'")
    # Spans of a text in order of their start: a token overlaps a base span that begins before it and ends inside, or begins inside it.
    order = Window.partitionBy("doc_id", "row").orderBy("start")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    tokens = near.withColumn("free", free).filter("kind = 'random' and free").withColumnRenamed("found", "token")
    tested = stored(battery(tokens).withColumn("grid", F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * GRID)).drop("token", "value"), "secret_tokens")
    limits = structured_limits(tested, level)
    # One row for each power of two that a token's length can have.
    random = tested.join(F.broadcast(limits), "length_class", "left").filter("limit is null or grid < limit")
    columns = ["doc_id", "row", "kind", "start", "end"]
    return near.filter("base").select(columns).unionByName(random.select(columns))


def _has_rank(rank: int):
    return lambda span: span["rank"] == rank


def per_document(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """A row for each document: doc_id, number of spans of each base kind, digest of the base spans, and all spans as text."""
    order = {kind: i for i, (kind, _, _) in enumerate(BASE)} | {"random": len(BASE)}
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), F.col("kind"))
    span = F.struct(F.col("start"), rank.alias("rank"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("text"))
    listed = spans(docs, level).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    of = lambda keep: F.filter(F.coalesce(F.col("spans"), F.array().cast("array<struct<start:long,rank:int,text:string>>")), keep)
    joined = lambda keep: F.concat_ws(",", F.transform(of(keep), lambda s: s["text"]))
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("r"))
    return rows.join(listed, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row")), "left").select(
        F.col("d").alias("doc_id"),
        *(F.size(of(_has_rank(i))).cast("long").alias(f"n_{kind}") for i, (kind, _, _) in enumerate(BASE)),
        F.sha2(joined(lambda s: s["rank"] < len(BASE)), 256).alias("base_sha256"),
        joined(lambda s: s["rank"] >= 0).alias("spans"),
    )
