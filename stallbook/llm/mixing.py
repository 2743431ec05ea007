"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: sources in code point order (null last) weigh `weights`, repeating, and share all words; a target stops at `cap` times its
source's words and the excess goes to the others by weight.

Rates: of all document rates between 0 and `cap` that meet every source's token constraint, entropy balancing takes those
closest to 1 in relative entropy. They are min(cap, exp(lambda * words / mean words)) with one lambda for each source, the root of the
derivative of the convex dual. Newton steps, kept inside a shrinking bracket, find all lambdas at once; a step is an aggregate over the
distinct (source, words) pairs.

Copies: the documents of a source are dealt into cells of about `CELL` by a hash. In a cell, from the longest document to the shortest, each takes
the number of copies nearest to its rate plus what the longer ones left over, so a cell ends within about half its shortest
document of its share.

Defined cases: a null or empty text has no words, and takes 0 of them. Null sources are one source, the last. Rows equal in doc_id, source
and words are rated together and share the copies as evenly as whole numbers allow. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallbook.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
CELL = 512
#: Parts that the rows of one source are dealt to where they meet the source's figures.
SALT = 16
STEPS = 60


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, n_docs, source_size, mean, target from (source, size, n) rows."""
    sources = sizes.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # The windows run over sources, not documents.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    full = F.col("source_size") * cap
    order = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # Words for a unit of weight if all sources before this one stop at their cap; it is highest where the next one doesn't.
    level = F.max("share").over(everything)
    return (
        weighed.withColumn("share", rest / rest_weight)
        .withColumn("target", F.least(full, F.col("weight") * level))
        .select("source", "n_docs", "source_size", (F.col("source_size") / F.col("n_docs")).alias("mean"), "target")
    )


def _rate(words: Column, mean: Column, tilt: Column, cap: float) -> Column:
    """min(cap, exp(tilt * words / mean)); the exponent stays finite."""
    return F.least(F.lit(cap), F.exp(F.least(tilt * words / mean, F.lit(math.log(cap) + 1.0))))


def solve(sizes: DataFrame, sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """The sources with `tilt`, their lambda. Sources at the cap or without words need none: their rate is the cap, or any."""
    free = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * cap)
    start = sources.select(
        "*",
        F.lit(0.0).alias("tilt"),
        # Beyond these every document has the cap, or next to nothing.
        (F.col("mean") * -700.0).alias("low"),
        (F.col("mean") * math.log(cap) + 1.0).alias("high"),
        (~free).alias("done"),
    )
    state = stored(start, "mix_state")
    words = F.col("size").cast("double")
    for _ in range(STEPS):
        rate = _rate(words, F.col("mean"), F.col("tilt"), cap)
        value = F.sum(F.col("n") * words * rate)
        slope = F.sum(F.when(rate < cap, F.col("n") * words * words / F.col("mean") * rate).otherwise(0.0))
        open_rows = state.filter(~F.col("done")).withColumnRenamed("source", "s")
        sums = sizes.join(open_rows, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(value.alias("value"), slope.alias("slope"))
        over = F.col("value") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("value") - F.col("target")) / F.col("slope")
        met = F.abs(F.col("value") - F.col("target")) <= F.greatest(F.lit(0.25), F.col("target") * 1e-10)
        moved = (
            state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("now_done", F.col("done") | F.coalesce(met, F.lit(True)) | (F.col("high") - F.col("low") < 1e-13))
            .withColumn("l", low)
            .withColumn("h", high)
            .withColumn("next", F.when((F.col("slope") > 0) & (newton > F.col("l")) & (newton < F.col("h")), newton).otherwise((F.col("l") + F.col("h")) / 2))
        )
        held = F.col("now_done")
        state = stored(
            moved.select(
                *sources.columns,
                *(F.when(held, F.col(old)).otherwise(F.col(new)).alias(old) for old, new in (("tilt", "next"), ("low", "l"), ("high", "h"))),
                held.alias("done"),
            ),
            "mix_state",
        )
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select(*sources.columns, F.when(F.col("target") >= F.col("source_size") * cap, F.lit(None)).otherwise(F.col("tilt")).alias("tilt"))


def _copies(docs: Column, cap: float) -> Column:
    """Copies of the documents of a cell, from the longest on; what rounding leaves is carried to the next."""

    def take(state: Column, doc: Column) -> Column:
        wanted = doc["rate"] * doc["m"] * doc["size"] + state["left"]
        copies = F.least(F.greatest(F.round(wanted / F.greatest(doc["size"], F.lit(1))), F.lit(0.0)), doc["m"] * math.floor(cap)).cast("long")
        return F.struct((wanted - copies * doc["size"]).alias("left"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<long>").alias("copies"))
    return F.aggregate(docs, start, take, lambda state: state["copies"])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, m (equal rows), copies (of all m together) for each distinct (doc_id, source, size)."""
    counted = stored(docs.select("doc_id", "source", n_words().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix_sizes")
    sizes = stored(counted.groupBy("source", "size").agg(F.sum("m").alias("n")), "mix_histogram")
    solved = solve(sizes, stored(targets(sizes, weights, cap), "mix_targets"), cap)
    figures = solved.select(F.col("source").alias("s"), "source_size", "mean", "target", "tilt", F.ceil(F.col("n_docs") / CELL).alias("cells"))
    salted = figures.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    deal = F.xxhash64("doc_id", "size")
    rated = (
        counted.withColumn("deal", deal)
        .join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.pmod(F.col("deal"), F.lit(SALT)) == F.col("part")))
        .withColumn("rate", F.when(F.col("tilt").isNull() | (F.col("source_size") == 0), F.lit(cap)).otherwise(_rate(F.col("size").cast("double"), F.col("mean"), F.col("tilt"), cap)))
        .withColumn("cell", F.pmod(F.shiftrightunsigned("deal", 8), F.col("cells")))
    )
    doc = F.struct((-F.col("size")).alias("order"), "doc_id", "size", "m", "rate")
    cells = rated.groupBy("source", "cell").agg(F.array_sort(F.collect_list(doc)).alias("docs"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    taken = cells.withColumn("copies", _copies(F.col("docs"), cap)).withColumn("pair", F.explode(F.arrays_zip("docs", "copies")))
    return taken.select("pair.docs.doc_id", "source", "pair.docs.size", "source_size", "target", "pair.docs.m", "pair.copies")


def _share(copies: Column, m: Column, place: Column) -> Column:
    """Copies of one of m equal rows."""
    return F.floor(copies / m) + F.when(place <= copies % m, 1).otherwise(0)


def per_document(mixed: DataFrame) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, copies, taken."""
    rows = mixed.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = _share(F.col("copies"), F.col("m"), F.col("place"))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The documents that the mix takes, with all their columns and n_copies, the number of copies, in place of a column of that name."""
    plan = mix(docs, weights, cap).select(F.col("doc_id").alias("p_doc"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "m", F.col("copies").alias("all_copies"))
    rows = docs.select(F.struct("*").alias("d"), n_words().alias("size"))
    joined = rows.join(plan, F.col("d.doc_id").eqNullSafe(F.col("p_doc")) & F.col("d.source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    place = F.row_number().over(Window.partitionBy("p_doc", "p_source", "p_size").orderBy(F.xxhash64("d.text")))
    kept = joined.withColumn("n_copies", _share(F.col("all_copies"), F.col("m"), place).cast("int")).filter("n_copies > 0")
    return kept.select(*(F.col(f"d.`{c}`") for c in docs.columns if c.lower() != "n_copies"), "n_copies")
