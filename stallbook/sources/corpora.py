"""Annotated corpora in JSON lines, and the split files built from them."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallbook.functions.text import is_not_blank, strip

_ROWS = T.ArrayType(T.ArrayType(T.StringType()))


def file_title(path: Column) -> Column:
    """Name of the file, or of the folder when Spark wrote it in parts (`name/part-..`, `key=name/part-..`)."""
    return F.regexp_extract(path, r"([^/=]+?)(?:/part-[^/]*)?$", 1)


def _spans(raw: Column) -> Column:
    return F.transform(
        raw,
        lambda s: F.struct(
            F.get(s, F.lit(0)).cast("int").alias("start"),
            F.get(s, F.lit(1)).cast("int").alias("end"),
            F.get(s, F.lit(2)).alias("label"),
        ),
    )


def _relations(raw: Column) -> Column:
    return F.transform(
        raw,
        lambda r: F.struct(
            F.get(r, F.lit(0)).cast("int").alias("start1"),
            F.get(r, F.lit(1)).cast("int").alias("end1"),
            F.get(r, F.lit(2)).cast("int").alias("start2"),
            F.get(r, F.lit(3)).cast("int").alias("end2"),
            F.get(r, F.lit(4)).alias("label"),
        ),
    )


def read_annotated(
    spark: SparkSession,
    path,
    text_column: str = "text",
    label_column: str = "entities",
    relation_column: str = "relations",
) -> DataFrame:
    """Documents with a visible text: id, text, spans, relations, file. Missing columns read as null."""
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField(text_column, T.StringType()),
            T.StructField(label_column, _ROWS),
            T.StructField(relation_column, _ROWS),
        ]
    )
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    return raw.filter(is_not_blank(F.col(text_column))).select(
        "id",
        F.col(text_column).alias("text"),
        _spans(F.col(label_column)).alias("spans"),
        _relations(F.col(relation_column)).alias("relations"),
        file_title(F.col("_metadata.file_path")).alias("file"),
    )


def union_corpus(train=(), dev=(), test=()) -> DataFrame:
    """All documents of the given frames with their split; a frame given twice counts twice."""
    parts = [
        docs.withColumn("split", F.lit(split))
        for split, frames in (("train", train), ("dev", dev), ("test", test))
        for docs in frames
    ]
    if not parts:
        raise RuntimeError("no data provided: name at least one train, dev or test file")
    return reduce(DataFrame.unionByName, parts)


def split_from_file_name(file: Column) -> Column:
    """`train`; `dev` or `testa`; `test` or `testb`; null for other files."""
    name = F.lower(file)
    return (
        F.when(name.contains("train"), "train")
        .when(name.contains("dev") | name.contains("testa"), "dev")
        .when(name.contains("test"), "test")
    )


def read_corpus_folder(spark: SparkSession, folder: str, label_column: str = "entities") -> DataFrame:
    docs = read_annotated(spark, folder, label_column=label_column)
    return docs.withColumn("split", split_from_file_name(F.col("file"))).filter("split IS NOT NULL")


def to_annotated_json(docs: DataFrame, label_column: str = "entities") -> DataFrame:
    """Documents in the list form of the corpus files."""
    text = lambda x: x.cast("string")
    spans = F.transform("spans", lambda s: F.array(text(s["start"]), text(s["end"]), s["label"]))
    relations = F.transform(
        "relations",
        lambda r: F.array(text(r["start1"]), text(r["end1"]), text(r["start2"]), text(r["end2"]), r["label"]),
    )
    return docs.withColumns({label_column: spans, "relations": relations}).drop(
        *([] if label_column == "spans" else ["spans"])
    )


def write_jsonl(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.json(path)


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Visible lines of all documents, stripped."""
    line = strip(F.col("line"))
    return docs.select(F.explode(F.split(text, "\n")).alias("line")).select(line.alias("value")).filter("value <> ''")


def write_lines(docs: DataFrame, path: str, text: str = "text") -> None:
    lines_of(docs, text).write.text(path)


def read_label_folder(spark: SparkSession, folder: str, title_case: bool = True) -> DataFrame:
    """One row per line of a folder of text files: class from the file name, stripped text."""
    name = F.regexp_replace(file_title(F.col("_metadata.file_path")), r"\..*$", "")
    shown = F.initcap(F.regexp_replace(name, "_", " ")) if title_case else name
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    return lines.select(shown.alias("class"), strip(F.col("value")).alias("item"))


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_patterns(patterns: DataFrame, path: str) -> None:
    """One phrase per line: label and its tokens, tokens from the third on marked optional."""
    optional = F.transform(
        "tokens",
        lambda t, i: F.struct(t.alias("LOWER"), F.when(i >= 2, F.lit("?")).alias("OP")),
    )
    patterns.select("label", optional.alias("pattern")).write.json(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("label string, pattern array<struct<LOWER: string, OP: string>>").json(path)
    return raw.select("label", F.col("pattern.LOWER").alias("tokens"))


def write_matrix_csv(cells: DataFrame, path: str, classes: list[str] | None = None) -> list[str]:
    """Square matrix with one row and one column per class; returns the classes in column order."""
    matrix, columns = matrix_of(cells, classes)
    matrix.write.option("header", True).csv(path)
    return columns


def matrix_of(cells: DataFrame, classes: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The matrix and its columns: the classes of the data in order, or the given ones, which must hold all of the data.

    A column per class is what the matrix is, so its classes are few by nature.
    """
    seen = sorted(r["class_b"] for r in cells.select("class_b").distinct().collect())
    columns = seen if classes is None else list(classes)
    if missing := sorted(set(seen) - set(columns)):
        raise ValueError(f"classes without a column: {missing}")
    return cells.groupBy("class_a").pivot("class_b", columns).agg(F.first("value")), columns
