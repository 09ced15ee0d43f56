"""Readers of plain-text inputs: friend lists, baskets, articles, numeric rows, ratings and edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def friend_lists(spark: SparkSession, path: str) -> DataFrame:
    """src, dst from lines `user<TAB>f1,f2,...`; malformed and empty lists give no rows, self-loops are dropped."""
    part = F.split("value", "\t")
    pairs = spark.read.text(path).filter(F.size(part) == 2).select(F.get(part, F.lit(0)).try_cast("bigint").alias("src"), F.explode(F.split(F.get(part, F.lit(1)), ",")).alias("f"))
    return pairs.select("src", F.trim("f").try_cast("bigint").alias("dst")).filter(F.col("src") != F.col("dst"))


def baskets(spark: SparkSession, path: str) -> DataFrame:
    """basket, item: distinct items of each non-blank line."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("basket"), "value")
    return lines.select("basket", F.explode(F.array_distinct(F.split(F.trim("value"), r"\s+"))).alias("item"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text from lines `<id> <text>`; a line without a space has an empty text."""
    part = F.split("value", " ", 2)
    return spark.read.text(path).filter(F.col("value") != "").select(F.get(part, F.lit(0)).alias("doc_id"), F.coalesce(F.get(part, F.lit(1)), F.lit("")).alias("text"))


def numeric_rows(spark: SparkSession, path: str) -> DataFrame:
    """features: the numbers of each non-blank line; null for what is none."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double")).alias("features"))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """user, item, rating, ts from headerless CSV. Of lines that repeat a user and item the last counts, by the time and then
    by the place in the text."""
    rows = spark.read.schema("user bigint, item bigint, rating double, ts bigint").csv(path).withColumn("at", F.monotonically_increasing_id())
    last = rows.groupBy("user", "item").agg(F.max_by(F.struct("rating", "ts"), F.col("at")).alias("r"))
    return last.select("user", "item", "r.rating", "r.ts")


def interactions(spark: SparkSession, path: str) -> DataFrame:
    """user, item, ts from headerless CSV of three columns: a test file, whose ratings are to be told."""
    return spark.read.schema("user bigint, item bigint, ts bigint").csv(path)


def edge_list(spark: SparkSession, path: str, comment: str = "#", exact: bool = True) -> DataFrame:
    """src, dst from white-space separated lines that don't begin with `comment`. exact asks for two fields and gives
    distinct edges; else more fields are allowed and repeats stay."""
    part = F.split(F.trim("value"), r"\s+")
    n = F.size(part)
    kept = spark.read.text(path).filter(~F.col("value").startswith(comment) & ((n == 2) if exact else (n >= 2)))
    edges = kept.select(F.get(part, F.lit(0)).try_cast("bigint").alias("src"), F.get(part, F.lit(1)).try_cast("bigint").alias("dst")).dropna()
    return edges.distinct() if exact else edges


def greatest_id(edges: DataFrame) -> DataFrame:
    """id: the greatest node number, 0 without edges."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0)).alias("id"))


def labelled_rows(spark: SparkSession, path: str) -> DataFrame:
    """features, label from headerless CSV whose last field is a whole label; what is no number is null."""
    part = F.split("value", ",")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.transform(F.slice(part, F.lit(1), F.size(part) - 1), lambda x: F.trim(x).try_cast("double")).alias("features"), F.trim(F.element_at(part, -1)).try_cast("double").cast("int").alias("label"))


def table_csv(spark: SparkSession, path: str, index: str | None = None, latin: bool = False, schema: str | None = None) -> DataFrame:
    """CSV with a header. index renames the first column, which has no name in files that were written with one; latin reads
    ISO-8859-1."""
    reader = spark.read.option("header", True).option("encoding", "ISO-8859-1" if latin else "UTF-8").option("multiLine", latin)
    rows = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return rows.withColumnRenamed(rows.columns[0], index) if index else rows


def id_urls(spark: SparkSession, begin: int, end: int) -> DataFrame:
    """id, url for a range of ids. The url's form is a fixed value."""
    i = F.col("id")
    return spark.range(begin, end).select("id", F.concat(F.lit("https://site"), (i % 100000).cast("string"), F.lit(".gov.kr/page/"), i.cast("string")).alias("url"))


def write_report(rows: DataFrame, path: str, sep: str = "\t", header: bool = False) -> None:
    """Rows as delimited text, in the frame's order within each part."""
    rows.write.option("sep", sep).option("header", header).csv(path)


def report_lines(rows: DataFrame) -> DataFrame:
    """line: each row's columns with tabs between, arrays with commas; numbers with a point as %.6f."""
    show = lambda name, kind: F.array_join(F.transform(name, lambda x: x.cast("string")), ",") if kind.startswith("array") else F.format_string("%.6f", F.col(name)) if kind in ("double", "float") else F.col(name).cast("string")
    return rows.select(F.concat_ws("\t", *[show(n, k) for n, k in rows.dtypes]).alias("line"))
