"""Text statistics: initials, vocabulary, TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import normalized, shingles, tokens
from ..functions.storage import cut

#: A word character in Unicode's sense.
NOT_WORD = r"[^\p{L}\p{N}_]+"


def word_initials(docs: DataFrame) -> DataFrame:
    """letter, n: for a..z how many distinct words (lower case) begin with it, zeros included."""
    spark = docs.sparkSession
    own = F.array_distinct(F.split(F.lower("text"), NOT_WORD))  # distinct in the document first, which most words are not
    words = docs.select(F.explode(own).alias("w")).filter(F.col("w").rlike(r"^\p{L}")).distinct()
    counts = words.groupBy(F.substring("w", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    letters = spark.range(26).select(F.char(F.col("id") + 97).alias("letter"))
    return letters.join(F.broadcast(counts.filter(F.col("letter").between("a", "z"))), "letter", "left").select("letter", F.coalesce("n", F.lit(0)).alias("n"))


def shingle_counts(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, n_shingles: distinct k-character shingles of the normalised text."""
    return docs.select("doc_id", F.size(shingles(normalized(F.col("text")), k)).cast("bigint").alias("n_shingles"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return docs.select("doc_id", F.explode(tokens(normalized(F.col("text")))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df."""
    return docs.select("doc_id", F.explode(F.array_distinct(tokens(normalized(F.col("text"))))).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tf_idf(docs: DataFrame) -> DataFrame:
    """doc_id, term, w: tf * ln(N/df), scaled to length 1 a document; zero vectors stay out."""
    n = docs.select("doc_id").distinct().count()
    tf = cut(term_frequencies(docs), "term_frequencies")  # read twice below
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, "term").select("doc_id", "term", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("raw"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")).filter(F.col("norm") > 0)
    return raw.join(norms, "doc_id").select("doc_id", "term", (F.col("raw") / F.col("norm")).alias("w"))


def vocabulary(docs: DataFrame, min_freq: int = 5) -> DataFrame:
    """term, n: words of the normalised texts that occur min_freq times or more."""
    return docs.select(F.explode(tokens(normalized(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_freq)


def padded(docs: DataFrame, length: int = 200, pad: str = "<pad>") -> DataFrame:
    """doc_id, tokens: each text's words, cut or padded to one length."""
    t = tokens(normalized(F.col("text")))
    return docs.select("doc_id", F.slice(F.concat(t, F.array_repeat(F.lit(pad), length)), 1, length).alias("tokens"))
