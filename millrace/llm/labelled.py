"""A bounded sample of labelled documents, to fit models on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, where: Column, per_class: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, label and extra columns) for at most per_class documents of each label 0 and 1, the first by a hash
    of the id among rows of labels that `where` allows and that have no null among the labels asked for. Of copies of a text
    the one of the least id counts, so that reruns learn alike. Written to the shared folder; the join's broadcast side has
    at most 2 * per_class rows, whatever the tables' sizes."""
    rows = labels.filter(where).select("doc_id", label, *extra).na.drop()
    chosen = reduce(DataFrame.unionByName, [rows.filter(F.col(label) == v).orderBy(F.xxhash64("doc_id"), "doc_id", *extra).limit(per_class) for v in (0, 1)])
    kept = materialize(chosen, "chosen")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(kept), "doc_id")
    first = found.groupBy("text").agg(F.min(F.struct("doc_id", label, *extra)).alias("first"))
    return materialize(first.select("first.doc_id", "text", *[f"first.{c}" for c in (label, *extra)]), "sample")
