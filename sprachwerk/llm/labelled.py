"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many label rows are used in a fit; which ones depends on a hash of their doc_id alone.
SAMPLE = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int = SAMPLE) -> DataFrame:
    """(text, label): each different text once, with the larger label if its copies disagree.

    Only rows of `labels` with an id, a 0/1 label and `learn` true count. At most `limit` of them are
    taken, so their ids may be broadcast.
    """
    few = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).select("doc_id", F.col(label).cast("int").alias("label"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(few), "doc_id").groupBy("text").agg(F.max("label").alias("label"))
