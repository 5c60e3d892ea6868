"""From raw documents to packed sequences: five stages, each a table written and read again.

Each stage takes documents (doc_id, text, lang, source, n_chars) as its predecessor kept them and
returns what it keeps with the same columns; the last returns pieces of packed sequences. Every stage takes
null, empty and very long texts, null and repeated ids, repeated rows, empty tables and further columns of
any name; what it does with them is said at its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprachwerk.llm import decontaminate, nearcopies, packing, quality, toxicity
from sprachwerk.llm.common import columns, discard, scratch, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; null and empty texts do. Each row is judged by its text alone."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, "_sw_toxicity")
    return scored.where(F.col("_sw_toxicity.score") < toxicity.THRESHOLD).select(*columns(docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the quality threshold; a null text is judged as an empty one. Without labels all are kept or none, by the constant share."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, "_sw_quality")
    return scored.where(F.col("_sw_quality") >= quality.THRESHOLD).select(*columns(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word shingles at Jaccard 0.8, the document of the least doc_id, null ids last.

    Found by op3's SimHash index, by min-hash beyond its distance; verified whole. Null and empty texts are one group.
    """
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; null and empty texts have none."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), "_sw_hits")
    return found.where(F.size("_sw_hits.spans") == 0).select(*columns(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences; a null text is an end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained models and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage left behind is deleted once its successor's input is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            done = written(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(done._sprachwerk_path)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
