"""Plain functions over single texts for assistants and services: dictionaries in, dictionaries out.

Each runs its operator over a table of one row, so it says what the operator says. Errors that a caller
can mend come back as {"error": …}.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

from sprachwerk.corpus import GermanCorpus
from sprachwerk.operators import evaluate, tables
from sprachwerk.sources import files

TOOLS: dict[str, Callable] = {}


def _tool(f: Callable) -> Callable:
    @wraps(f)
    def run(*args, **options):
        try:
            return f(*args, **options)
        except (ValueError, KeyError, FileNotFoundError) as e:
            return {"error": str(e)}

    TOOLS[f.__name__] = run
    return run


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


@_tool
def parse_document(spark: SparkSession, path: str) -> dict:
    rows = _rows(files.read(spark, path))
    if not rows:
        raise FileNotFoundError(f"nothing to read at {path}")
    return rows[0] | {"sections": _rows(GermanCorpus.from_files(spark, path).sections())}


@_tool
def detect_pii(spark: SparkSession, text: str, least: float = 0.0) -> dict:
    return {"entities": _rows(GermanCorpus.from_texts(spark, [text]).pii(least).drop("doc_id"))}


@_tool
def anonymize(spark: SparkSession, text: str, mode: str = "redact", key: str | None = None) -> dict:
    return {"text": GermanCorpus.from_texts(spark, [text]).anonymize(mode, key).documents.first()["text"]}


@_tool
def scan(spark: SparkSession, text: str) -> dict:
    return _rows(GermanCorpus.from_texts(spark, [text]).scan().drop("doc_id"))[0]


@_tool
def analyze_text(spark: SparkSession, text: str) -> dict:
    return _rows(tables.analyze(GermanCorpus.from_texts(spark, [text]).documents).drop("doc_id"))[0]


@_tool
def search(spark: SparkSession, folder: str, question: str, top_k: int = 5) -> dict:
    asked = spark.createDataFrame([(1, question)], "qid int, question string")
    found = GermanCorpus.from_files(spark, folder).search(asked, top_k).orderBy("rank")
    return {"results": _rows(found.select("rank", "score", "document", "section", "content"))}


@_tool
def evaluate_search(spark: SparkSession, folder: str, dataset: str, top_k: int = 10) -> dict:
    questions = evaluate.read_cases(spark, dataset)
    return _rows(evaluate.evaluate_retriever(GermanCorpus.from_files(spark, folder).index(), questions, top_k))[0]


def describe() -> list[dict]:
    """Name and parameters of each tool, as a server announces them."""
    import inspect

    return [{"name": n, "parameters": [p for p in inspect.signature(f).parameters if p != "spark"]} for n, f in TOOLS.items()]


def call(spark: SparkSession, name: str, **options) -> dict:
    return TOOLS[name](spark, **options) if name in TOOLS else {"error": f"no tool {name!r}; one of {', '.join(TOOLS)}"}


__all__ = ["TOOLS", "call", "describe", *TOOLS]
