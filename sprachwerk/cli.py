"""The command line: `python -m sprachwerk.cli VERB PATH …`, or the same after spark-submit. Every verb can write JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprachwerk.corpus import GermanCorpus
from sprachwerk.operators import checks, evaluate, retrieve
from sprachwerk.sources import files
from sprachwerk.sources.store import Store

Verb = Callable[[SparkSession, argparse.Namespace], DataFrame]
VERBS: dict[str, tuple[Verb, tuple[str, ...]]] = {}


def _verb(*options: str):
    def add(f: Verb) -> Verb:
        VERBS[f.__name__] = (f, options)
        return f

    return add


def _corpus(spark: SparkSession, a: argparse.Namespace) -> GermanCorpus:
    return GermanCorpus.from_files(spark, a.path)


def _named(df: DataFrame, corpus: GermanCorpus) -> DataFrame:
    return corpus.documents.select("doc_id", F.col("source").alias("file")).join(df, "doc_id").drop("doc_id")


def _asked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.createDataFrame([*enumerate(a.question, 1)], "qid int, question string")


@_verb()
def parse(spark, a):
    return files.read(spark, a.path)


@_verb("least")
def pii(spark, a):
    corpus = _corpus(spark, a)
    return _named(corpus.pii(a.least), corpus)


@_verb("mode", "key")
def anonymize(spark, a):
    return _corpus(spark, a).anonymize(a.mode, a.key).documents.select("source", "text")


@_verb()
def scan(spark, a):
    corpus = _corpus(spark, a)
    return _named(corpus.scan(), corpus)


@_verb()
def classify(spark, a):
    corpus = _corpus(spark, a)
    return _named(corpus.kinds(), corpus)


@_verb()
def terminology(spark, a):
    corpus = _corpus(spark, a)
    return _named(checks.inconsistencies(corpus.terminology()), corpus)


@_verb()
def style(spark, a):
    corpus = _corpus(spark, a)
    return _named(corpus.style(), corpus)


@_verb("strategy", "max_tokens", "overlap")
def chunk(spark, a):
    return _corpus(spark, a).chunks(a.strategy, a.max_tokens, a.overlap)


@_verb("model")
def embed(spark, a):
    return retrieve.embed(_corpus(spark, a).chunks(), name=a.model)


@_verb("question", "top_k")
def search(spark, a):
    found = _corpus(spark, a).search(_asked(spark, a), a.top_k)
    return found.select("qid", "rank", "score", "document", "section", "content").orderBy("qid", "rank")


@_verb("question", "top_k")
def ask(spark, a):
    return _corpus(spark, a).ask(_asked(spark, a), a.top_k)


@_verb("store")
def ingest(spark, a):
    corpus, store = _corpus(spark, a), Store(spark, a.store)
    store.upsert("documents", corpus.documents.drop("error"))
    store.upsert("chunks", corpus.chunks())
    return spark.createDataFrame([(t, store.read(t).count()) for t in ("documents", "chunks")], "name string, rows long")


@_verb("dataset", "top_k")
def evaluation(spark, a):
    return _corpus(spark, a).evaluate(evaluate.read_cases(spark, a.dataset), a.top_k)


@_verb()
def benchmark(spark, a):
    told = evaluate.benchmark(_corpus(spark, a).documents)
    return spark.createDataFrame([(json.dumps(told),)], "report string")


OPTIONS = {
    "least": {"type": float, "default": 0.0},
    "mode": {"default": "redact", "choices": ("redact", "replace", "mask", "hash", "pseudonymize")},
    "key": {},
    "strategy": {"default": "structural", "choices": ("structural", "fixed")},
    "max_tokens": {"type": int, "default": 512},
    "overlap": {"type": int, "default": 64},
    "model": {"default": "hashing"},
    "question": {"action": "append", "required": True},
    "top_k": {"type": int, "default": 5},
    "store": {"required": True},
    "dataset": {"required": True},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sprachwerk")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, (_, options) in VERBS.items():
        own = verbs.add_parser(name)
        own.add_argument("path", help="a file, or a folder with its subfolders")
        own.add_argument("-o", "--output", help="a folder for JSON lines; without it rows are printed")
        for o in options:
            own.add_argument(f"--{o.replace('_', '-')}", **OPTIONS[o])
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sprachwerk").getOrCreate()
    try:
        rows = VERBS[a.verb][0](spark, a)
        if a.output:
            rows.write.mode("overwrite").json(a.output)
        else:
            for line in rows.toJSON().toLocalIterator():
                print(line)
    except (ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
