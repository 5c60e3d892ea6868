"""Retrieval and answer quality as aggregations over ranked results and expected sources."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprachwerk import resources
from sprachwerk.operators import kernels, rag, retrieve, tables

KS = (1, 5, 10)


def relevance(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """results(qid, rank, identity) with `source`, the first expectation it meets, or null.

    identity is 'document#section' in small letters; an expectation without # meets any section.
    """
    return _judged(results.join(_expected(qrels), "qid", "left")).drop("_wanted")


def _expected(qrels: DataFrame) -> DataFrame:
    """(qid, _wanted): each question's expectations as one list in their order."""
    return qrels.select("qid", F.struct("ord", F.lower(F.trim("source")).alias("source")).alias("w")).groupBy("qid").agg(F.sort_array(F.collect_list("w")).alias("_wanted"))


def _judged(rows: DataFrame) -> DataFrame:
    """Results beside `_wanted` with `source`. A question has a few expectations, so they are one list, and results are moved once, by qid."""
    file = F.substring_index("identity", "#", 1)
    meets = lambda w: (w["source"] == F.col("identity")) | (~w["source"].contains("#") & (w["source"] == file))
    return rows.withColumn("source", F.get(F.filter("_wanted", meets), F.lit(0))["source"])


def per_question(results: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Per question: recall, precision, hit rate and nDCG at each k, and the reciprocal rank."""
    sources = F.array_distinct(F.filter(F.transform("_wanted", lambda w: w["source"]), lambda s: s.isNotNull()))
    expected = _expected(qrels).withColumn("n_relevant", F.size(sources))
    judged = _judged(expected.join(results, "qid", "left"))
    gain = F.when(F.col("source").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    aggs = [F.min(F.when(F.col("source").isNotNull(), F.col("rank"))).alias("first")]
    for k in ks:
        top = F.col("rank") <= k
        # sets of at most k; distinct counts would move each row once more for each of them
        aggs += [F.size(F.collect_set(F.when(top, F.col("source")))).alias(f"hits_{k}"), F.size(F.collect_set(F.when(top, F.col("identity")))).alias(f"seen_{k}"), F.sum(F.when(top, gain).otherwise(0.0)).alias(f"dcg_{k}")]
    rows = judged.groupBy("qid", "n_relevant").agg(*aggs)
    out = [F.col("qid"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.col("first").isNull().alias("unanswered")]
    for k in ks:
        hits = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
        out += [
            (hits / F.col("n_relevant")).alias(f"recall_{k}"),
            F.when(F.col(f"seen_{k}") > 0, hits / F.col(f"seen_{k}")).otherwise(0.0).alias(f"precision_{k}"),
            (hits > 0).cast("double").alias(f"hit_rate_{k}"),
            F.coalesce(F.col(f"dcg_{k}") / ideal, F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    return rows.select(*out)


def report(questions: DataFrame) -> DataFrame:
    """Means over questions, 0 without any; how many had no relevant hit."""
    own = [c for c in questions.columns if c not in ("qid", "unanswered")]
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("mrr" if c == "reciprocal_rank" else c) for c in own]
    return questions.agg(*means, F.coalesce(F.sum(F.col("unanswered").cast("long")), F.lit(0)).alias("unanswered"))


def percentiles(rows: DataFrame, value: str, by: list[str], at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact percentiles by linear interpolation."""
    return rows.groupBy(*by).agg(*[F.round(F.percentile(value, F.lit(p)), 6).alias(f"p{round(100 * p)}") for p in at])


def reciprocal_ranks(rows: DataFrame) -> DataFrame:
    """Position of each row in its question, for callers that hold scores only."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "identity")))


# ---- datasets of questions ----
CASES = "qid int, question string, expected_sources array<string>, reference_answer string, category string, difficulty string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from a JSON file {"name": …, "cases": [{question, expected_sources, …}]}, numbered from 1 in the order of the file.

    A case without a question or an expected source is an error, and so is a file without cases.
    """
    raw = spark.read.text(path, wholetext=True).first()
    return cases(spark, json.loads(raw[0])["cases"] if raw else [])


def cases(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    own = [(i, r.get("question"), list(r.get("expected_sources") or ()), r.get("reference_answer"), r.get("category"), r.get("difficulty")) for i, r in enumerate(rows, 1)]
    if not own or any(not q or not sources for _, q, sources, *_ in own):
        raise ValueError("every case needs a question and an expected source, and a dataset a case")
    return spark.createDataFrame(own, CASES)


def qrels(questions: DataFrame) -> DataFrame:
    """(qid, ord, source) of cases with expected_sources."""
    return questions.select("qid", F.posexplode("expected_sources").alias("ord", "source"))


def identity(document: Column, section: Column) -> Column:
    """How a chunk is named in expectations: document#section in small letters, or the document alone."""
    named = F.nullif(F.trim(F.coalesce(section, F.lit(""))), F.lit(""))
    return F.lower(F.concat_ws("#", document, named))


# ---- answers ----
_SHARES = T.StructType([T.StructField("groundedness", T.DoubleType()), T.StructField("relevance", T.DoubleType())])


def _share(of: frozenset[str], within: frozenset[str]) -> float:
    return len(of & within) / len(of) if of else 0.0


def _shares():
    """A function of question, answer and context: groundedness and relevance, see `answer_quality`."""
    stop = frozenset(kernels.fold(w) for w in resources.lines("stopwords.txt"))
    kept = kernels.Kept(lambda word: frozenset(kernels.grown(word)) - stop)

    def terms(text: str | None) -> frozenset[str]:
        return frozenset().union(*(kept[w] for w in dict.fromkeys(kernels.search_words(text))))

    @F.arrow_udf(_SHARES)
    def run(question: pa.Array, answer: pa.Array, context: pa.Array) -> pa.Array:
        q, a, c = (map(terms, x) for x in (_plain(question), _plain(answer), _plain(context)))
        both = [(_share(a, c), _share(q, a)) for q, a, c in zip(q, a, c, strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in both], pa.float64()) for i in (0, 1)], names=["groundedness", "relevance"])

    return run


def _plain(x: pa.Array) -> Iterable[str | None]:
    return (v.as_py() for v in x)


def answer_quality(answers: DataFrame) -> DataFrame:
    """answers(qid, question, answer, contexts) → qid, present, groundedness, relevance, coverage.

    Groundedness is the share of the answer's content terms that its contexts hold, relevance that of the
    question's terms which the answer holds; no terms give 0. Coverage is the share of sentences with a source.
    Each row is told from itself: no term leaves its row.
    """
    joined = answers.select("qid", "question", F.coalesce("answer", F.lit("")).alias("answer"), F.array_join("contexts", "\n").alias("context"))
    shares = _shares()("question", "answer", "context")
    own = joined.select("qid", (F.trim("answer") != "").cast("double").alias("present"), shares.alias("s"), rag.citation_coverage(F.col("answer")).alias("coverage"))
    return own.select("qid", "present", "s.groundedness", "s.relevance", "coverage")


def evaluate_retriever(index: retrieve.Index, questions: DataFrame, top_k: int = 10, ks: tuple[int, ...] = KS) -> DataFrame:
    """The report of a search over cases (see `cases`): one batched search, then `report`."""
    found = index.search(questions, top_k).select("qid", "rank", identity(F.col("document"), F.col("section")).alias("identity"))
    return report(per_question(found, qrels(questions), ks))


def evaluate_rag(index: retrieve.Index, questions: DataFrame, top_k: int = 10, ks: tuple[int, ...] = KS, model: Callable[[str, str], str] | None = None) -> DataFrame:
    """Search and answers in one row: what `report` tells, and the means of `answer_quality` over all cases.

    citation_validity is the share of answers without an unknown source, of those that a model wrote; 1
    without a model.
    """
    found = index.search(questions, top_k).select("qid", "rank", "content", identity(F.col("document"), F.col("section")).alias("identity"))
    search = report(per_question(found.drop("content"), qrels(questions), ks))
    told = rag.ask(index, questions, top_k, max(20, top_k), model=model)
    contexts = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contexts"))
    answers = questions.select("qid", "question").join(told, "qid").join(contexts, "qid", "left").withColumn("contexts", F.coalesce("contexts", F.expr("cast(array() as array<string>)")))
    quality = answer_quality(answers).agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for c, n in (("present", "answer_presence"), ("groundedness", "groundedness"), ("coverage", "citation_coverage"), ("relevance", "answer_relevance"))])
    valid = told.agg(F.coalesce(F.avg((F.size("report.unknown") == 0).cast("double")), F.lit(1.0)).alias("citation_validity")) if model else questions.agg(F.lit(1.0).alias("citation_validity"))
    return search.crossJoin(quality).crossJoin(valid)  # one row each


JUDGE = "Prüfe die Antwort an den Quellen. Gib nur ein JSON-Objekt zurück: faithfulness (0 bis 1, ob die Quellen jede Aussage decken), relevance (0 bis 1, ob die Frage beantwortet ist), reason (ein kurzer Satz)."
VERDICT = "faithfulness double, relevance double, reason string"


def verdict(reply: Column) -> Column:
    """struct(faithfulness, relevance, reason, error) of a model's reply: its JSON object, from the first brace to the last.

    No object, no valid JSON, and shares that are missing or outside 0 to 1 are errors, never verdicts.
    """
    block = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    own = F.from_json(block, VERDICT, {"mode": "PERMISSIVE"})
    bad = own.isNull() | own["faithfulness"].isNull() | own["relevance"].isNull() | ~own["faithfulness"].between(0, 1) | ~own["relevance"].between(0, 1)
    error = F.when(block == "", "no JSON object").when(F.coalesce(bad, F.lit(True)), "no valid verdict")
    keep = lambda name: F.when(error.isNull(), own[name]).alias(name)
    return F.struct(keep("faithfulness"), keep("relevance"), keep("reason"), error.alias("error"))


def judge(answers: DataFrame, model: Callable[[str, str], str]) -> DataFrame:
    """answers(qid, question, answer, contexts) → qid and the verdict of model(system, prompt), one call an answer."""

    @F.arrow_udf("string")
    def asked(x: pa.Array) -> pa.Array:
        return pa.array([model(JUDGE, p) for p in x.to_pylist()], pa.string())

    prompt = F.concat(F.lit("Quellen:\n\n"), F.array_join("contexts", "\n\n"), F.lit("\n\nFrage: "), F.trim("question"), F.lit("\n\nAntwort: "), F.trim(F.coalesce("answer", F.lit(""))))
    return answers.select("qid", asked(prompt).alias("reply")).select("qid", verdict(F.col("reply")).alias("v")).select("qid", "v.*")


# ---- measurements ----
def compare_embeddings(chunks: DataFrame, questions: DataFrame, models: Iterable[str], top_k: int = 10, ks: tuple[int, ...] = KS) -> DataFrame:
    """A row per model: its means as in `report`, seconds, or the error for which it could not be loaded."""
    spark, rows = chunks.sparkSession, None
    texts = chunks.select("chunk_id", "document", "section", "index_text")
    for name in models:
        began, error = time.perf_counter(), None
        try:
            own, asked = (retrieve.embed(df, text, name, key).cache() for df, text, key in ((texts, "index_text", "chunk_id"), (questions, "question", "qid")))
            own.count(), asked.count()
        except Exception as e:  # noqa: BLE001 - a model that does not load is a result here
            error = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
        if error is None:
            indexed = time.perf_counter()
            scored = retrieve.top(retrieve.vector_scores(asked, own), top_k)
            found = scored.join(texts, "chunk_id").select("qid", "rank", identity(F.col("document"), F.col("section")).alias("identity"))
            told = report(per_question(found, qrels(questions), ks)).first().asDict()
            line = spark.createDataFrame([(name, round(indexed - began, 3), round(time.perf_counter() - indexed, 3), None, json.dumps(told))], "model string, index_seconds double, query_seconds double, error string, report string")
            own.unpersist(), asked.unpersist()
        else:
            line = spark.createDataFrame([(name, None, None, error, None)], "model string, index_seconds double, query_seconds double, error string, report string")
        rows = line if rows is None else rows.unionByName(line)
    return rows


def benchmark(docs: DataFrame, questions: DataFrame | None = None, max_tokens: int = 512) -> dict[str, float]:
    """Seconds of each step over docs(doc_id, text, …), forced by a sink that keeps nothing, and rates."""
    took: dict[str, float] = {}

    def timed(name: str, df: DataFrame) -> None:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 4)

    n = docs.count()
    timed("parse_seconds", tables.analyze(docs))
    chunks = tables.chunk(docs, max_tokens=max_tokens)
    timed("chunk_seconds", chunks)
    timed("embed_seconds", retrieve.embed(chunks))
    told: dict[str, float] = {"documents": n, "chunks": chunks.count(), **took}
    if questions is not None:
        timed("query_seconds", retrieve.Index(chunks).search(questions, 5))
        told |= {"query_seconds": took["query_seconds"], "queries": questions.count()}
    told["documents_per_second"] = round(n / max(took["parse_seconds"] + took["chunk_seconds"], 1e-9), 2)
    told["chunks_per_second"] = round(told["chunks"] / max(took["chunk_seconds"] + took["embed_seconds"], 1e-9), 2)
    return told
