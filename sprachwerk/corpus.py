"""A corpus with everything that can be asked of it, in one object."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprachwerk.functions import classify, language, pii, security
from sprachwerk.operators import checks, evaluate, rag, retrieve, tables
from sprachwerk.sources import files


class GermanCorpus:
    """documents(doc_id, text[, title, source]) and what follows from their text as it is now.

    Nothing is kept from one call to the next, so what is built after `anonymize` never holds what was
    there before.
    """

    def __init__(self, documents: DataFrame, detectors: Iterable[pii.Detector] = ()):
        self.documents, self.detectors = documents, tuple(detectors)

    @classmethod
    def from_files(cls, spark: SparkSession, path: str) -> GermanCorpus:
        """Text and Markdown files of a folder; those that cannot be decoded are left out."""
        return cls(files.read(spark, path, metadata=False).where("error IS NULL"))

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: Iterable[str], title: str | None = None) -> GermanCorpus:
        return cls(spark.createDataFrame([(i, t, title) for i, t in enumerate(texts, 1)], "doc_id long, text string, title string"))

    def _with(self, name: str, value) -> DataFrame:
        return self.documents.select("doc_id", value.alias(name))

    def pii(self, least: float = 0.0) -> DataFrame:
        """doc_id and entities in reading order, a row each."""
        found = self._with("e", F.explode(pii.detect(F.col("text"), least, detectors=self.detectors)))
        return found.select("doc_id", "e.*")

    def anonymize(self, mode: str = "redact", key: str | None = None) -> GermanCorpus:
        """A corpus whose texts have their entities replaced. Titles are anonymised too, sources kept."""
        text = lambda c: pii.anonymize(c, pii.detect(c, detectors=self.detectors), mode, key)
        own = {"text": text(F.col("text"))} | ({"title": text(F.col("title"))} if "title" in self.documents.columns else {})
        return GermanCorpus(self.documents.withColumns(own), self.detectors)

    def scan(self) -> DataFrame:
        return self._with("s", security.scan(F.col("text"))).select("doc_id", "s.*")

    def kinds(self) -> DataFrame:
        return self._with("c", classify.classify(F.col("text"))).select("doc_id", "c.*")

    def languages(self) -> DataFrame:
        return self._with("language", language.detect(F.col("text")))

    def metadata(self) -> DataFrame:
        return self._with("metadata", pii.metadata(F.col("text")))

    def sections(self) -> DataFrame:
        return self._with("s", F.explode(tables.sections("text"))).select("doc_id", "s.*")

    def sentences(self) -> DataFrame:
        return self._with("s", F.explode(tables.sentences("text"))).select("doc_id", "s.*")

    def terminology(self) -> DataFrame:
        return checks.terminology(self.documents)

    def style(self) -> DataFrame:
        return checks.style(self.documents)

    def chunks(self, strategy: str = "structural", max_tokens: int = 512, overlap: int = 64) -> DataFrame:
        return tables.chunk(self.documents, strategy, max_tokens, overlap)

    def index(self, vector: bool = True, lexical: bool = True, **options) -> retrieve.Index:
        return retrieve.Index(self.chunks(**options), vector, lexical)

    def search(self, questions: DataFrame, top_k: int = 20) -> DataFrame:
        """questions(qid, question) → chunks in order, see `retrieve.Index.search`."""
        return self.index().search(questions, top_k)

    def ask(self, questions: DataFrame, top_k: int = 5, rerank: bool = False, model: Callable[[str, str], str] | None = None) -> DataFrame:
        return rag.ask(self.index(), questions, top_k, max(20, top_k), rerank, model)

    def evaluate(self, questions: DataFrame, top_k: int = 10, model: Callable[[str, str], str] | None = None) -> DataFrame:
        return evaluate.evaluate_rag(self.index(), questions, top_k, model=model)
