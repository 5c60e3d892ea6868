"""Text and Markdown files as a documents table, in batch or as a stream of new files."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprachwerk.functions import language, pii, structure
from sprachwerk.operators import kernels

SUFFIXES = "*.{txt,text,log,md,markdown}"
_CONVERTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
_RAW = "path string, modificationTime timestamp, length long, content binary"


@F.arrow_udf(T.StringType())
def _decoded(x: pa.Array) -> pa.Array:
    return pa.array([None if b is None else kernels.decode_text(b) for b in x.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _first_heading(x: pa.Array) -> pa.Array:
    def title(text: str | None) -> str | None:
        lines = (structure.kind_of(line) for line in (text or "").splitlines())
        return next((h[1] for h in lines if h and h[1]), None)

    return pa.array([title(t) for t in x.to_pylist()], pa.string())


def documents(files: DataFrame, metadata: bool = True) -> DataFrame:
    """files(path, content) → doc_id, source, title, language, text, metadata, error.

    Content is UTF-8 or else Windows-1252; what is neither has a null text and says so in error. The
    title is a Markdown file's first heading, else the file's name without its suffix. Spark reads
    no empty files, so they give no row.
    """
    rows = files.select("path", _decoded("content").alias("text"), F.lit(None).cast("string").alias("error"))
    marked = F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"\.(md|markdown)\z")
    told = _described(rows, F.when(marked, _first_heading("text")), metadata)
    return told.withColumn("error", F.when(F.col("text").isNull(), F.lit("neither UTF-8 nor Windows-1252"))).drop("_error")


def _described(rows: DataFrame, title: Column, metadata: bool = True) -> DataFrame:
    """rows(path, text, error) as documents, with `title` or else the file's name without its suffix.

    Metadata runs every recogniser; without it plans that build on the documents stay small.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", "")
    return rows.select(
        F.substring(F.sha2("path", 256), 1, 16).alias("doc_id"),
        F.col("path").alias("source"),
        F.coalesce(title, stem).alias("title"),
        language.detect(F.col("text")).alias("language"),
        "text",
        *([pii.metadata(F.col("text")).alias("metadata")] if metadata else []),
        F.col("error").alias("_error"),
    )


def read_with(spark: SparkSession, path: str, pattern: str, load: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """Documents of files that need a converter, such as "*.{pdf,docx}": load runs once in each worker and gives bytes → Markdown.

    A file that it fails on has a null text and the reason in error.
    """
    loaded: list[Callable[[bytes], str]] = []

    @F.arrow_udf(_CONVERTED)
    def convert(x: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(load())

        def one(raw: bytes | None) -> dict:
            try:
                return {"text": loaded[0](raw or b""), "error": None}
            except Exception as e:  # noqa: BLE001 - one broken file is told, not raised
                return {"text": None, "error": f"{type(e).__name__}: {e}"[:500]}

        return pa.array([one(b) for b in x.to_pylist()], pa.struct([("text", pa.string()), ("error", pa.string())]))

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    rows = found.select("path", convert("content").alias("c")).select("path", F.regexp_replace("c.text", "\r\n?", "\n").alias("text"), "c.error")
    told = _described(rows, _first_heading("text"))
    return told.withColumn("error", F.col("_error")).drop("_error")


def read(spark: SparkSession, path: str, metadata: bool = True) -> DataFrame:
    """Documents of a file or of a folder with its subfolders, by suffix in small letters."""
    return documents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SUFFIXES).load(path), metadata)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream: each file that appears under path once."""
    found = spark.readStream.format("binaryFile").schema(_RAW).option("recursiveFileLookup", "true").option("pathGlobFilter", SUFFIXES)
    return documents(found.option("maxFilesPerTrigger", files_per_batch).load(path))
