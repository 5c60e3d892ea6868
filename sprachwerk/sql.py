"""Names for SQL: scalar functions as SQL functions' bodies where Spark can hold them, else as Arrow functions, and table functions.

    register(spark)
    spark.sql("SELECT de_normalize_search(text) FROM documents")
    spark.sql("SELECT d.doc_id, s.* FROM documents d, LATERAL de_sentences(d.text) s")
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprachwerk.operators import kernels, tables
from sprachwerk.resources.fixed import GERMAN_MARKERS


@F.udtf(returnType="text string, start int, end int")
class Sentences:
    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from kernels.sentences(text or "")


@F.udtf(returnType="ordinal int, content string, section string, absatz string, paragraphs int")
class Chunks:
    def eval(self, text: str | None, max_tokens: int, overlap: int) -> Iterator[tuple]:
        for i, c in enumerate(kernels.chunks(text or "", None, "structural", max_tokens, overlap)):
            yield i, c["content"], c["section"], c["absatz"], c["paragraphs"]


@F.udtf(returnType="ord int, parent_ord int, level int, title string, content string")
class Sections:
    def eval(self, text: str | None) -> Iterator[tuple]:
        for s in kernels.sections(text or ""):
            yield s["ord"], s["parent_ord"], s["level"], s["title"], s["content"]


def _mapped(of, kind: T.DataType, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else of(t) for t in x.to_pylist()], arrow)

    return run


#: SQL bodies of functions that plain expressions can say.
BODIES = {
    "de_fold": "lower(replace(replace(replace(replace(replace(replace(replace(t, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss'))",
    "de_estimate_tokens": "cast(CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, ceil(length(t) / 4)) END AS int)",
    "de_has_german": f"exists(split(lower(t), '[^a-zäöüß]+'), w -> w IN ({', '.join(repr(w) for w in GERMAN_MARKERS)}))",
}


def register(spark: SparkSession) -> list[str]:
    """Make the names known to this session; returns them."""
    for name, body in BODIES.items():
        kind = {"de_estimate_tokens": "int", "de_has_german": "boolean"}.get(name, "string")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t string) RETURNS {kind} RETURN {body}")
    spark.udf.register("de_compound_parts", tables.compound_parts)
    spark.udf.register("de_decompound", tables.decompounded)
    spark.udf.register("de_expand_query", tables.expanded())
    spark.udf.register("de_normalize_search", _mapped(_search_form, T.StringType(), pa.string()))
    spark.udf.register("de_sentence_count", _mapped(lambda t: len(kernels.sentences(t)), T.IntegerType(), pa.int32()))
    for name, f in (("de_sentences", Sentences), ("de_chunks", Chunks), ("de_sections", Sections)):
        spark.udtf.register(name, f)
    return [*BODIES, "de_compound_parts", "de_decompound", "de_expand_query", "de_normalize_search", "de_sentence_count", "de_sentences", "de_chunks", "de_sections"]


def _search_form(text: str) -> str:
    return kernels.search_form(text)
