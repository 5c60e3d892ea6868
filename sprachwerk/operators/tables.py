"""Table-valued text operators: sentences, sections, chunks, and forms that need the lexicon."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprachwerk.functions import text as tx
from sprachwerk.operators import kernels


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


# as objects, not as text: workers import this module, and have no session to parse types with
_S, _I, _L = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
SENTENCES = _rows(text=_S, start=_I, end=_I)
SECTIONS = _rows(ord=_I, parent_ord=_I, level=_I, title=_S, path=_L, content=_S)
COMPOUNDS = _rows(word=_S, parts=_L)
CHUNKS = _rows(content=_S, section=_S, section_path=_L, absatz=_S, paragraphs=_I)

_SPAN = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SECTION = pa.list_(pa.struct([("ord", pa.int32()), ("parent_ord", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("path", pa.list_(pa.string())), ("content", pa.string())]))
_CHUNK = pa.list_(pa.struct([("content", pa.string()), ("section", pa.string()), ("section_path", pa.list_(pa.string())), ("absatz", pa.string()), ("paragraphs", pa.int32())]))


#: Characters of text whose results a worker holds as Python's objects at once, many times the size of Arrow's.
SLICE = 1 << 18


def sliced(x: pa.Array, of: Callable, kind: pa.DataType, *more: pa.Array) -> pa.Array:
    """of(value, …) of each row. Rows become Python's objects and Arrow's again a slice at a time, so a worker's memory is that of Arrow's batch."""
    done, rows, held = [], [], 0
    for values in zip(x, *more, strict=True):
        own = [v.as_py() for v in values]
        rows.append(of(*own))
        held += len(own[0] or "")
        if held >= SLICE:
            done.append(pa.array(rows, kind))
            rows, held = [], 0
    return pa.concat_arrays([*done, pa.array(rows, kind)])


def _each(x: pa.Array, of: Callable, kind: pa.DataType) -> pa.Array:
    return sliced(x, lambda t: None if t is None else of(t), kind)


@F.arrow_udf(SENTENCES)
def sentences(x: pa.Array) -> pa.Array:
    return _each(x, lambda t: [{"text": s, "start": a, "end": b} for s, a, b in kernels.sentences(t)], _SPAN)


@F.arrow_udf(_I)
def sentence_count(x: pa.Array) -> pa.Array:
    """How many sentences a text has; none is kept, so only numbers go back."""
    return _each(x, lambda t: len(kernels.sentences(t)), pa.int32())


@F.arrow_udf(SECTIONS)
def sections(x: pa.Array) -> pa.Array:
    return _each(x, kernels.sections, _SECTION)


@F.arrow_udf(_L)
def compound_parts(x: pa.Array) -> pa.Array:
    return _each(x, kernels.compound, pa.list_(pa.string()))


@F.arrow_udf(_S)
def _complete(x: pa.Array) -> pa.Array:
    return _each(x, kernels.complete, pa.string())


@F.arrow_udf(_S)
def decompounded(x: pa.Array) -> pa.Array:
    """Texts with compounds as their parts."""
    return _each(x, kernels.decompound, pa.string())


def expanded(glossary: dict[str, tuple[str, ...]] | None = None, most: int = 12):
    """An expression maker: a query's words, compound parts and synonyms as an array."""

    @F.arrow_udf(_L)
    def run(x: pa.Array) -> pa.Array:
        return _each(x, lambda q: kernels.expand(q, glossary, None, most), pa.list_(pa.string()))

    return run


def analyze(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with what a first look asks for: sentences, the search form, and the compounds as (word, parts)."""

    @F.arrow_udf(COMPOUNDS)
    def split(x: pa.Array) -> pa.Array:
        def found(text: str) -> list[dict]:
            each = ((w, kernels.compound(w)) for w in dict.fromkeys(kernels.words(text)))
            return [{"word": w, "parts": p} for w, p in each if len(p) > 1]

        return _each(x, found, pa.list_(pa.struct([("word", pa.string()), ("parts", pa.list_(pa.string()))])))

    return docs.select("doc_id", sentences("text").alias("sentences"), search_form(F.col("text")).alias("search_form"), split("text").alias("compounds"))


def chunk_text(spark: SparkSession, text: str, title: str | None = None, **options) -> DataFrame:
    """The chunks of one text that is no table's."""
    return chunk(spark.createDataFrame([("text", text, title)], "doc_id string, text string, title string"), **options)


def completed(text: Column) -> Column:
    """Suspended hyphens resolved; texts without one never reach Python's kernel with their content."""
    plain = tx.dashes(tx.unicode_form(text))
    return F.coalesce(_complete(F.when(plain.rlike(r"-\s+(und|oder|bzw)"), plain)), plain)


def search_form(text: Column) -> Column:
    return tx.search_form(text, completed(text))


def chunk(docs: DataFrame, strategy: str = "structural", max_tokens: int = 512, overlap: int = 64, keep: Iterable[str] = ()) -> DataFrame:
    """docs(doc_id, text[, title, source, …]) → chunk_id, doc_id, ordinal, content, section, … one row a chunk.

    Null and blank texts give no chunk. chunk_id depends on doc_id and ordinal alone. keep names columns of
    docs that are told with each chunk.
    """
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if strategy not in ("structural", "fixed"):
        raise ValueError(f"unknown strategy {strategy!r}")

    @F.arrow_udf(CHUNKS)
    def cut(x: pa.Array, title: pa.Array) -> pa.Array:
        return sliced(x, lambda t, n: kernels.chunks(t or "", n, strategy, max_tokens, overlap), _CHUNK, title)

    title = F.col("title") if "title" in docs.columns else F.lit(None).cast("string")
    name = document_name(docs)
    rows = docs.select("doc_id", *keep, name.alias("document"), F.posexplode(cut(F.coalesce("text", F.lit("")), title)).alias("ordinal", "c"))
    key = F.substring(F.sha2(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")), 256), 1, 16)
    return rows.select(
        F.concat(F.lit("chk_"), key).alias("chunk_id"),
        "doc_id",
        "ordinal",
        "c.content",
        "c.section",
        "c.section_path",
        "c.absatz",
        F.lit(None).cast("int").alias("page"),
        "document",
        "c.paragraphs",
        F.concat_ws("\n", F.nullif(F.col("c.section"), F.lit("")), F.col("c.content")).alias("index_text"),
        *keep,
    )


def document_name(docs: DataFrame) -> Column:
    """The last part of the source, else the title, else the id."""
    parts = [F.col("doc_id").cast("string")]
    if "title" in docs.columns:
        parts.insert(0, F.nullif(F.col("title"), F.lit("")))
    if "source" in docs.columns:
        last = F.element_at(F.split(F.regexp_replace("source", r"\\", "/"), "/"), -1)
        parts.insert(0, F.when((last != "") & ~last.startswith("<"), last))
    return F.coalesce(*parts)


def naive_chunks(docs: DataFrame, width: int = 140) -> DataFrame:
    """Pieces of `width` characters, the baseline that knows no structure."""
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / width).cast("int") - 1, F.lit(0)))
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(at).alias("ordinal"))
    return rows.select("doc_id", "ordinal", F.substring("text", F.col("ordinal") * width + 1, F.lit(width)).alias("content"))


def search_tokens(text: Column) -> Column:
    """The words of a text's search form, in order, with repeats."""
    return F.filter(F.split(search_form(text), " |\n"), lambda w: w != "")


def search_terms(rows: DataFrame, key: str, text: str, expand: bool = True) -> DataFrame:
    """(key, term): search tokens with multiplicity; with expand also compound parts and then stems.

    The compound kernel sees each different word once; parts and stems come back by a join.
    """
    # outer, so that no filter that looks at the terms is inferred, which would cut every text twice
    words = rows.select(key, F.explode_outer(search_tokens(F.col(text))).alias("term")).where("term IS NOT NULL")
    if not expand:
        return words
    vocabulary = words.select("term").distinct().withColumn("parts", compound_parts("term"))
    parts = F.when(F.size("parts") > 1, F.transform("parts", F.lower)).otherwise(F.expr("cast(array() as array<string>)"))
    own = F.concat(F.array("term"), parts)
    grown = vocabulary.select("term", F.concat(own, F.filter(F.transform(own, tx.light_stem), lambda s: s.isNotNull())).alias("every"))
    return words.join(grown, "term").select(key, F.explode("every").alias("term"))


def content_terms(terms: DataFrame) -> DataFrame:
    from sprachwerk import resources

    return terms.where(~F.col("term").isin(*sorted({kernels.fold(w) for w in resources.lines("stopwords.txt")})))
