"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document longer than a sequence is cut into full sequences and a rest; only rests and short
documents compete for bins. Pieces are dealt by a hash into groups of about `group_rows`, and each group
is packed by itself, so no task sees more than one group at a time and groups never depend on how the
input is split. Equal pieces, as of many equal rows, are counted first and dealt in parcels of
EQUAL_PIECES, each by a hash of its own, so no id or text can fill a group. Each group's largest waste is
its last few bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprachwerk.llm.common import chunked, table, written
from sprachwerk.llm.tokenize import default_vocabulary, word_ids

SEQUENCE_TOKENS = 4096
END_ID = 2
GROUP_ROWS = 4096
#: Equal pieces that go to one group together.
EQUAL_PIECES = 64
#: A group has fewer sequences than this, so group * SEQUENCES + sequence never clashes.
SEQUENCES = 1 << 32

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size. Equal sizes keep their order.

    The tree's inner nodes hold the largest room below them; a descent that prefers the left child
    finds the first bin with room in log(bins) steps.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, k = int(sizes[i]), 1
        if size > capacity:
            raise ValueError("a piece is larger than a sequence")
        while k < leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        bins[i], offsets[i] = k - leaves, capacity - tree[k]
        tree[k] -= size
        while k > 1:
            k //= 2
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
    return bins, offsets


def tokenized_pieces(docs: DataFrame, vocabulary: str, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece of each document: (doc_id, start, length, ids_crc32, doc_tokens).

    A null text is an empty one; every document ends with END_ID and so has one piece at least.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[] for _ in PIECE]
            for row, tokens in words.rows(batch.column(1)):
                tokens = np.concatenate([tokens, end])
                raw = tokens.astype("<u4").tobytes()
                for start in range(0, len(tokens), sequence_tokens):
                    length = min(sequence_tokens, len(tokens) - start)
                    for column, value in zip(out, (ids[row], start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(tokens)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECE, strict=True)], schema=PIECE)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Deal every token of documents(doc_id, text, …) into sequences of at most sequence_tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null and empty texts are documents of the end id alone. Repeated rows are packed as often as they
    come; rows with a null doc_id too, however many. A very long text is as many full sequences as it
    fills and a rest; its ids are held at once. Ties in size go by (doc_id, start, ids_crc32). Other
    columns are left out. An empty table gives no rows. Sequence ids are unique, not gapless.
    """
    pieces = written(tokenized_pieces(docs, vocabulary or default_vocabulary(), sequence_tokens), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = chunked(pieces, EQUAL_PIECES)
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64(*pieces.columns, "_c"), F.lit(groups)).cast("long")).drop("_c")
    capacity = sequence_tokens

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in PIECE.names])
        group = group.take(np.repeat(np.arange(group.num_rows), group["_n"].to_numpy()))
        sizes = group["length"].to_numpy()
        bins, offsets = first_fit_decreasing(sizes, capacity)
        first = int(group["_group"][0].as_py()) * SEQUENCES
        return group.select(PIECE.names).append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("_group").applyInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4,096 tokens, over the whole table; edge cases as in `pack`."""
    return pack(table(spark, sf_dir, "documents"))
