"""Training-order materialisation: token sequences at permuted places of fixed-stride binary shards.

Documents are dealt into streams by a hash of id and text, and each stream is put in order by that hash,
so what stands where depends on the rows alone and not on how the input is split. A first pass counts the
tokens of each stream; their sums give every sequence a dense index before any is built. A second pass
cuts the streams into sequences of one length, the last of a stream filled up. A keyed Feistel network
over the next even number of bits, walked on while it leaves the range, permutes indices into slots.
Slots are dealt by range: a task gets adjacent shards, each one file of equal records in order of slots,
written under another name and moved into place, so a rerun of a task replaces it by the same bytes.
Record r of shard s starts at byte r * stride: reads are sequential, and a reader resumes at any slot by
arithmetic alone.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprachwerk.llm.common import HOT_ROWS, HOT_SHARE, remove_path, scratch_path, table, written
from sprachwerk.llm.tokenize import default_vocabulary, word_ids

SEQUENCE_TOKENS = 4096
END_ID = 2
#: Bytes of a shard's file.
SHARD_BYTES = 256 << 20
#: Bytes of text that a stream has on average, up to the largest number of streams: their starts, 8 bytes each, go to every executor.
STREAM_BYTES, MOST_STREAMS = 32 << 20, 1 << 17
#: Tasks that write shards at most.
MOST_WRITERS = 20_000
#: Rows of one id and text that travel together where there are very many of them.
EQUAL_DOCS = 64
KEY = 20_240_229
ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _round_keys(key: int, rounds: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((np.arange(1, rounds + 1, dtype=np.uint64) + _U(key & (1 << 64) - 1)) * _U(0x9E3779B97F4A7C15))


def _pass(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left + k) & mask), left
        else:
            left, right = right, left ^ (_mix(right + k) & mask)
    return (left << _U(half)) | right


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS, back: bool = False) -> np.ndarray:
    """A bijection of 0 … n - 1; `back` undoes it. Domains are at most four times n, so walks are short."""
    if n <= 1:
        return np.zeros_like(index)
    half = ((n - 1).bit_length() + 1) // 2
    keys = _round_keys(key, rounds)
    with np.errstate(over="ignore"):
        x = _pass(index.astype(np.uint64), half, keys, back)
        out = np.flatnonzero(x >= _U(n))
        while len(out):
            x[out] = _pass(x[out], half, keys, back)
            out = out[x[out] >= _U(n)]
    return x.astype(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h, copies): rows with a hash of id and text. Rows that very many equal come as one for EQUAL_DOCS of them.

    The keys of such rows are looked for first; there are never more than HOT_SHARE, so their counts are
    small, and each of their parcels has a hash of its own.
    """
    own = F.xxhash64("doc_id", F.col("text").isNull(), F.col("text"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), own.alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "h").limit(HOT_SHARE).collect()
    if not counts:
        return rows.withColumn("copies", F.lit(1))
    first = rows.where(F.col("h").isin([r["h"] for r in counts])).groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    parcel = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL_DOCS)))
    parcels = first.withColumn("c", parcel).select("doc_id", "text", F.xxhash64("h", "c").alias("h"), F.least(F.lit(EQUAL_DOCS), F.col("n") - F.col("c") * EQUAL_DOCS).cast("int").alias("copies"))
    return rows.where(~F.col("h").isin([r["h"] for r in counts])).withColumn("copies", F.lit(1)).unionByName(parcels)


def _tokens(vocabulary: str):
    words = word_ids(vocabulary)
    if words.tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids of this vocabulary need more than 16 bits")
    end = np.array([END_ID], np.uint32)
    return lambda column: ((row, np.concatenate([tokens, end])) for row, tokens in words.rows(column))


def _stream_tokens(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(stream, tokens) of each stream that has documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for row, ids in tokens(batch.column(0)):
                n[row] = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n * batch.column(2).to_numpy())], names=["stream", "n"])

    return rows.select(F.col("text").cast("binary"), "stream", "copies").mapInArrow(count, "stream int, n long").groupBy("stream").agg(F.sum("n").alias("tokens"))


def _payloads(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(stream, h, doc_id, copies, payload): ids as unsigned 16-bit little-endian numbers, compressed for their ways."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pack = _tokens(vocabulary), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [b""] * batch.num_rows
            for row, ids in tokens(batch.column(4)):
                raw[row] = pack.compress(ids.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(raw, pa.binary())], names=["stream", "h", "doc_id", "copies", "payload"])

    return rows.select("stream", "h", "doc_id", "copies", F.col("text").cast("binary").alias("text")).mapInArrow(encode, "stream int, h long, doc_id long, copies int, payload binary")


def _sequences(ordered: DataFrame, starts, n: int, key: int, sequence_tokens: int) -> DataFrame:
    """(slot, idx, n_tokens, doc_ids, ids_crc32, payload) of streams whose rows come one after another, in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        stream, at, size = None, 0, 0
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        rows: list[tuple] = []

        def close() -> None:
            nonlocal held, ids, size, at
            tokens = np.concatenate(held)
            rows.append((at, len(tokens), ids, zlib.crc32(tokens.astype("<u4").tobytes()), pack.compress(tokens.tobytes())))
            held, ids, size, at = [], [], 0, at + 1

        def told() -> pa.RecordBatch:
            idx, n_tokens, doc_ids, crc, payload = zip(*rows, strict=True)
            rows.clear()
            own = np.array(idx, np.int64)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((permute(own, n, key), own, n_tokens, doc_ids, crc, payload), kinds, strict=True)], names=["slot", "idx", "n_tokens", "doc_ids", "ids_crc32", "payload"])

        for batch in batches:
            streams, doc_ids, copies, payloads = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for s, doc_id, some, raw in zip(streams, doc_ids, copies, payloads, strict=True):
                if s != stream:
                    if size:
                        close()
                    stream, at = s, int(starts.value[s])
                own = np.frombuffer(unpack.decompress(raw), "<u2")
                for _ in range(some):
                    tokens = own
                    while len(tokens):
                        part, tokens = tokens[: sequence_tokens - size], tokens[sequence_tokens - size :]
                        held.append(part)
                        ids.append(doc_id)
                        size += len(part)
                        if size == sequence_tokens:
                            close()
                if len(rows) >= 1024:
                    yield told()
        if size:
            close()
        if rows:
            yield told()

    return ordered.mapInArrow(cut, "slot long, idx long, n_tokens int, doc_ids array<bigint>, ids_crc32 long, payload binary")


def materialise(docs: DataFrame, path: str, vocabulary: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, shard_bytes: int = SHARD_BYTES, key: int = KEY, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """Write the shards under `path`, a folder that all executors share, and say where each sequence is.

    Returns a row per sequence: slot, idx, shard, record, n_tokens, doc_ids, ids_crc32. A record is
    sequence_tokens ids of two bytes, the last of a stream filled up with END_ID; n_tokens counts those
    before. A null text is an empty document, of END_ID alone. Repeated rows and null ids are documents
    like any other; further columns are left out. A very long text is held as one row, at two bytes a
    token. Of texts whose hashes tie, the order is that of their ids. An empty table writes a manifest
    only. The same rows give the same shards, however the input is split.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    streams = min(MOST_STREAMS, max(1, -(-size // stream_bytes)))
    rows = _keyed(docs).withColumn("stream", F.pmod("h", F.lit(streams)).cast("int"))
    tokens = np.zeros(streams, np.int64)
    for r in _stream_tokens(rows, vocabulary).collect():  # MOST_STREAMS rows at most
        tokens[r["stream"]] = r["tokens"]
    own = -(-tokens // sequence_tokens)
    n = int(own.sum())
    starts = spark.sparkContext.broadcast(np.cumsum(own) - own)
    ordered = _payloads(rows, vocabulary).repartition("stream").sortWithinPartitions("stream", "h", "doc_id")
    stride = 2 * sequence_tokens
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-n // per_shard))
    writers = min(MOST_WRITERS, shards)
    placed = _sequences(ordered, starts, n, key, sequence_tokens).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long")).withColumn("record", F.col("slot") % per_shard)
    # range partitions: a writer has adjacent shards, whole
    dealt = placed.select("shard", "record", "slot", "idx", "n_tokens", "doc_ids", "ids_crc32", "payload")
    dealt = dealt.repartitionById(writers, F.floor(F.col("shard") * writers / shards).cast("int")).sortWithinPartitions("shard", "record")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        unpack = zstandard.ZstdDecompressor()
        out, shard, name = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                files.move(name, f"{root}/shard-{shard:08d}.bin")

        try:
            for batch in batches:
                for s, raw in zip(batch.column(0).to_pylist(), batch.column(7).to_pylist(), strict=True):
                    if s != shard:
                        close()
                        out = None
                        shard, name = s, f"{root}/.shard-{s:08d}.{uuid.uuid4().hex}"
                        out = files.open_output_stream(name)
                    ids = unpack.decompress(raw)
                    out.write(ids + END_ID.to_bytes(2, "little") * ((stride - len(ids)) // 2))
                yield pa.RecordBatch.from_arrays(batch.columns[:7], names=batch.schema.names[:7])
            close()
            out = None
        finally:
            if out is not None:  # a failed attempt takes its file with it
                if not out.closed:
                    out.close()
                files.delete_file(name)

    told = written(dealt.mapInArrow(write, "shard long, record long, slot long, idx long, n_tokens int, doc_ids array<bigint>, ids_crc32 long"), "slots")
    _drop_unfinished(spark, path)
    manifest = json.dumps({"sequences": n, "sequence_tokens": sequence_tokens, "stride": stride, "per_shard": per_shard, "key": key, "rounds": ROUNDS, "dtype": "<u2", "end_id": END_ID})
    _write_text(spark, f"{path}/manifest.json", manifest)
    return told.select("slot", "idx", "shard", "record", "n_tokens", "doc_ids", "ids_crc32")


def _drop_unfinished(spark: SparkSession, path: str) -> None:
    """Delete what attempts left that were lost with their executor."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(p):
        for status in files.listStatus(p):
            if status.getPath().getName().startswith(".shard-"):
                remove_path(spark, status.getPath().toString())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_slots(path: str, start: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Sequences in training order from slot `start`: whole records, one shard after another."""
    files, root = pafs.FileSystem.from_uri(path)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        told = json.loads(f.read())
    end = told["sequences"] if count is None else min(told["sequences"], start + count)
    while start < end:
        shard, record = divmod(start, told["per_shard"])
        some = min(end - start, told["per_shard"] - record)
        with files.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(record * told["stride"])
            raw = f.read(some * told["stride"])
        yield from np.frombuffer(raw, told["dtype"]).reshape(some, -1)
        start += some


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards in a fresh folder, and the place of every sequence; edge cases as in `materialise`."""
    root = scratch_path(spark, "training-order")
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return materialise(table(spark, sf_dir, "documents"), root)
