"""Near copies of documents: SimHash by `simhash`, min-hash for pairs beyond its distance, verified by exact Jaccard.

Each distinct set of shingles is a node with a SimHash fingerprint and 128 minima. Fingerprints go through
the steps of `simhash`: postings of byte positions, a tally of shared bytes, the guaranteed minimum, then
bits; components over its links are groups of nodes. At similarity 0.8 fingerprints differ in 9.7 of 64
bits on average, more than byte positions can guarantee, so nodes that no link has joined meet by their
minima as well: those that agree in a band of four minima meet in a list, where four bits of each minimum,
64 bytes a node, rule out pairs that are far below the line. Groups and what is left join nodes to
clusters. Two sets of similarity 0.8 share none of the 32 bands with
probability 5e-8 and are ruled out by the bits with less than 1e-6. Only sets in clusters are built
again, meet once inside their cluster and are compared whole; only pairs that reach the similarity
are linked, so no estimate enters a class.

Lists and clusters beyond their size are cut into parts that meet two by two, as in `simhash`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprachwerk.llm.common import discard, join_hot, written
from sprachwerk.llm.simhash import SEED, cells, components, links, majority, one_per_class, row_key

WORDS = 5
SIMILARITY = 0.8
#: Bits in which fingerprints of one link differ at most: three of their eight bytes are surely equal, a list has two.
DISTANCE = 5
BANDS, PER_BAND = 32, 4
#: Of 128 pieces of four bits, as many as must agree; sets of similarity 0.8 agree in 104 on average.
AGREE = 80
#: Nodes of a list, and sets of a cluster, that one task compares with each other.
LIST, SETS = 2048, 512

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 64, BANDS * PER_BAND, np.uint64)
_TIMES = _rng.integers(0, 1 << 64, BANDS * PER_BAND, np.uint64) | np.uint64(1)
_ONES = np.uint64(0x1111111111111111)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's different shingles, ascending; a shorter text is one shingle, an empty one has none."""
    own = text.lower().split()
    n = len(own)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(b" ".join(own), SEED)] if n else [], np.uint64)
    line = b" ".join(own)
    length = np.fromiter(map(len, own), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: n - words + 1].tolist()
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, n - words + 1))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each permuted view of the hashes."""
    out = np.full(len(_XOR), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(out, ((hashes[None, at : at + 2048] ^ _XOR[:, None]) * _TIMES[:, None]).min(1), out=out)
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, fp, bits, bands) of each row; fp as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, bits, bands = [], [], [], []
            for t in batch.column(2):
                own = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"")
                low = minima(own)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fps.append(majority(own))
                # low bits of a minimum are as good as random; high ones are all near 0
                four = (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(np.uint8)
                bits.append((four[::2] | four[1::2] << 4).tobytes())
                bands.append([xxhash.xxh64_intdigest(low[i : i + PER_BAND].tobytes(), i) for i in range(0, len(low), PER_BAND)])
            flat = np.array(bands, np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(flat))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, pa.array(bits, pa.binary()), lists], names=["doc_id", "row", "node", "fp", "bits", "bands"])

    rows = docs.select("doc_id", row_key().alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, row long, node long, fp long, bits binary, bands array<long>")


def simhash_groups(nodes: DataFrame) -> DataFrame:
    """nodes(node, fp, …), a table, with `group`: equal for nodes that are reachable over fingerprints of DISTANCE bits or fewer."""
    fps = written(nodes.select("fp").distinct(), "fingerprints")
    root = components(links(fps, DISTANCE))
    discard(fps)
    found = join_hot(nodes, root.select(F.col("node").alias("fp"), "root"), ["fp"], "left")
    return found.withColumn("group", F.coalesce("root", "fp")).drop("root")


def _linked(own: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links between rows that, with what equal `own` joins at first, reach as far as all near pairs; pairs joined already are not compared."""
    n, own = len(own), own.copy()
    out = []
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(own[i + 1 :] != own[i])
        if not len(rest):
            if (own == own[i]).all():
                break
            continue
        for j in rest[near(i, rest)].tolist():
            if own[j] != own[i]:
                own[own == own[j]] = own[i]
                out.append((i, j))
    return out


def _compared(dealt: DataFrame, value: str, near_in: Callable[[pa.Array], Callable[[int, np.ndarray], np.ndarray]], known: str = "node") -> DataFrame:
    """(u, v) of the near rows in each cell; rows that are equal in `known` count as joined."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def told(rows: pa.Table) -> pa.RecordBatch:
            cell, node, joined = (rows[c].to_numpy() for c in ("cell", "node", "joined"))
            values = rows[value].combine_chunks()
            edge = np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))
            pairs = set()
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a > 1:
                    pairs |= {(int(node[a + i]), int(node[a + j])) for i, j in _linked(joined[a:b], near_in(values.slice(a, b - a)))}
            both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

        for batch in batches:
            own = pa.Table.from_batches([batch])
            own = own if rest is None else pa.concat_tables([rest, own])
            if not own.num_rows:
                continue
            cell = own["cell"].to_numpy()
            whole = int(np.flatnonzero(cell == cell[-1])[0])  # the last cell may go on
            if whole:
                yield told(own.slice(0, whole))
            rest = own.slice(whole)
        if rest is not None and rest.num_rows:
            yield told(rest)

    dealt = dealt.select("cell", "node", value, F.col(known).alias("joined")).repartition("cell").sortWithinPartitions("cell", "node")
    return dealt.mapInArrow(compare, "u long, v long")


def _near_bits(values: pa.Array) -> Callable[[int, np.ndarray], np.ndarray]:
    pieces = np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(len(values), -1)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        x = pieces[rest] ^ pieces[i]
        x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & _ONES
        return np.bitwise_count(x).sum(1) <= BANDS * PER_BAND - AGREE

    return near


def _near_sets(values: pa.Array) -> Callable[[int, np.ndarray], np.ndarray]:
    sets = [np.frombuffer(x, np.uint64) for x in values.to_pylist()]
    size = np.array([len(x) for x in sets])

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        out = small >= SIMILARITY * large - 1e-9
        for at in np.flatnonzero(out).tolist():
            j = rest[at]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            out[at] = both >= SIMILARITY * (size[i] + size[j] - both) - 1e-9
        return out

    return near


def _sets(docs: DataFrame) -> DataFrame:
    """docs(cluster, node, text) as (cluster, node, shingles)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["cluster", "node", "shingles"])

    return docs.select("cluster", "node", F.col("text").cast("binary").alias("text")).mapInArrow(each, "cluster long, node long, shingles binary")


def row_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, class) of each row; equal classes are reachable over pairs of similarity 0.8 or more.

    Words are split at ASCII spaces, with small ASCII letters. Null and empty texts are one class. Rows
    of one shingle set share a node. Other columns are left out; an empty table gives no rows.
    """
    rows = written(_sketches(docs), "sketches")
    nodes = written(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "bits", "bands")]), "sketch-nodes")
    grouped = written(simhash_groups(nodes), "sketch-groups")
    discard(nodes)
    least = grouped.groupBy("group").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    by_bits = join_hot(grouped.select("node", "group"), least, ["group"]).select(F.col("node").alias("u"), "v")
    listed = grouped.select("node", "group", "bits", F.explode("bands").alias("band"))
    by_minima = _compared(cells(listed, "band", LIST, "node"), "bits", _near_bits, "group")
    joined = components(by_bits.union(by_minima))
    discard(grouped)
    clusters = joined.select("node", F.col("root").alias("cluster")).union(joined.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    # one row of each node in a cluster gives its set
    stands = join_hot(rows.select("doc_id", "row", "node"), clusters, ["node"]).groupBy("node", "cluster").agg(F.min(F.struct("row", "doc_id")).alias("s"))
    stands = stands.select("node", "cluster", F.col("s.row").alias("row"), F.col("s.doc_id").alias("doc_id"))
    texts = docs.select("doc_id", "text", row_key().alias("row"))
    texts = join_hot(texts, stands, ["row", "doc_id"]).select("cluster", "node", "text")
    sets = written(_sets(texts).dropDuplicates(["node"]), "shingle-sets")
    root = components(_compared(cells(sets, "cluster", SETS, "node"), "shingles", _near_sets))
    discard(sets)
    found = join_hot(rows.select("doc_id", "row", "node"), root, ["node"], "left")
    return found.select("doc_id", "row", F.coalesce("root", "node").alias("class"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near copies: that of the least doc_id."""
    return one_per_class(docs, row_classes(docs))
