"""SimHash near-duplicates by an inverted index over byte positions, with count filtering.

Two 64-bit fingerprints that differ in at most `distance` bits agree in at least 8 - distance of their 8
bytes, the guaranteed minimum. A posting list holds the fingerprints that have the same bytes at a few
positions; the position sets are chosen so that any two fingerprints which reach the minimum share a list
(of five equal positions, three lie in one half of the eight). In a list, the positional bytes that a
pair shares are tallied over all eight positions, pairs that reach the minimum are retained, and these
are verified bit by bit. Lists of one position each would hold 1/256 of all rows: their tallies grow with
the square of the corpus, so no position stands alone.

What leaves a list is a spanning forest of its links, never all pairs: links are only needed for
components. A list beyond LIST rows is cut by a hash into parts that meet two by two, each pair of parts
in its own task. Copies of a fingerprint are one node. Components come from alternating large-star and
small-star rounds over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sprachwerk.llm.common import columns, discard, join_hot, table, written

SHINGLE = 3
DISTANCE = 3
#: Rows of a posting list that one task compares with each other.
LIST = 2048
#: Up to so many fingerprints, lists of the shortest position sets are short enough; beyond, the minimum itself is one set.
SHORT_SETS = 1 << 30
SEED = 42


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, unsigned."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, unsigned."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: n - shingle + 1].tolist()
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1)
    return majority(h)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp): fp as a signed long, row as in row_key. A null text has no words and fingerprint 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["doc_id", "row", "fp"])

    return docs.select("doc_id", row_key().alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(each, "doc_id long, row long, fp long")


def position_sets(distance: int, shortest: bool = True) -> list[tuple[int, ...]]:
    """Sets of byte positions, of which any two fingerprints within `distance` agree on one at least."""
    least = 8 - distance
    if not shortest:
        return list(combinations(range(8), least))
    half = -(-least // 2)  # of `least` equal positions, so many are in one half
    return [*combinations(range(4), half), *combinations(range(4, 8), half)]


def _entries(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp): fp in the posting list of its bytes at each set of positions."""
    masks = []
    for positions in sets:
        mask = sum(255 << (8 * p) for p in positions)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("key"))


def cells(listed: DataFrame, key: str, most: int, node: str, salts: int = 64) -> DataFrame:
    """listed with `cell`: all rows of one key, or of two parts of a key with more than `most` rows.

    A long list is counted before it is shuffled, and its rows learn of its length by a salted join, so no
    task ever holds it. Each row goes to as many cells as its list has parts.
    """
    salt = F.pmod(F.xxhash64(node, F.lit(7)), F.lit(salts)).cast("int")
    long = listed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    long = long.select(F.col(key).alias("_key"), F.ceil(F.col("_n") / most).cast("int").alias("_parts"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    met = listed.withColumn("_own", salt)
    met = met.join(long, (met[key] == long["_key"]) & (met["_own"] == long["_salt"]), "left")
    parts = F.coalesce("_parts", F.lit(1))
    part = F.pmod(F.xxhash64(node), parts).cast("int")
    met = met.select(*columns(listed.columns), part.alias("_part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other"), parts.alias("_of"))
    cell = F.when(F.col("_of") == 1, F.col(key)).otherwise(F.xxhash64(key, F.greatest("_part", "_other"), F.least("_part", "_other")))
    return met.withColumn("cell", cell).drop("_part", "_other", "_of")


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes by the links u-v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_ONES = np.uint64(0x0101010101010101)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of each pair: positions at which both have the same byte."""
    x = (a ^ b).view(np.uint64)
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 8 - np.bitwise_count(x & _ONES)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs reach the minimum of shared bytes and, of those, differ in `distance` bits at most."""
    out = shared_bytes(a, b) >= 8 - distance
    held = np.flatnonzero(out)
    out[held] = np.bitwise_count((a[held] ^ b[held]).view(np.uint64)) <= distance
    return out


def _links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest over runs of equal keys, lag by lag over all runs at once."""
    n = len(key)
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1])])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, n))
    to_end = np.repeat(edge + size, size)
    us, vs, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    lag, rows = 1, np.arange(n)
    while len(rows):
        rows = rows[rows + lag < to_end[rows]]
        ok = _near(fp[rows], fp[rows + lag], distance)
        us.append(rows[ok])
        vs.append(rows[ok] + lag)
        held += len(us[-1])
        if held > 4 * n + 100_000:  # keep the forest of what was found so far
            u, v = np.concatenate(us), np.concatenate(vs)
            label = _forest(n, u, v)
            own = np.flatnonzero(label != np.arange(n))
            us, vs, held = [own], [label[own]], len(own)
        lag += 1
    u, v = np.concatenate(us), np.concatenate(vs)
    label = _forest(n, u, v)
    own = np.flatnonzero(label != np.arange(n))
    return fp[own], fp[label[own]]


def links(fps: DataFrame, distance: int = DISTANCE, list_rows: int = LIST, short_sets: int = SHORT_SETS) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints whose closure is that of all links."""
    listed = _entries(fps, position_sets(distance, fps.count() <= short_sets))
    dealt = cells(listed, "key", list_rows, "fp").select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            u, v = _links(a, b, distance)
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            if rest is not None:
                own = [np.concatenate([a, b]) for a, b in zip(rest, own, strict=True)]
            if not len(own[0]):
                continue
            whole = int(np.flatnonzero(own[0] == own[0][-1])[0])  # the last list may go on
            if whole:
                yield told(*[x[:whole] for x in own])
            rest = [x[whole:] for x in own]
        if rest is not None and len(rest[0]):
            yield told(*rest)

    return dealt.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for each node that is not its component's least, by alternating star rounds."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        # large star: every neighbour above a node goes to the least of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_hot(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        # small star: every neighbour below a node, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "small-star")
        discard(edges, large)
        edges = small
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _named(docs: DataFrame, distance: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp) of each row and (fp, root, component_id) of each fingerprint."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    root = components(links(nodes.select("fp"), distance))
    rooted = written(nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    discard(nodes)
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(join_hot(rooted, whole, ["root"]).select("fp", "root", "component_id"), "fingerprint-classes")
    discard(rooted)
    return prints, classes


def classes(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links.

    Null and empty texts have fingerprint 0 and are linked like any other. Texts of one or two words
    are one shingle; a very long text is held as one at a time, with eight bytes a shingle. A bit that is
    set in exactly half of the shingles is 0. Repeated rows are told each. A null doc_id is never a
    component's least unless it is alone. Other columns are left out; an empty table gives no rows.
    """
    prints, named = _named(docs, distance, shingle)
    return join_hot(prints, named, ["fp"]).select("doc_id", "fp", "component_id")


def row_key() -> Column:
    """What tells rows of one doc_id apart: their text."""
    return F.xxhash64(F.col("text").cast("binary"))


def one_per_class(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of docs for each class in rows(doc_id, row, class): that of the least doc_id, null ids last.

    Of rows that share that doc_id and their text one stays, whichever their other columns.
    """
    least = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("s"))
    kept = least.select(F.col("s.doc_id").alias("doc_id"), F.col("s.row").alias("_sw_row"))
    first = join_hot(docs.withColumn("_sw_row", row_key()), kept, ["doc_id", "_sw_row"], "left_semi")
    return first.dropDuplicates(["doc_id", "_sw_row"]).select(*columns(docs.columns))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each class, whatever ids its rows have: that of the least doc_id."""
    prints, named = _named(docs, distance, SHINGLE)
    return one_per_class(docs, join_hot(prints, named, ["fp"]).select("doc_id", "row", F.col("root").alias("class")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint as 16 hex digits and its component, over the whole table; edge cases as in `classes`."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
