"""Exact top-k by inner product, with a table of distances to pivots that rules candidates out.

Distances of every vector to many pivots are computed once. A single pivot p bounds a distance from below
by |d(q, p) - d(x, p)|; the distances to all pivots together place q and x in the simplex of the pivots,
and the distance between those places, with the heights over the simplex apart as far as they are alike,
is the maximum of the lower bounds: it is never below that of a single pivot. With
|q - x|^2 = |q|^2 + |x|^2 - 2<q, x>, a lower bound on the distance caps the product.

Queries and candidates meet block by block. Candidates of a block are evaluated in the order of their
caps, and a query stops, exactly, where the next cap falls below its k-th score so far. That score is
carried from block to block: blocks are met in rounds, each with eight times the blocks of all before,
and what a round has found is the threshold of the next. So a query brings back a number of rows that
does not grow with the table, but for the logarithm of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sprachwerk.llm.common import discard, table, written

K = 20
SCALE = 64
QUERY_EVERY = 20
PIVOTS = 48
#: Vectors, chosen by a hash of their ids, among which the pivots are found.
PIVOT_SAMPLE = 1024
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Each round meets so many times the blocks met before.
GROWTH = 8
#: Candidates that are evaluated before caps are looked at again, at first; then twice as many each time.
BATCH = 128
#: Scores up to here are exact in double arithmetic.
_EXACT = 2.0**52


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with 0."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample that are farthest from the span of those chosen before, by the origin; fewer if the sample has no more directions."""
    rest = sample.astype(np.float64)
    chosen: list[int] = []
    scale = np.sqrt((rest * rest).sum(1)).max(initial=0)
    while len(chosen) < pivots:
        far = (rest * rest).sum(1)
        best = int(far.argmax()) if len(far) else -1
        if best < 0 or np.sqrt(far[best]) <= 1e-4 * scale:
            break
        chosen.append(best)
        axis = rest[best] / np.sqrt(far[best])
        rest = rest - np.outer(rest @ axis, axis)
    return sample[chosen].astype(np.float64)


class Simplex:
    """Places in the simplex of the origin and the pivots, from distances to them."""

    def __init__(self, pivots: np.ndarray):
        self.norms = (pivots * pivots).sum(1)
        self.back = np.linalg.inv(np.linalg.qr(pivots.T)[1]) if len(pivots) else np.zeros((0, 0))

    def places(self, square: np.ndarray, distances: np.ndarray) -> np.ndarray:
        """Coordinates along the pivots' span and, last, the height over it; square: squared distances to the origin."""
        inner = (square[:, None] + self.norms - distances * distances) / 2
        flat = inner @ self.back
        height = np.sqrt(np.maximum(square * (1 + 1e-9) - (flat * flat).sum(1), 0))  # never too low by rounding
        return np.column_stack([flat, height])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64)
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def meet(q: np.ndarray, q_ids: np.ndarray, q_at: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, x_at: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, candidates, scores, evaluated): of a block, the k best candidates of each query that reach its floor, never itself.

    q_at and x_at are places in the simplex: their product caps <q, x>, since heights are at best alike.
    """
    high = (np.abs(q).max(initial=0) * 1.0) * (np.abs(x).max(initial=0) * 1.0) * max(1, q.shape[1])
    kind = np.float64 if high < _EXACT else object
    fx, fq = x.astype(kind), q.astype(kind)
    length = np.sqrt((q_at * q_at).sum(1)), np.sqrt((x_at * x_at).sum(1)).max(initial=0)
    for at in range(0, len(q), 256):
        caps = q_at[at : at + 256] @ x_at.T
        for j in range(len(caps)):
            i = at + j
            cap = caps[j] + (1 + 1e-7 * length[0][i] * length[1])  # for rounding
            cap[x_ids == q_ids[i]] = -np.inf
            least, seen = floor[i], 0
            place, scores = np.zeros(0, np.int64), np.zeros(0, kind)
            left = np.flatnonzero((cap >= least) & (cap > -np.inf))  # a query is no candidate of its own
            batch = max(BATCH, 2 * k)
            while len(left):
                if len(left) > batch:  # the highest caps first
                    part = np.argpartition(-cap[left], batch - 1)
                    now, left = left[part[:batch]], left[part[batch:]]
                else:
                    now, left = left, left[:0]
                batch *= 2
                seen += len(now)
                place, scores = np.concatenate([place, now]), np.concatenate([scores, fx[now] @ fq[i]])
                if len(place) >= k:
                    own = _best(scores, x_ids[place], k)
                    place, scores = place[own], scores[own]
                    least = max(least, float(scores[-1]))
                    left = left[cap[left] >= least]
            keep = np.flatnonzero(scores.astype(np.float64) >= floor[i]) if len(scores) else np.zeros(0, np.int64)
            own = keep[_best(scores[keep], x_ids[place[keep]], k)]
            yield i, place[own], scores[own], seen


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """For each vector where is_query holds, the k highest inner products with other vectors.

    vectors(vec_id, embedding): components become floor(scale * x). Null ids, null vectors and vectors
    with a null or non-finite component take no part. Of rows with one vec_id the least vector stands.
    A shorter vector counts as filled up with 0. Returns query_id, rank from 1, vec_id, score; ties go
    to the smaller vec_id; fewer candidates than k give fewer rows. Scores beyond 64 bits are held at
    the ends of the range. Other columns are ignored; an empty table gives no rows. Vectors may be of
    any length that a few thousand of which fit a task.
    """
    return _top_k(vectors, is_query, k, scale, pivots, query_block, candidate_block).drop("evaluated")


def _top_k(vectors: DataFrame, is_query: Column, k: int, scale: int, pivots: int, query_block: int, candidate_block: int) -> DataFrame:
    """top_k with `evaluated`: the candidates whose product was computed for the query, over all blocks."""
    spark = vectors.sparkSession
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = vectors.where(F.col("vec_id").isNotNull() & good).groupBy("vec_id").agg(F.min("embedding").alias("e"))
    whole = written(whole.select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("v"), is_query.alias("asks")), "vectors")
    size = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n, n_queries, width = (int(x) for x in size)
    sample = np.zeros((min(n, PIVOT_SAMPLE), width))
    for i, r in enumerate(whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()):
        sample[i, : len(r["v"])] = r["v"]
    shared = spark.sparkContext.broadcast(choose_pivots(sample, pivots))
    n_pivots = len(shared.value)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            v = _matrix(batch.column(1), width)
            f = v.astype(np.float64)
            d = np.stack([np.sqrt(((f - row) ** 2).sum(1)) for row in p], 1) if len(p) else np.zeros((len(v), 0))
            packed = [a.tobytes() + b.tobytes() for a, b in zip(v, d, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["vec_id", "packed", "asks"])

    q_blocks, x_blocks = max(1, -(-n_queries // query_block)), max(1, -(-n // candidate_block))
    mine = F.xxhash64("vec_id")
    blocks = [F.pmod(mine, F.lit(q_blocks)).cast("int").alias("qb"), F.pmod(mine, F.lit(x_blocks)).cast("int").alias("xb")]
    # the table of distances, beside the vectors that they belong to
    rows = written(whole.mapInArrow(distances, "vec_id long, packed binary, asks boolean").select("*", *blocks), "pivot-table")
    discard(whole)
    low, high = -(1 << 63), (1 << 63) - 1

    def cell(own: pa.Table) -> pa.Table:
        is_q = own["asks"].to_numpy(zero_copy_only=False).astype(bool)
        ids = own["vec_id"].to_numpy()
        raw = np.frombuffer(b"".join(own["packed"].to_pylist()), np.int64).reshape(len(ids), width + n_pivots)
        v, d = raw[:, :width], raw[:, width:].view(np.float64)
        f = v.astype(np.float64)
        at = Simplex(shared.value).places((f * f).sum(1), d)
        floor = own["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
        out = [[], [], [], []]
        for i, place, scores, seen in meet(v[is_q], ids[is_q], at[is_q], floor[is_q], v[~is_q], ids[~is_q], at[~is_q], k):
            # a row of no candidate tells what was evaluated
            out[0].append(np.full(len(place) + 1, ids[is_q][i]))
            out[1] += [None, *ids[~is_q][place].tolist()]
            out[2] += [0, *(min(max(int(s), low), high) for s in scores)]
            out[3] += [seen, *[0] * len(place)]
        return pa.table({"query_id": pa.array(np.concatenate(out[0]) if out[0] else [], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64()), "evaluated": pa.array(out[3], pa.int64())})

    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best: DataFrame | None = None
    first = 0
    while first < x_blocks:
        end = min(x_blocks, max(1, first * GROWTH))
        queries = rows.where("asks")
        if best is None:
            queries = queries.withColumn("floor", F.lit(float("-inf")))
        else:  # a row a query, as many as ask
            floors = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
            queries = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        asks = queries.select(F.lit(True).alias("asks"), "vec_id", "packed", "floor", "qb", F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("xb"))
        rest = rows.where(F.col("xb").between(first, end - 1)).select(F.lit(False).alias("asks"), "vec_id", "packed", F.lit(0.0).alias("floor"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), "xb")
        found = asks.unionByName(rest).groupBy("qb", "xb").applyInArrow(cell, "query_id long, vec_id long, score long, evaluated long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        told = found.withColumn("evaluated", F.sum("evaluated").over(W.partitionBy("query_id"))).where("vec_id IS NOT NULL")
        ranked = told.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        # what one candidate of a query tells is told once
        ranked = written(ranked.withColumn("evaluated", F.when(F.col("rank") == 1, F.col("evaluated")).otherwise(0)), "best")
        if best is not None:
            discard(best)
        best, first = ranked, end
    discard(rows)
    return best.select("query_id", "rank", "vec_id", "score", "evaluated")


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of each vector whose id is divisible by 20, among all others; edge cases as in `top_k`."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(e, lambda x: floor(64 * cast(x AS DOUBLE))) AS u
  FROM (SELECT vec_id, min(embedding) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        GROUP BY vec_id)),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, cast(list_dot_product(q.u, x.u) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
