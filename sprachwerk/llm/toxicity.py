"""Toxicity by multiple-instance learning: labels name documents, the model finds the sentences.

A sentence's score is a logistic function of its words; a document is toxic unless every sentence and
a small leak fail to make it so (noisy-or). The leak stands for labels without a reason in the text: in
training it keeps such labels from lifting innocent words, and as it says nothing of a text, no score
holds it. Both are trained together from document labels. Words are screened first by counts over the whole
labelled sample; only counts and the few screened words of each sentence reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprachwerk.llm.bytewords import LOWER, Numbers, hashes, pieces, runs
from sprachwerk.llm.common import carried, crc_mod, discard, table, written
from sprachwerk.llm.labelled import SAMPLE, sample

THRESHOLD = 0.3
HELD_OUT, REST = 4, 2
#: Words that pass the screen at most; the strongest stay.
VOCABULARY = 2048
#: Twice the log-likelihood ratio that a word must have for being more toxic than the sample.
SCREEN = 20.0
#: Log-odds of a sentence without a word of the model, before training.
BIAS = -4.0

_KEEP = np.ones(256, bool)
_KEEP[:128] = False
_KEEP[48:58] = _KEEP[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, row starts, word starts, names) in pieces; a long text is cut where sentences end, never inside one."""
    for first, data, starts in pieces(column, cut=_STOP):
        low = LOWER[data]
        a, b = runs(_KEEP[low], starts)
        yield first, data, starts, a, hashes(low, a, b) if len(a) else np.zeros(0, np.uint64)


def _count(rows: DataFrame) -> DataFrame:
    """(name, toxic, all): texts that hold each word, summed up per batch before any shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            names, rows_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for first, _, starts, a, h in _words(batch.column(0)):
                r = np.searchsorted(starts, a, side="right") - 1 + first
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                names.append(h[new])
                rows_.append(r[new])
            h, at = np.unique(np.concatenate(names), return_inverse=True)
            y = label[np.concatenate(rows_)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(at, y, len(h)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(h)).astype(np.int64))], names=["name", "toxic", "n"])

    return rows.select(F.col("text").cast("binary"), "label").mapInArrow(each, "name long, toxic long, n long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


class Model:
    """Names of words, their weights, the bias of a sentence and the leak of a document."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float, leak: float):
        self.names, self.weights, self.bias, self.leak = names, weights, bias, leak
        self.numbers = Numbers()
        self.numbers.add(names, np.arange(len(names), dtype=np.int32))

    def sentences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentences with a word of the model, over all rows: (row, sentence number in its row, start and end byte in its row), and the words as (sentence, word)."""
        out, words = [], []
        base, at, past = 0, -1, np.zeros(2, np.int64)
        for first, data, starts, a, h in _words(column):
            past = past if first == at else np.zeros(2, np.int64)  # sentences and bytes of earlier parts of one long text
            at = first
            stop = _STOP[data]
            upto = np.concatenate([[0], np.cumsum(stop)])
            number = self.numbers.get(h)
            hit = np.flatnonzero(number >= 0)
            if len(hit):
                r = np.searchsorted(starts, a[hit], side="right") - 1
                s = upto[a[hit]] - upto[starts[r]]
                key, inverse = np.unique(np.stack([r, s]), axis=1, return_inverse=True)
                ends = np.flatnonzero(stop)
                g = key[1] + upto[starts[key[0]]]  # stops before the sentence
                begin = np.maximum(np.where(g > 0, ends[np.maximum(g - 1, 0)] + 1 if len(ends) else 0, 0), starts[key[0]])
                close = np.minimum(ends[np.minimum(g, len(ends) - 1)] + 1 if len(ends) else len(data), starts[key[0] + 1])
                close = np.where(g < len(ends), close, starts[key[0] + 1])
                extra = past if len(starts) == 2 else np.zeros(2, np.int64)
                out.append(np.stack([key[0] + first, key[1] + extra[0], begin - starts[key[0]] + extra[1], close - starts[key[0]] + extra[1]]))
                words.append(np.unique(np.stack([inverse.ravel() + base, number[hit]]), axis=1))
                base += key.shape[1]
            if len(starts) == 2:
                past = past + np.array([upto[-1], len(data)])
        empty = np.zeros((4, 0), np.int64)
        found = np.concatenate(out, axis=1) if out else empty
        return found, np.concatenate(words, axis=1) if words else np.zeros((2, 0), np.int64)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of rows; sentences with a word of the model and their scores."""
        found, words = self.sentences(column)
        sums = np.bincount(words[0], self.weights[words[1]], found.shape[1])
        p = 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30)))
        p[sums <= 0] = 0
        calm = np.bincount(found[0], np.log1p(-np.minimum(p, 1 - 1e-12)), len(column))
        return -np.expm1(calm), found, p


def fit(row: np.ndarray, words: np.ndarray, y: np.ndarray, prior: np.ndarray, rounds: int = 500, rate: float = 0.05, hold: float = 0.5) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak by Adam on the noisy-or likelihood, each weight held near its prior.

    The prior is a word's own smoothed log-odds, so a word that others always accompany keeps its
    weight, and one that was seen a few times only gets little. row: the document of each sentence that has screened words; words: (sentence, word); y: labels.
    """
    n, m, n_words = len(y), len(row), len(prior)
    w, b, leak = prior.copy(), BIAS, -3.0
    first, second = np.zeros(n_words + 2), np.zeros(n_words + 2)
    for t in range(1, rounds + 1):
        sums = np.bincount(words[0], w[words[1]], m) + b
        p = np.clip(1 / (1 + np.exp(-np.clip(sums, -30, 30))), 1e-9, 1 - 1e-9)
        e = 1 / (1 + np.exp(-leak))
        calm = np.log1p(-e) + np.bincount(row, np.log1p(-p), n)
        toxic = np.clip(-np.expm1(calm), 1e-9, 1)
        # d log-likelihood / d log(1 - p): y = 0 gives 1, y = 1 gives -(1 - toxic) / toxic
        slope = np.where(y > 0, -np.exp(calm) / toxic, 1.0)
        ds = slope[row] * p / n  # of the loss, by a sentence's sum
        grad = np.concatenate([np.bincount(words[1], ds[words[0]], n_words) + hold * (w - prior) / n, [ds.sum() + 10 * hold * (b - BIAS) / n], [(slope * e).sum() / n]])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w = np.clip(w - step[:n_words], 0, 20)
        b, leak = b - step[n_words], min(leak - step[n_words + 1], 0.0)
    return w, float(b), float(1 / (1 + np.exp(-leak)))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Fit on at most `limit` labelled rows outside the held-out fold. Without both labels every score is 0.

    Rows without an id or a 0/1 label teach nothing. Equal texts are one example, of label 1 if any of
    them has it.
    """
    rows = written(sample(docs, labels, "toxic", crc_mod(F.col("doc_id"), HELD_OUT) != REST, limit), "toxic-sample")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    none = np.zeros(0)
    if not 0 < toxic < n:
        discard(rows)
        return Model(none.astype(np.uint64), none, 0.0, 0.0)
    share = toxic / n
    k, m = F.col("toxic"), F.col("n")

    def part(x, whole, rate):
        return F.when(x > 0, x * F.log(x / (whole * rate))).otherwise(F.lit(0.0))

    ratio = 2 * (part(k, m, share) + part(m - k, m, 1 - share))
    screened = _count(rows).where(k > m * share).withColumn("ratio", ratio).where(F.col("ratio") >= SCREEN).orderBy(F.desc("ratio"), "name").limit(VOCABULARY).collect()
    screened.sort(key=lambda r: r["name"])
    names = np.array([r["name"] for r in screened], np.int64).view(np.uint64)
    prior = np.array([np.log((r["toxic"] + 4 * share) / (r["n"] - r["toxic"] + 4 * (1 - share)) * (1 - share) / share) for r in screened])
    if not len(names):
        discard(rows)
        return Model(names, none, 0.0, share)
    model = Model(names, np.ones(len(names)), 0.0, 0.0)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = shared.value.sentences(batch.column(0))
            of = [[] for _ in range(batch.num_rows)]
            sentence = [[] for _ in range(found.shape[1])]
            for s, w in words.T.tolist():
                sentence[s].append(w)
            for s, r in enumerate(found[0].tolist()):
                of[r].append(sentence[s])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(of, pa.list_(pa.list_(pa.int32())))], names=["y", "bag"])

    got = sorted((r["y"], r["bag"]) for r in rows.select(F.col("text").cast("binary"), "label").mapInArrow(bags, "y int, bag array<array<int>>").collect())
    discard(rows)
    y = np.array([a for a, _ in got], np.float64)
    row = np.array([i for i, (_, bag) in enumerate(got) for _ in bag], np.int64)
    flat = [s for _, bag in got for s in bag]
    words = np.array([(i, w) for i, s in enumerate(flat) for w in s], np.int64).reshape(-1, 2).T
    weights, bias, leak = fit(row, words, y, prior)
    use = weights > 0.05
    return Model(names[use], weights[use], bias, leak)


def score(docs: DataFrame, model: Model, out: str = "toxicity", least: float = THRESHOLD) -> DataFrame:
    """docs with struct `out`: score, and the sentences that score at least `least` as (text, score), in order.

    Null and empty texts score 0. Sentences end at . ! ? and line ends, however long the text; one is
    told in whole. Repeated rows are each scored; an empty table gives no rows. A column of that name is
    replaced, other columns stay, whatever their names. Nothing of a document but its text has any
    influence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    sentence = pa.struct([("text", pa.string()), ("score", pa.float64())])
    struct = pa.struct([("score", pa.float64()), ("sentences", pa.list_(sentence))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            scores, found, p = shared.value.score(column)
            told: list[list] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(p >= least).tolist():
                r, _, a, b = found[:, i].tolist()
                told[r].append({"text": column[r].as_buffer().to_pybytes()[a:b].decode("utf-8", "replace").strip(), "score": float(p[i])})
            rows = [{"score": s, "sentences": t} for s, t in zip(scores.tolist(), told, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, struct)], names=[*kept, out])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T._parse_datatype_string("struct<score:double,sentences:array<struct<text:string,score:double>>>"))])
    return docs.select(*carried(kept), F.col("text").cast("binary").alias("_sw_text")).mapInArrow(add, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learnt outside the held-out fold; a null doc_id is in no fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs.select("doc_id", "text"), model, "found").select("doc_id", F.col("found.score").alias("score"))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT) == REST, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
