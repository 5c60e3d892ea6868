"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree a turn on one feature's bins, over and over, and adds it to that
feature's lookup table; pairs of features that explain most of what is left then get tables of their
own in the same way. A score is a sum of table entries, one per feature and pair, for a whole batch at
once. Only bounded tables travel: features of the labelled sample to the driver, tables to executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprachwerk.llm.bytewords import SPACE, hashes, pieces, runs
from sprachwerk.llm.common import carried, crc_mod, table
from sprachwerk.llm.labelled import SAMPLE, sample

THRESHOLD = 0.3
HELD_OUT = 5

_GROUPS = np.zeros((256, 8), bool)
_GROUPS[65:91, 0] = True  # capitals
_GROUPS[97:123, 1] = True  # small letters
_GROUPS[48:58, 2] = True  # digits
_GROUPS[[ord(c) for c in ".,;:'\"()-"], 3] = True  # running punctuation
_GROUPS[[ord(c) for c in "!?"], 4] = True
_GROUPS[[ord(c) for c in "#$%&*+=<>@\\^_`{|}~/[]"], 5] = True  # symbols
_GROUPS[128:, 6] = True
_GROUPS[[10], 7] = True
_LINE_END = _GROUPS[:, 7]

FEATURES = ("log_bytes", "capitals", "small", "digits", "stops", "shouts", "symbols", "other_bytes", "line_ends", "word_bytes", "distinct_words", "symbol_words", "repeated_lines", "longest_word")


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null and empty texts give zeros.

    A very long text is read in parts that end where a line ends, so its features are those of the whole;
    one that is a single line is held whole.
    """
    n = len(column)
    counts, total = np.zeros((n, 8)), np.zeros(n)
    words, word_bytes, distinct, odd, longest = (np.zeros(n) for _ in range(5))
    lines, repeated = np.zeros(n), np.zeros(n)
    none = np.zeros(0, np.uint64)
    seen_words = seen_lines = none
    group = _GROUPS.astype(np.float64)
    last = -1
    for first, data, starts in pieces(column, cut=_LINE_END):
        m = len(starts) - 1
        if first != last:  # parts of one very long text come one after another
            seen_words = seen_lines = none
        last = first
        own = slice(first, first + m)
        row = np.repeat(np.arange(m), np.diff(starts))
        total[own] += np.diff(starts)
        histogram = np.bincount(row * 256 + data, minlength=m * 256).reshape(m, 256)
        counts[own] += histogram @ group
        a, b = runs(~SPACE[data], starts)
        r = np.searchsorted(starts, a, side="right") - 1
        words[own] += np.bincount(r, minlength=m)
        word_bytes[own] += np.bincount(r, b - a, minlength=m)
        np.maximum.at(longest, r + first, b - a)
        symbol = _GROUPS[data, 5] | _GROUPS[data, 4]
        upto = np.concatenate([[0], np.cumsum(symbol)])
        odd[own] += np.bincount(r, upto[b] > upto[a], minlength=m)
        la, lb = runs(data != 10, starts)
        lr = np.searchsorted(starts, la, side="right") - 1
        lines[own] += np.bincount(lr, minlength=m)
        names, line_names = (hashes(data, x, y) if len(x) else np.zeros(0, np.uint64) for x, y in ((a, b), (la, lb)))
        if m == 1:
            seen_words, seen_lines = np.union1d(seen_words, names), np.union1d(seen_lines, line_names)
            distinct[first] = len(seen_words)
            repeated[first] = lines[first] - len(seen_lines)
        else:
            distinct[own] = _distinct(r, names, m)
            repeated[own] = np.bincount(lr, minlength=m) - _distinct(lr, line_names, m)
    size, w = np.maximum(total, 1)[:, None], np.maximum(words, 1)
    share = counts / size
    return np.column_stack([np.log1p(total), share[:, :7], share[:, 7], word_bytes / w, distinct / w, odd / w, repeated / np.maximum(lines, 1), np.log1p(longest)])


def _distinct(row: np.ndarray, names: np.ndarray, m: int) -> np.ndarray:
    order = np.lexsort((names, row))
    r, h = row[order], names[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=m)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """Newton steps of a tree of few leaves over ordered bins, as a value for each bin."""
    cuts = [0, len(g)]
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def worth(a, b):
        return (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + l2)

    while len(cuts) - 1 < leaves:
        best, at = 1e-12, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = np.arange(a + 1, b)
            k = k[(sh[k] - sh[a] >= least) & (sh[b] - sh[k] >= least)]
            if len(k):
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                if gain.max() > best:
                    best, at = gain.max(), int(k[gain.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = -(sg[b] - sg[a]) / (sh[b] - sh[a] + l2)
    return out


class Model:
    """Bin edges, one table a feature, one table a chosen pair."""

    def __init__(self, intercept: float):
        self.intercept = intercept
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edge, x[:, f], side="right")]
        for i, j, a, b, values in self.pairs:
            total += values[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return _sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 8, rounds: int = 120, pairs: int = 6, rate: float = 0.15, leaves: int = 3, l2: float = 1.0, least: float = 0.5) -> Model:
    """The model for features x and labels y. Without both labels it is a constant."""
    n = len(y)
    share = min(max((y.sum() + 0.5) / (n + 1), 1e-3), 1 - 1e-3)
    model = Model(float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, model.intercept)
    for _ in range(rounds):
        for f, b in enumerate(binned):
            p = _sigmoid(total)
            step = rate * _tree(np.bincount(b, p - y, len(tables[f])), np.bincount(b, p * (1 - p), len(tables[f])), leaves, l2, least)
            tables[f] += step
            total += step[b]
    few = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, coarse + 1)[1:-1])) for f in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(few)]
    p = _sigmoid(total)
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            cell = small[i] * coarse + small[j]
            g, h = np.bincount(cell, p - y, coarse * coarse), np.bincount(cell, p * (1 - p), coarse * coarse)
            gains.append(((g * g / (h + l2)).sum(), i, j))
    chosen = [(i, j, np.zeros((len(few[i]) + 1, len(few[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(rounds // 4):
        for i, j, values in chosen:
            p = _sigmoid(total)
            shape = values.shape
            cell = small[i] * shape[1] + small[j]
            g, h = np.bincount(cell, p - y, values.size).reshape(shape), np.bincount(cell, p * (1 - p), values.size).reshape(shape)
            # a tree of two levels: one cut along i, then one along j on either side
            top = _tree(g.sum(1), h.sum(1), 2, l2, least)
            k = int(np.argmax(top != top[0])) or shape[0]
            step = np.zeros(shape)
            for part in (slice(0, k), slice(k, shape[0])):
                if part.start < part.stop:
                    step[part] = _tree(g[part].sum(0), h[part].sum(0), 2, l2, least)
            values += rate * step
            total += rate * step.ravel()[cell]
    model.edges, model.tables = edges, tables
    model.pairs = [(i, j, few[i], few[j], values) for i, j, values in chosen]
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Fit on at most `limit` labelled rows outside the held-out fold.

    Rows without an id or a 0/1 label teach nothing. Equal texts are one example, of label 1 if any of
    them has it. Without labels, or with only one of them, the model is a constant share.
    """
    rows = sample(docs, labels, "quality", crc_mod(F.col("doc_id"), HELD_OUT) != 0, limit)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], names=["x", "y"])

    got = rows.select(F.col("text").cast("binary"), "label").mapInArrow(measure, "x array<double>, y int").collect()
    got = sorted((r["y"], r["x"]) for r in got)  # the fit depends on the rows, not on their order of arrival
    return fit(np.array([x for _, x in got]).reshape(-1, len(FEATURES)), np.array([y for y, _ in got], dtype=np.float64))


def score(docs: DataFrame, model: Model, out: str = "quality_score") -> DataFrame:
    """docs with a double column `out` from 0 to 1, the same for equal texts.

    Null texts score as empty ones. Repeated rows are each scored; an empty table gives no rows. A column
    of that name is replaced, other columns stay, whatever their names. Score and label are told apart by
    the threshold alone: a score equal to it counts as reached.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(features(column)))], names=[*kept, out])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.DoubleType())])
    return docs.select(*carried(kept), F.col("text").cast("binary").alias("_sw_text")).mapInArrow(add, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learnt outside the held-out fold; a null doc_id is in no fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs, model, "score")
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
