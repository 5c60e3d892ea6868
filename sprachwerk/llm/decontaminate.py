"""Benchmark decontamination by winnowing.

Both sides are words. Five-word hashes are winnowed: of every six neighbours the least is kept, so any
ten words that a text shares with an item share a kept hash. Kept hashes of texts are joined with
those of items, and each meeting is extended word by word to the longest equal span; spans of at least
one window count. Items shorter than a window are joined by a hash of their whole length.

The benchmark is read in blocks of a bounded size; a block's table of hashes goes to every executor, and
what it finds is written before the next block is read, so one broadcast is alive at a time. Texts are
never shuffled: each block's pass adds its spans and items to the row that it has at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprachwerk.llm.bytewords import LOWER, Numbers, hashes, pieces, ragged, runs
from sprachwerk.llm.common import carried, discard, named, table, written

WINDOW = 10
GRAM = 5
#: Bytes of item texts that one block, and so one broadcast, may hold.
BLOCK_BYTES = 16 << 20

_KEEP = np.ones(256, bool)
_KEEP[:128] = False
_KEEP[48:58] = _KEEP[97:123] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def _roll(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _P + (ids[j : j + n].astype(np.uint64) + np.uint64(2))
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.where(h == 0, np.uint64(1), h)


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of some w neighbours; the rightmost of equals."""
    n = len(h)
    if n < w:
        return np.arange(n)[h == h.min()][-1:] if n else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(n - w + 1) + (w - 1 - windows.argmin(1)))


class Index:
    """Words, kept hashes and ids of a block of items."""

    def __init__(self, items: list[tuple[object, bytes]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.item_ids = [i for i, _ in items]
        self.words = Numbers()
        texts, lengths = [], []
        n_words = 0
        for first, data, starts in pieces(pa.array([t for _, t in items], pa.large_binary()), 4 << 20):
            data = LOWER[data]
            a, b = runs(_KEEP[data], starts)
            names = hashes(data, a, b)
            number = self.words.get(names)
            new = np.unique(names[number < 0])
            self.words.add(new, np.arange(n_words, n_words + len(new), dtype=np.int32))
            n_words += len(new)
            texts.append(self.words.get(names))
            lengths += [(first + r, n) for r, n in enumerate(np.diff(np.searchsorted(a, starts)).tolist())]
        # items side by side; -2 between them equals no word of a text
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        size = np.zeros(len(items), np.int64)
        for r, n in lengths:
            size[r] += n
        self.start = np.arange(len(items)) + np.cumsum(size) - size
        self.size = size
        self.flat = np.full(len(flat) + len(items), -2, np.int32)
        self.flat[ragged(self.start, size)] = flat
        self.owner = np.repeat(np.arange(len(items)), size + 1)
        self.lengths = sorted({int(n) for n in size if 0 < n < window})
        self.kept: dict[int, tuple[Numbers, np.ndarray, np.ndarray]] = {}
        h = _roll(self.flat, gram)
        places = []
        for r in np.flatnonzero(size >= window).tolist():
            own = h[self.start[r] : self.start[r] + size[r] - gram + 1]
            places.append(self.start[r] + winnow(own, window - gram + 1))
        if places:
            at = np.concatenate(places)
            self.kept[0] = self._table(h[at], at)
        for n in self.lengths:
            at = self.start[size == n]
            self.kept[n] = self._table(_roll(self.flat, n)[at], at)

    @staticmethod
    def _table(h: np.ndarray, at: np.ndarray) -> tuple[Numbers, np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        names, first = np.unique(h, return_index=True)
        numbers = Numbers()
        numbers.add(names, np.arange(len(names), dtype=np.int32))
        return numbers, np.append(first, len(at)), at

    def _meet(self, n: int, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the texts, place in the items) of equal hashes."""
        numbers, first, places = self.kept[n]
        got = numbers.get(h)
        hit = np.flatnonzero(got >= 0)
        count = (first[got[hit] + 1] - first[got[hit]]).astype(np.int64)
        return np.repeat(at[hit], count), places[ragged(first[got[hit]], count)]

    def find(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, item) of the equal spans in ids, where -1 stands for other words and row ends."""
        # 'least of some six' by a running minimum: cheaper than windows, and ties add places only
        if 0 in self.kept and len(ids) >= self.window:
            h = _roll(ids, self.gram)
            w = self.window - self.gram + 1
            m = len(h) - w + 1
            least = h[:m].copy()
            for j in range(1, w):
                np.minimum(least, h[j : j + m], out=least)
            kept = np.zeros(len(h), bool)
            for j in range(w):
                kept[j : j + m] |= h[j : j + m] == least
            at = np.flatnonzero(kept & (ids[: len(h)] >= 0))
            for s in range(0, len(at), 1 << 16):
                yield from self._extend(ids, *self._meet(0, h[at[s : s + (1 << 16)]], at[s : s + (1 << 16)]))
        for n in self.lengths:
            h = _roll(ids, n)
            d, q = self._meet(n, h, np.arange(len(h)))
            for j in range(n):
                same = ids[d + j] == self.flat[q + j]
                d, q = d[same], q[same]
            yield d, d + n, self.owner[q]

    def _extend(self, ids: np.ndarray, d: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Grow each meeting both ways, all at once; each diagonal's span is told once."""
        for s in range(0, len(d), 1 << 18):
            d_, q_ = d[s : s + (1 << 18)], q[s : s + (1 << 18)]
            left, right = np.zeros(len(d_), np.int64), np.zeros(len(d_), np.int64)
            go = np.arange(len(d_))
            while len(go):
                a, b = d_[go] + right[go], q_[go] + right[go]
                ok = (a < len(ids)) & (b < len(self.flat))
                ok[ok] = ids[a[ok]] == self.flat[b[ok]]
                go = go[ok]
                right[go] += 1
            go = np.flatnonzero(right >= self.gram)
            while len(go):
                a, b = d_[go] - left[go] - 1, q_[go] - left[go] - 1
                ok = (a >= 0) & (b >= 0)
                ok[ok] = ids[a[ok]] == self.flat[b[ok]]
                go = go[ok]
                left[go] += 1
            long = left + right >= self.window
            yield d_[long] - left[long], d_[long] + right[long], self.owner[q_[long]]


HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def _united(spans: list[dict]) -> list[dict]:
    """Spans in order, those that meet or overlap as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and out[-1]["end"] >= s["start"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def annotate(docs: DataFrame, index, out: str = "hits", before: str | None = None) -> DataFrame:
    """docs with struct `out`: n_words, spans of hit words (united, in order), items found; with those of column `before` added."""
    kept = [c for c in docs.columns if c not in (out, before)]
    past = named(before) if before else F.lit(None).cast(HITS)
    source = docs.select(*carried(kept), past.alias("_sw_past"), F.col("text").cast("binary").alias("_sw_text"))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T._parse_datatype_string(HITS))])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    struct = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = index.value
        for batch in batches:
            n_words, spans, items = hits_of(found_by, batch.column(batch.num_columns - 1))
            rows = [{"n_words": n, "spans": spans.get(r, []), "items": items.get(r, [])} for r, n in enumerate(n_words.tolist())]
            for row, past in zip(rows, batch.column(batch.num_columns - 2).to_pylist() if before else (), strict=False):
                row["spans"] = _united(past["spans"] + row["spans"])
                row["items"] = sorted({*past["items"], *row["items"]})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rows, struct)], names=[*kept, out])

    return source.mapInArrow(scan, schema)


def hits_of(index: Index, column: pa.Array) -> tuple[np.ndarray, dict[int, list], dict[int, list]]:
    """Words of each text; of those with hits, the united spans and the items."""
    n_words = np.zeros(len(column), np.int64)
    spans: dict[int, list] = {}
    items: dict[int, list] = {}
    for first, data, starts in pieces(column, cut=None):
        data = LOWER[data]
        a, b = runs(_KEEP[data], starts)
        row = np.searchsorted(starts, a, side="right") - 1
        n_words[first : first + len(starts) - 1] = np.bincount(row, minlength=len(starts) - 1)
        if not len(a):
            continue
        line = np.full(len(a) + len(starts) - 1, -1, np.int32)  # a place of -1 after each row
        line[np.arange(len(a)) + row] = index.words.get(hashes(data, a, b))
        begin = np.searchsorted(a, starts[:-1]) + np.arange(len(starts) - 1)
        change = np.zeros(len(line) + 1, np.int64)
        met: list[np.ndarray] = []
        for s, e, item in index.find(line):
            np.add.at(change, s, 1)
            np.add.at(change, e, -1)
            if len(s):
                met.append(np.unique(np.stack([np.searchsorted(begin, s, side="right") - 1, item]), axis=1))
        if not met:
            continue
        hit = np.concatenate([[False], np.cumsum(change) > 0, [False]])
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        own = np.searchsorted(begin, edge[::2], side="right") - 1
        for r, s, e in zip(own.tolist(), (edge[::2] - begin[own]).tolist(), (edge[1::2] - begin[own]).tolist(), strict=True):
            spans.setdefault(first + r, []).append({"start": s, "end": e})
        ids: dict[int, set] = {}
        for r, i in np.concatenate(met, axis=1).T.tolist():
            ids.setdefault(first + r, set()).add(index.item_ids[i])
        items.update({r: sorted(x) for r, x in ids.items()})
    return n_words, spans, items


def blocks(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark as tables of at most block_bytes of item text each (a longer item stands alone).

    The driver holds one block of item texts at a time, never anything of the documents.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    block, held = [], 0
    for item_id, text in items.toLocalIterator():
        if block and held + len(text) > block_bytes:
            yield Index(block, window, gram)
            block, held = [], 0
        block.append((item_id, bytes(text)))
        held += len(text)
    yield Index(block, window, gram)


def find_contamination(docs: DataFrame, benchmark: DataFrame, out: str = "hits", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(text, …) with struct `out`: n_words, spans (start and end by word, united), items (ids as strings, sorted).

    A null or empty text has no words. An item of no words is never met; one of fewer than `window`
    words is met as a whole. Items with one id are one item; rows without an id or text are left out.
    Repeated rows each get their result. A column that is already called `out` is replaced, other columns
    stay, whatever their names. A text is held in memory as a whole, at about thirty times its size. Empty
    tables give empty or clean results.
    """
    spark = docs.sparkSession
    rows, result, shared = docs, None, None
    for index in blocks(benchmark, window, min(GRAM, window), block_bytes):
        if result is not None:  # the block before is done with: its rows are written, its broadcast is let go
            told = written(result, "hits")
            shared.destroy()
            if rows is not docs:
                discard(rows)
            rows = told
        shared = spark.sparkContext.broadcast(index)
        result = annotate(rows, shared, out, out if result is not None else None)
    return result


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is also in the benchmark, over both whole tables; edge cases as in `find_contamination`."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT cast(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM i WHERE len(ws) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g
       FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM iw)),
ks AS (SELECT DISTINCT k FROM ig),
dg AS (SELECT r, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g
       FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, ks)),
hit AS (SELECT r, item_id, p, ig.k FROM dg JOIN ig ON dg.g = ig.g AND dg.k = ig.k),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hit)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
