"""Token ids of whole texts by a public word-BPE vocabulary.

The vocabulary lower-cases, drops white space and never merges across words, so the ids of a text are
the ids of its words side by side. Each Python worker keeps the ids of the words it has met, in numpy
tables, and asks the tokenizer only for new ones, thousands in a call. Texts with characters other
than ASCII and Latin letters, or with a string that could be a special token, go to the tokenizer whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from sprachwerk.llm.bytewords import LOWER, SPACE, Numbers, hashes, pieces, ragged

# 0 white space, 1 letter, 2 digit, 3 other, 4 not for the fast way
_CLASS = np.full(256, 3, np.uint8)
_CLASS[:32] = 4
_CLASS[127] = 4
_CLASS[SPACE] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[128:192] = 1
_CLASS[192:] = 4
_CLASS[0xC3:0xCA] = 1

#: Byte-level vocabularies write byte b as the visible character _VISIBLE[b].
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: b if b in set(_SHOWN) else 256 + k for b, k in zip(range(256), [sum(x not in set(_SHOWN) for x in range(b)) for b in range(256)], strict=True)}


class WordIds:
    """Ids by the tokenizer in the file at `path`; at most `most` words are remembered."""

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.words = self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, names: np.ndarray, words: list[bytes]) -> None:
        """Ids of new words, from the vocabulary's merges alone: they are in the form that its normaliser would give."""
        tokenize = self.tokenizer.model.tokenize
        for at in range(0, len(words), 4096):
            texts = [w.decode().lower().encode().decode("latin-1").translate(_VISIBLE) for w in words[at : at + 4096]]
            got = [[x.id for x in tokenize(t)] for t in texts]
            length = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.fromiter(chain.from_iterable(got), np.uint32, int(length.sum()))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.words + len(texts) > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.flat[self.used : self.used + len(ids)] = ids
            own = slice(self.words, self.words + len(texts))
            self.start[own] = self.used + np.cumsum(length) - length
            self.length[own] = length
            self.numbers.add(names[at : at + 4096], np.arange(own.start, own.stop, dtype=np.int32))
            self.words, self.used = own.stop, self.used + len(ids)

    def _fast(self, data: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows side by side, and how many each row has."""
        n = len(data)
        cut = np.empty(n + 1, bool)
        cut[0] = cut[n] = True
        cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[rows] = True
        data = LOWER[data]
        quote = np.flatnonzero(data == 39)
        if len(quote):
            quote = quote[cut[quote] & (quote + 1 < n)]
            one = data[quote + 1]
            same = ~cut[np.minimum(quote + 2, n)]
            two = data[np.minimum(quote + 2, n - 1)]
            ends = np.isin(rows, quote + 1)
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = same & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
            inside = ~np.isin(quote + 1, rows[ends]) if ends.any() else np.ones(len(quote), bool)
            inside &= cut[quote + 1]
            cut[quote[(short | long) & inside] + 1] = False
            cut[quote[short & inside] + 2] = True
            cut[quote[long & ~short & inside] + 3] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        word = kind[starts] != 0
        starts, ends = starts[word], ends[word]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(rows) - 1, np.int64)
        names = hashes(data, starts, ends)
        number = self.numbers.get(names)
        if (number < 0).any():
            new, first = np.unique(names[number < 0], return_index=True)
            if self.words + len(new) > self.most and self.words:
                self.forget()
                new, first = np.unique(names, return_index=True)
                where = first
            else:
                where = np.flatnonzero(number < 0)[first]
            raw = data.tobytes()
            self._learn(new, [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            number = self.numbers.get(names)
        length = self.length[number]
        ids = self.flat[ragged(self.start[number], length)]
        upto = np.concatenate([[0], np.cumsum(length)])
        return ids, np.diff(upto[np.searchsorted(starts, rows)])

    def rows(self, column: pa.Array):
        """(row, ids) of each text in order, null as empty. A very long text is put together from its parts."""
        waiting: list[np.ndarray] = []
        last = -1
        for first, data, starts in pieces(column):
            kind = _CLASS[data]
            odd = np.flatnonzero(kind == 4)
            odd = np.concatenate([odd, np.flatnonzero((data[:-1] == 0xC3) & np.isin(data[1:], (0x97, 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0) | (data[:-1] == 60) & (data[1:] == 124))])
            slow = set((np.searchsorted(starts, odd, side="right") - 1).tolist()) if len(odd) else set()
            if slow:
                kind = kind.copy()
                for r in slow:
                    kind[starts[r] : starts[r + 1]] = 0
            ids, counts = self._fast(data, kind, starts)
            ends = np.cumsum(counts)
            for r in range(len(starts) - 1):
                own = self.whole(data[starts[r] : starts[r + 1]].tobytes().decode("utf-8", "replace")) if r in slow else ids[ends[r] - counts[r] : ends[r]]
                if first + r != last:
                    if last >= 0:
                        yield last, waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
                    waiting, last = [], first + r
                waiting.append(own)
        if last >= 0:
            yield last, waiting[0] if len(waiting) == 1 else np.concatenate(waiting)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process, kept over tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
