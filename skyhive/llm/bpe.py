"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct piece encoded once.

A byte-level BPE splits a text into pretokens and encodes each by itself. `cuts` finds places where a
pretoken starts whatever stands further away (before a single space between two visible characters,
between a letter and a mark, around a single line feed); between such places the ids of a piece do not
depend on its surroundings. A corpus repeats its pieces, so the library encodes those it has not met yet,
and the ids of a text are gathered from the pool.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from skyhive.llm.common import spans

_OTHER, _LETTER, _MARK, _APOSTROPHE, _DIGIT, _SPACE, _LINE = range(7)
_KIND = np.full(256, _OTHER, np.uint8)
for _c in range(33, 127):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _APOSTROPHE if chr(_c) == "'" else _MARK
_KIND[32], _KIND[10] = _SPACE, _LINE


def cuts(data: np.ndarray) -> np.ndarray:
    """True at bytes of UTF-8 where a pretoken surely starts. Characters beyond Latin letters are not judged."""
    n = len(data)
    kind = np.zeros(n + 3, np.uint8)  # one byte before and two after
    kind[1:n + 1] = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # not the signs for times and divided by
    kind[lead + 1] = kind[lead + 2] = _LETTER
    seen = (kind >= _LETTER) & (kind <= _DIGIT)
    before, here, after = kind[:n], kind[1:n + 1], kind[2:n + 2]
    starts = (here == _SPACE) & seen[:n] & seen[2:n + 2]
    starts |= (here == _LINE) & seen[:n]
    starts |= (before == _LETTER) & ((here == _MARK) | (here == _APOSTROPHE))
    starts |= (before == _MARK) & (here == _LETTER)
    if n > 1:
        starts[1:] |= (before[1:] == _LINE) & seen[:n - 1] & seen[2:n + 1]
    return starts


class PieceEncoder:
    """encode(texts) gives the number of ids of each text and all ids in a row.

    A text falls into pieces whose ids depend on nothing else: `starts` marks them, `ids_of` encodes them. At
    most `limit` distinct pieces are kept between calls; beyond that the pool starts anew, so memory does not
    grow with the corpus.
    """

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self._clear()

    def starts(self, data: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0

    def _add(self, pieces: list[bytes]) -> None:
        encoded = self.ids_of(pieces)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        total, first = int(lengths.sum()), len(self.slot)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(pieces) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.pool[self.used:self.used + total] = np.fromiter((i for ids in encoded for i in ids), np.int32, total)
        self.start[first:first + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.length[first:first + len(pieces)] = lengths
        self.slot.update(zip(pieces, range(first, first + len(pieces))))
        self.used += total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if not len(texts) or bounds[0] == bounds[-1]:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        starts = self.starts(data)
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(starts)
        edges = np.append(starts, len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        pieces = pieces.dictionary_encode()
        names, which = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        if len(self.slot) > self.limit:
            self._clear()
        fresh = [p for p in names if p not in self.slot]
        for i in range(0, len(fresh), 20_000):
            self._add(fresh[i:i + 20_000])
        slots = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))[which]
        lengths = self.length[slots]
        ids = self.pool[spans(self.start[slots], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, bounds)]
        return np.diff(ends), ids


class Encoder(PieceEncoder):
    """Byte-level BPE of a tokenizers file. Special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        super().__init__(limit)

    def starts(self, data: np.ndarray) -> np.ndarray:
        return cuts(data)

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
