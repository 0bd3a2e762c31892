"""Distinct chunks of a batch of texts, in numpy.

Tokenizers that never merge across a border work chunk by chunk, and most
chunks occur often.  A slice of texts is cut at its borders, equal chunks are
found by a hash and checked byte by byte, each distinct chunk is encoded once,
and the results are gathered back in text order.
"""

from __future__ import annotations

import numpy as np

_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(20240502).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def span_index(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all spans, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or starts.max() < 1 << 31) else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - (ends - sizes)).astype(kind), sizes)


def white_space(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes of white-space characters in UTF-8 data (Unicode White_Space and \\x1c-\\x1f)."""
    ws = np.zeros(256, bool)
    ws[[*range(9, 14), *range(28, 33)]] = True
    out = ws[data]
    for lead, tails in ((0xC2, {(0x85,), (0xA0,)}), (0xE1, {(0x9A, 0x80)}),
                        (0xE2, {(0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)} | {(0x81, 0x9F)}), (0xE3, {(0x80, 0x80)})):
        at = np.flatnonzero(data == lead)
        for tail in tails:
            hit = at[at + len(tail) < len(data)]
            for k, b in enumerate(tail):
                hit = hit[data[hit + 1 + k] == b]
            for k in range(len(tail) + 1):
                out[hit + k] = True
    return out


class DistinctChunks:
    """Chunks of texts laid end to end.

    ``data`` holds the texts' bytes, ``text_starts`` where each begins (with the
    end appended), ``cuts`` the border positions inside texts, ascending (no text starts)."""

    def __init__(self, data: np.ndarray, text_starts: np.ndarray, cuts: np.ndarray):
        begin = text_starts[:-1][np.diff(text_starts) > 0]
        self.starts = np.sort(np.r_[begin, cuts], kind="stable")
        ends = np.r_[self.starts[1:], len(data)]
        self.sizes = ends - self.starts
        #: chunk numbers where each text begins (with the end appended)
        self.text_chunks = np.searchsorted(self.starts, text_starts)
        self.data = data
        if not len(self.starts):
            self.first = self.inverse = np.empty(0, np.int64)
            return
        place = np.arange(len(data), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.sizes)
        key = np.add.reduceat(_BYTE[data] * _PLACE[place & 4095], self.starts)
        del place
        key ^= key >> np.uint64(31)
        key = key * np.uint64(0xBF58476D1CE4E5B9) + self.sizes.astype(np.uint64)
        _, self.first, self.inverse = np.unique(key, return_index=True, return_inverse=True)
        if not self._equal():
            self.first = self.inverse = np.arange(len(self.starts))

    def _equal(self) -> bool:
        """Whether every chunk equals its representative."""
        rep = self.first[self.inverse]
        if not np.array_equal(self.sizes[rep], self.sizes):
            return False
        step = 1 << 20
        for i in range(0, len(rep), step):
            a, b, n = self.starts[i:i + step], self.starts[rep[i:i + step]], self.sizes[i:i + step]
            if not np.array_equal(self.data[span_index(a, n)], self.data[span_index(b, n)]):
                return False
        return True

    def gather(self, pool: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Results of all chunks in text order, from a pool of the distinct chunks'
        results (``offsets`` with the end appended), and where each text's begin."""
        sizes = np.diff(offsets)[self.inverse]
        out = pool[span_index(offsets[:-1][self.inverse], sizes)]
        return out, np.r_[0, np.cumsum(sizes)][self.text_chunks]


def join_texts(texts: list[str], front: str = "") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, each non-empty one with ``front`` before it, and their starts."""
    raw = [(front + t).encode() if t else b"" for t in texts]
    starts = np.r_[0, np.cumsum([len(r) for r in raw], dtype=np.int64)]
    return np.frombuffer(b"".join(raw), np.uint8), starts
