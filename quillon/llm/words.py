"""Hashes of words and their parts, over whole batches of texts with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64, pieces
from .minhash import powers
from .suffix_dedup import BYTE, R

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(97, 123), *range(128, 256)]] = True


class Words:
    """Runs of letters in lower-cased texts: doc, start and stop of each, and hashes of byte ranges."""

    def __init__(self, data: list[bytes]):
        self.buf = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        size = np.array([len(t) + 1 for t in data], np.int64)
        self.begin = np.cumsum(size) - size
        letter = IS_LETTER[self.buf]
        edge = np.diff(np.r_[np.int8(0), letter.view(np.int8)])
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1
        up, self.down = powers(len(self.buf) + 1)
        self.total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(BYTE[self.buf] * up[:-1], out=self.total[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray, kind: int) -> np.ndarray:
        h = (self.total[stop] - self.total[start]) * self.down[start]
        return mix64(h + np.uint64(kind * R & (1 << 64) - 1))


def groups(texts: list[str], most: int = 1 << 20, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(places of the texts, skips, pieces): lower-cased texts, about `most` bytes at a time; longer ones in pieces."""
    docs, skips, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for skip, piece in pieces(t.lower().encode("utf-8", "surrogatepass"), most, overlap):
            docs.append(i), skips.append(skip), held.append(piece)
            size += len(piece)
            if size >= most:
                yield np.array(docs), np.array(skips), held
                docs, skips, held, size = [], [], [], 0
    if held:
        yield np.array(docs), np.array(skips), held
