"""64-bit hashes of words and of word windows over Arrow string columns, in numpy.

Words are maximal runs of bytes other than space and \\t..\\r, as in `[^\\x20\\x09-\\x0D]+`.
A word's hash chains its bytes, eight at a time, through a bijection of 64-bit words that spreads every
bit; a word of over LONG bytes is hashed by blake2b. Hashes of windows come from those of halves, so all windows of a
batch take a few array operations for each doubling. No step is a polynomial, so words of a regular build
don't collide by their build.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Seeds: two for words, two for windows of words.
WORD, WORD2, WINDOW, WINDOW2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
#: Bytes of a word that are chained in numpy; longer words are hashed one by one.
LONG = 64
#: Masks of the first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    # The eight bytes from every place on.
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = mix(U64(seed) ^ size.astype(U64))
    left = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        if k:
            left = left[size[left] > k]
        if not len(left):
            break
        some = eight[starts[left] + k] & _FIRST[np.minimum(size[left] - k, 8)]
        out[left] = mix(out[left] ^ some)
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def _joined(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each two neighbouring parts."""
    turned = (y << U64(29)) | (y >> U64(35))
    return (x * U64(seed | 1)) ^ (turned * U64(0x9E3779B97F4A7C15)) ^ (x >> U64(31))


class Words:
    """The words of a batch of texts. Null texts have none."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
        base = self.offsets[0]
        self.data = np.frombuffer(data, dtype=np.uint8)[base : self.offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        self.offsets = self.offsets - base
        if lower:
            self.data = _LOWER[self.data]
        space = _SPACE[self.data]
        edge = np.zeros(len(space) + 1, dtype=bool)
        edge[self.offsets] = True
        inside = ~space
        first, last = inside.copy(), inside.copy()
        first[1:] &= space[:-1] | edge[1:-1]
        last[:-1] &= space[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Words first[d] .. first[d + 1] - 1 are those of text d.
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self, seed: int = WORD) -> np.ndarray:
        return _word_hashes(self.data, self.starts, self.ends, seed)

    def window_starts(self, size: int) -> np.ndarray:
        """Indexes of the words that start a window of `size` words inside one text."""
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        before = np.cumsum(counts) - counts
        return np.arange(counts.sum()) + np.repeat(self.first[:-1] - before, counts)

    def windows(self, hashes: np.ndarray, starts: np.ndarray, size: int, seed: int = WINDOW) -> np.ndarray:
        """Hashes of the windows of `size` words that begin at `starts`."""
        if not len(starts):
            return np.zeros(0, dtype=U64)
        done, part, width, length = None, hashes, 1, 0
        while True:
            if size & width:
                n = len(part) - length
                done = part if done is None else _joined(done[:n], part[length:], seed)
                length += width
            if length == size or len(part) <= width:
                break
            part, width = _joined(part[:-width], part[width:], seed), 2 * width
        return mix(done[starts] ^ U64(size))

    def shingle_sets(self, size: int) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its shingles; of all its words where it has fewer than `size`."""
        hashes, starts = self.hashes(), self.window_starts(size)
        windows, n = self.windows(hashes, starts, size), np.diff(self.first)
        whole = {}
        for fewer in range(1, size):
            short = np.flatnonzero(n == fewer)
            if len(short):
                whole |= zip(short.tolist(), self.windows(hashes, self.first[short], fewer), strict=True)
        cuts = np.concatenate([[0], np.cumsum(np.maximum(n - size + 1, 0))])
        return [np.array([whole[d]], dtype=U64) if d in whole else np.unique(windows[cuts[d] : cuts[d + 1]]) for d in range(len(n))]

    def text(self, d: int) -> bytes:
        """The words of text d, joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[self.first[d] : self.first[d + 1]], self.ends[self.first[d] : self.first[d + 1]], strict=True))
