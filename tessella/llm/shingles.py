"""Word shingles of whole texts as sorted arrays of 64-bit hashes, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together.
BLOCK = 1 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TABLE = np.random.default_rng(0x5EED).integers(0, 1 << 64, 256, dtype=np.uint64)[_LOWER]
_ODD = np.random.default_rng(0xC0DE).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts data[bounds[i]:bounds[i+1]], A-Z lower-cased, and the bounds of each text's words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    first[inner] |= solid[inner]  # a word ends where its text does
    starts = np.flatnonzero(first)
    per = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), per
    # Blanks behind a word belong to its stretch and add nothing.
    stretch = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, stretch)
    tail = data[starts[0] :]
    value = _TABLE[tail] * _powers(int(stretch.max()))[place]
    value[~solid[starts[0] :]] = 0
    sums = np.add.reduceat(value, starts - starts[0])
    length = np.add.reduceat(solid[starts[0] :].astype(np.int64), starts - starts[0])
    return mix(sums ^ (length.astype(np.uint64) * _ODD[63])), per


def shingled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of a text's distinct k-word shingles, ascending; of the whole sequence, if it has fewer words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, k)
    total = np.full(n - width + 1, width, dtype=np.uint64) * _ODD[62]
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * _ODD[j]
    return np.unique(mix(total))


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order; a null text has none."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        # as many texts as a block holds, one at least
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        bounds = offsets[at : to + 1] - offsets[at]
        hashes, per = words(data[offsets[at] : offsets[to]], bounds)
        for i in range(to - at):
            yield shingled(hashes[per[i] : per[i + 1]], k) if valid[at + i] else hashes[:0]
        at = to
