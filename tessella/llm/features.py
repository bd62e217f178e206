"""Hashed word features of whole texts, sentence by sentence, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessella.llm.shingles import _BLANK, _ODD, _TABLE, _powers, mix

#: Bytes of text that are looked at together.
BLOCK = 1 << 20
#: Bits of a feature's hash.
BITS = 30
#: A word's features: the whole word, and its first so many bytes if it has more. Letters of A-Z count as lower-case.
PREFIXES = (4, 5, 6)
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True
_EDGE = np.zeros(256, dtype=bool)  # ASCII that is no letter or digit, stripped from a word's ends by leaving it out
_EDGE[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = True


@dataclass
class Block:
    """Words of a few texts: feature slots (a row per word), and where words, sentences and texts begin."""

    slots: np.ndarray  # words x (1 + len(PREFIXES)); -1 where a word is too short for a prefix
    starts: np.ndarray  # byte of each word's start
    ends: np.ndarray  # byte behind each word's end
    sentence: np.ndarray  # first word of each sentence
    sentences_of: np.ndarray  # bounds of each text's sentences, one more than texts
    bounds: np.ndarray  # bounds of each text's bytes
    data: np.ndarray


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h ^ _ODD[kind]) >> np.uint64(64 - BITS)).astype(np.int32)


def block(data: np.ndarray, bounds: np.ndarray) -> Block:
    """Words are runs without blanks; ASCII punctuation counts for nothing in them; sentences end at . ! ? and line feeds."""
    count = len(bounds) - 1
    width = 1 + len(PREFIXES)
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    first[inner] |= solid[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Block(np.zeros((0, width), np.int32), none, none, none, np.zeros(count + 1, np.int64), bounds, data)
    stretch = np.diff(np.append(starts, len(data)))
    lead = starts[0]
    tail = data[lead:]
    letter = solid[lead:] & ~_EDGE[tail]
    # place among the letters of its word
    upto = np.cumsum(letter)
    before = upto[starts - lead] - letter[starts - lead]
    place = upto - 1 - np.repeat(before, stretch)
    place[~letter] = 0
    value = _TABLE[tail] * _powers(int(place.max()) + 1)[place]
    value[~letter] = 0
    at = starts - lead
    letters = np.add.reduceat(letter.astype(np.int64), at)
    slots = np.empty((len(starts), width), np.int32)
    slots[:, 0] = _slot(np.add.reduceat(value, at) ^ (letters.astype(np.uint64) * _ODD[60]), 0)
    for j, n in enumerate(PREFIXES, 1):
        part = np.where(place < n, value, np.uint64(0))
        slots[:, j] = np.where(letters > n, _slot(np.add.reduceat(part, at), j), -1)
    slots[letters == 0] = -1
    ends = starts + np.add.reduceat(solid[lead:].astype(np.int64), at)
    # A word begins a sentence if an end mark, or the text's start, lies between it and the word before.
    stops = np.cumsum(_END[data])
    mark = stops[starts] - _END[data[starts]]
    text = np.searchsorted(bounds, starts, side="right") - 1
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
    sentence = np.flatnonzero(new)
    return Block(slots, starts, ends, sentence, np.searchsorted(text[sentence], np.arange(count + 1)), bounds, data)


def blocks(texts: pa.Array) -> Iterator[Block]:
    """The texts of a batch in order, block by block; a null text has no words."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        yield block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
