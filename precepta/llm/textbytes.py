"""Words, their hashes and shingles of a whole Arrow batch of texts at once, as numpy arrays over the UTF-8 bytes.

Positions are bytes; `first` holds, for each text and one past the last, the index of its first word, so the words of
text i are first[i]:first[i + 1]. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
#: Bytes that belong to a word: all but white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2^64, and those of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[name] = np.cumprod(run)
    return _powers["up"][:n], _powers["down"][:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts of about SLICE_BYTES."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1)
        yield begin, raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words."""
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    if len(word):
        before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros_like(word)
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z if fold."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE[_FOLDED] if fold else _BYTE)[data] * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start])


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of n words; a text of fewer words, but not none, has one run of them all."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(first[:-1], counts)
    whole = place + n <= np.repeat(counts, counts)
    run, at = np.zeros(len(words), np.uint64), np.arange(len(words))
    for k in range(n):
        run = run * _ODD + words[np.minimum(at + k, max(len(words) - 1, 0))]
    grams, texts = mix(run[whole]), text[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        few = []
        for i in short:
            h = int(counts[i])
            for w in words[first[i] : first[i + 1]].tolist():
                h = (h * int(_ODD) + w) % (1 << 64)
            few.append(h)
        grams = np.concatenate([grams, mix(np.array(few, np.uint64))])
        texts = np.concatenate([texts, short])
    return grams, texts


def distinct(grams: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each text's distinct hashes in ascending order."""
    order = np.lexsort((grams, texts))
    grams, texts = grams[order], texts[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (texts[1:] != texts[:-1])
        grams, texts = grams[new], texts[new]
    return grams, np.searchsorted(texts, np.arange(n + 1))
