"""Words and shingles of many texts at once, as 64-bit hashes in NumPy arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bytes of text that are worked on together; a longer text is worked on alone.
SLICE = 1 << 20
#: Words of more bytes are hashed by a digest.
LONG_WORD = 512
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)  # the first k of 8 bytes


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a UTF-8 text; blanks are ASCII, so no character is cut."""
    blank = np.ones(len(raw) + 2, dtype=bool)
    blank[1:-1] = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def edge_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step."""
    size = ends - starts
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix((size.astype(np.uint64) * C) ^ ((eight[starts] & _HEAD[np.minimum(size, 8)]) * A))
    live = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at, left = starts[live] + 8, size[live] - 8
    while len(live):
        out[live] = mix((out[live] ^ (eight[at] & _HEAD[np.minimum(left, 8)])) * A + C)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = np.frombuffer(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), dtype=np.uint64)[0]
    return out


def word_hashes(raw: np.ndarray) -> np.ndarray:
    return edge_hashes(raw, *word_edges(raw))


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes together."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield first, k
            first, size = k, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased, laid end to end, and where each text's begin and end.

    A text of fewer than `words` words is one shingle.
    """
    raw = np.frombuffer(b" ".join(texts).lower(), dtype=np.uint8)  # bytes.lower() changes A-Z alone
    starts, ends = word_edges(raw)
    h = edge_hashes(raw, starts, ends)
    lengths = np.array([len(t) for t in texts], dtype=np.int64) + 1
    first = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
    n_words = np.diff(first)

    def joined(at: np.ndarray | slice, size: int, upto: int) -> np.ndarray:
        out = h[at] if isinstance(at, np.ndarray) else h[: upto]
        for j in range(1, size):
            out = mix(out * A + (h[at + j] if isinstance(at, np.ndarray) else h[j : upto + j]))
        return mix(out + np.uint64(size))

    count = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    begin = np.r_[0, np.cumsum(count)]
    flat = np.empty(begin[-1], dtype=np.uint64)
    is_short = np.repeat(n_words < words, count)
    upto = len(h) - words + 1
    if upto > 0:
        inside = np.ones(upto, dtype=bool)
        for k in range(1, words):  # windows that reach into the next text
            cross = first[1:] - k
            inside[cross[(cross >= 0) & (cross < upto)]] = False
        flat[~is_short] = joined(slice(0), words, upto)[inside]
    for size in range(1, words):
        of_size = np.flatnonzero(n_words == size)
        flat[begin[of_size]] = joined(first[of_size], size, 0)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        flat[a:b].sort()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[begin[:-1][count > 0]] = True
    return flat[new], np.r_[0, np.cumsum(new)][begin]
