"""Words of many texts at once, as arrays: where they stand and which are equal.

Words are runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

#: 1 for bytes of words: 0-9, a-z (A-Z are lower-cased) and all of non-ASCII characters.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], dtype=np.uint8)


def find_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and the first byte and the byte past the end of every word."""
    folded = FOLD[data]
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = folded != 0
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return folded, turn[0::2], turn[1::2]


def _eights(folded: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number."""
    padded = np.concatenate([folded, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(folded) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _first(part: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The first ``cut`` bytes (up to 8) of each number."""
    cut = np.minimum(cut, 8).astype(np.uint64)
    return np.where(cut < 8, part & ((np.uint64(1) << (cut % np.uint64(8) * np.uint64(8))) - np.uint64(1)), part)


def hash_words(folded: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, by sums of 8-byte pieces with odd multipliers."""
    eights = _eights(folded)
    size = end - begin
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, left, live = begin, size, np.arange(len(begin))
    while len(live):
        h = (out[live] ^ _first(eights[at], left)) * np.uint64(0xBF58476D1CE4E5B9)
        out[live] = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(32))
        more = left > 8
        at, left, live = at[more] + 8, left[more] - 8, live[more]
    return out


def differ(folded: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word's bytes are not those of the word number ``other`` beside it."""
    eights = _eights(folded)
    size = end - begin
    out = size != size[other]
    live = np.flatnonzero(~out & (other != np.arange(len(begin))))
    at, to, left = begin[live], begin[other[live]], size[live]
    while len(live):
        out[live] = _first(eights[at], left) != _first(eights[to], left)
        more = (left > 8) & ~out[live]
        at, to, left, live = at[more] + 8, to[more] + 8, left[more] - 8, live[more]
    return out


def number_words(folded: np.ndarray, begin: np.ndarray, end: np.ndarray, hashed=hash_words) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and for each word its number among them.

    Words are brought together by their hashes and then compared byte by byte, so
    equal numbers mean equal words; words that only share a hash are told apart.
    """
    _, first, term = np.unique(hashed(folded, begin, end), return_index=True, return_inverse=True)
    words = [folded[b:e].tobytes() for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
    odd = np.flatnonzero(differ(folded, begin, end, first[term])) if len(begin) else np.zeros(0, dtype=np.int64)
    if len(odd):
        known: dict[bytes, int] = {}
        for i in odd.tolist():
            w = folded[begin[i] : end[i]].tobytes()
            if w not in known:
                known[w] = len(words)
                words.append(w)
            term[i] = known[w]
    return words, term
