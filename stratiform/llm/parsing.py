"""Prefix-free parsing of texts: phrases cut by rolling-hash triggers, and their dictionary.

Every `GRAM`-byte string has a hash. The trigger of a `span`-byte window is its string of least hash, the first of
equal ones; a phrase is the stretch of consecutive windows that share a trigger, from the first byte of the first
window to the last byte of the last one. So each window lies in exactly one phrase, overlapping phrases share
`span - 1` bytes, and equal windows have equal triggers at equal places wherever they stand: equal windows are in
phrases that contain the same trigger string.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the rolling hash looks at.
GRAM = 16
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number, without a copy; `data` has eight bytes to spare at its end."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _A
    return (x ^ x >> np.uint64(29)) * _B


def gram_hash(words: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The hash of the GRAM bytes from each position."""
    later = slice(at.start + 8, at.stop + 8) if isinstance(at, slice) else at + 8
    x = words[at] * _A
    x ^= x >> np.uint64(32)
    x += words[later] * _B
    x ^= x >> np.uint64(29)
    x *= _C
    return x


def string_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """A 64-bit hash of data[start:end] for strings of 8 to `longest` bytes, from eight bytes at a time."""
    out = mix((ends - starts).astype(np.uint64))
    for step in range(0, longest, 8):
        # The last bytes are read from the end: a position is read twice rather than past it.
        out = mix(out ^ words[np.minimum(starts + step, ends - 8)])
    return out


def phrases(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, trigger) of each phrase of the texts data[offsets[i]:offsets[i+1]].

    Positions count in `data`, which has eight bytes to spare; texts shorter than `span` have no phrases.
    """
    none = np.zeros(0, np.int64)
    total = int(offsets[-1])
    if total < span:
        return none, none, none, none
    words = words_at(data)
    mask = np.uint64((1 << 24) - 1)
    found = []
    # Pieces of a text that is longer than a slice overlap by a window less a byte.
    for text, lo, hi in _pieces(offsets, span):
        n = hi - lo
        least = gram_hash(words, slice(lo, hi - GRAM + 1)) & ~mask | np.arange(n - GRAM + 1, dtype=np.uint64)
        grams, width = span - GRAM + 1, 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if grams > width:
            least = np.minimum(least[: n - span + 1], least[grams - width :])
        trigger = (least & mask).astype(np.int32)
        first_text, last_text = text
        own = offsets[first_text : last_text + 2] - lo
        fit = np.ones(n - span + 1, bool)
        cut = trigger[1:] != trigger[:-1]
        for end in own[1:-1].tolist():  # windows that reach into the next text
            fit[max(0, end - span + 1) : end] = False
        starts = np.flatnonzero(np.concatenate([[True], cut | ~fit[:-1] | (fit[1:] != fit[:-1])]) & fit)
        ends = np.flatnonzero(np.concatenate([cut | ~fit[1:], [True]]) & fit)
        owner = np.searchsorted(own, starts, "right") - 1 + first_text
        found.append((owner, starts + lo, ends + lo, trigger[starts] + lo))
    return tuple(np.concatenate([f[k] for f in found] or [none]).astype(np.int64) for k in range(4))


def _pieces(offsets: np.ndarray, span: int, limit: int = 1 << 18):
    """((first text, last text), lo, hi): whole texts up to `limit` bytes together, or a part of a longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if j > i + 1 or hi - lo <= limit:
            if hi - lo >= span:
                yield (i, j - 1), lo, hi
        else:
            for at in range(lo, hi - span + 1, limit):
                yield (i, i), at, min(at + limit + span - 1, hi)
        i = j
