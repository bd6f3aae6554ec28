"""Word and shingle digests of a text as NumPy arrays, in bounded pieces."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 18
_TABLES: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to the size of a chunk."""
    if not _TABLES:
        inverse = pow(BASE, -1, 1 << 64)
        for b in (BASE, inverse):
            powers = np.full(CHUNK + 1, b, np.uint64)
            powers[0] = 1
            _TABLES.append(np.multiply.accumulate(powers))
    return _TABLES


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _separators(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _chunk_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word."""
    solid = np.empty(len(data) + 2, np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_separators(data)
    turns = np.flatnonzero(np.diff(solid))
    return turns[0::2], turns[1::2]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit digest of each word, in order: a polynomial over its bytes, mixed."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    powers, inverse = tables()
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_separators(data[at:end]))
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word longer than a chunk, on its own
                ahead = end
                while ahead < len(data):
                    gaps = np.flatnonzero(_separators(data[ahead : ahead + CHUNK]))
                    if len(gaps):
                        break
                    ahead += CHUNK
                stop = ahead + int(gaps[0]) if len(gaps) else len(data)
                value = 0
                for k in range(at, stop, CHUNK):
                    piece = data[k : min(k + CHUNK, stop)].astype(np.uint64)
                    here = int(np.sum((piece + np.uint64(1)) * powers[: len(piece)], dtype=np.uint64))
                    value = (value * int(powers[-1]) + here) % (1 << 64)
                parts.append(mix(np.array([value], np.uint64)))
                at = stop
                continue
        piece = data[at:end]
        starts, ends = _chunk_words(piece)
        if len(starts):
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers[: len(piece)], out=sums[1:])
            parts.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


_STEPS = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64
)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct digests of all runs of ``size`` words; a shorter text is one run, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    count = max(n - size + 1, 1)
    size = min(size, n)
    total = np.full(count, size, np.uint64)
    for k in range(size):
        total += hashes[k : k + count] * _STEPS[k % len(_STEPS)] * np.uint64(2 * (k // len(_STEPS)) + 1)
    return np.unique(mix(total))
