"""Vectorised words, rolling hashes and window minima over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 18  # bytes handled at a time, so that working arrays stay in the processor's cache


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the 64 (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    lengths = ends - starts
    letters = _RANDOM[data[inside]]
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(letters)) - np.repeat(first, lengths)
    letters *= powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(letters, first) + lengths.astype(np.uint64)), starts, ends


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word; a long text is taken in pieces cut at white space."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= 2 * PIECE:
        return _piece_words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            step = np.flatnonzero(_SPACE[data[end : end + PIECE]])
            end = end + int(step[0]) if len(step) else min(end + PIECE, len(data))
        h, s, e = _piece_words(data[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(p) for p in zip(*parts))


def groups(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are handled together: about a piece, or one long text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def joined_words(texts: Sequence[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts joined by newlines: the bytes, word hashes, starts, ends, and each text's first word (and the end)."""
    data = b"\n".join(texts)
    h, s, e = word_hashes(data)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, h, s, e, np.searchsorted(s, offsets)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` elements, by its first element."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for k, p in enumerate(powers(n)):
        out += h[k : k + m] * p
    return mix(out)


def byte_gram_hashes(data: np.ndarray, doublings: int) -> np.ndarray:
    """Hash of the ``2 ** doublings`` bytes from each position."""
    h = _RANDOM[data]
    for k in range(doublings):
        step = 1 << k
        if len(h) <= step:
            return np.empty(0, np.uint64)
        h = h[:-step] * powers(step + 1)[step] + h[step:]
    return mix(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    if len(h) < width:
        return h[:0]
    step = 1
    low = h
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    over = width - step
    return np.minimum(low[:-over], low[over:]) if over else low


def span_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the elements in ``[first, last)``, the same wherever they stand."""
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=sums[1:])
    return mix((sums[last] - sums[first]) * powers(len(h) + 1, inverse)[first] + (last - first).astype(np.uint64))
