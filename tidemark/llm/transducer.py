"""A table-driven byte transducer over UTF-8, and a hash table of the words that it finds.

One pass of a finite-state machine reads the bytes of many texts. Its tables give, for a state and a
byte, the next state and what to count: a code point, a capital, a symbol, the start or the end of a
word. The bytes are dealt to lanes that step together, so a step is a few array operations; a lane
learns its state at the start from the four bytes before it, which suffices since every ASCII and
every lead byte puts the machine in a state of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tidemark.llm import grams as G

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#$%&*|"
OUT, WORD, ONE_MORE, TWO_MORE, THREE_MORE = range(5)  # in a character: so many bytes to come
POINT, START, END, CAPITAL, SYMBOL = (1 << k for k in range(5))
LANE = 256  # bytes
WARM = 4  # bytes before a lane that settle its state
COLUMNS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def tables(symbols: bytes = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Next state (times 256) and what to count, by ``256 * state + byte``.

    A byte that can't stand where it does counts as a code point of its own and as part of a word.
    """
    after, count = np.zeros((5, 256), np.uint16), np.zeros((5, 256), np.uint8)
    for state in range(5):
        for b in range(256):
            inside = b not in SPACE
            if b < 0x80:
                to = WORD if inside else OUT
            elif b >= 0xC0:
                to = ONE_MORE if b < 0xE0 else TWO_MORE if b < 0xF0 else THREE_MORE
            else:
                to = {THREE_MORE: TWO_MORE, TWO_MORE: ONE_MORE}.get(state, WORD)
            continues = 0x80 <= b < 0xC0 and state >= ONE_MORE
            after[state, b] = to << 8
            count[state, b] = (
                POINT * (not continues) | START * (inside and state == OUT) | END * (not inside and state != OUT)
                | CAPITAL * (0x41 <= b <= 0x5A) | SYMBOL * (b in symbols)
            )
    return after.ravel(), count.ravel()


_AFTER, _COUNT = tables()


def transduce(data: np.ndarray, after: np.ndarray = _AFTER, count: np.ndarray = _COUNT) -> np.ndarray:
    """What the machine counts at each byte, from its start between words."""
    n = len(data)
    lanes = max(-(-n // LANE), 1)
    padded = np.full(WARM + lanes * LANE, SPACE[0], np.uint8)
    padded[WARM : WARM + n] = data
    steps = np.ascontiguousarray(padded[WARM:].reshape(lanes, LANE).T)
    state = np.zeros(lanes, np.uint16)
    starts = np.arange(lanes) * LANE
    for k in range(WARM):
        state = after[state | padded[starts + k]]
    found = np.empty((LANE, lanes), np.uint8)
    for k in range(LANE):
        at = state | steps[k]
        np.take(count, at, out=found[k], mode="clip")
        state = np.take(after, at, mode="clip")
    return np.ascontiguousarray(found.T).ravel()[:n]


_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _eight(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number; those beyond ``left`` are zero. ``data`` has room for them."""
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    return windows[at].view("<u8").ravel() & _LOW[np.minimum(left, 8)]


def _hashes(data: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    h = G.mix(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64))
    which, done = np.arange(len(start)), 0
    while len(which):
        h[which] = G.mix(h[which] * np.uint64(5) + _eight(data, start[which] + done, length[which] - done))
        done += 8
        which = which[length[which] > done]
    return h


def _same(data: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans ``a`` and ``b`` have one owner and equal bytes."""
    equal = (owner[a] == owner[b]) & (length[a] == length[b])
    which, done = np.flatnonzero(equal), 0
    while len(which):
        left = length[a[which]] - done
        differ = _eight(data, start[a[which]] + done, left) != _eight(data, start[b[which]] + done, left)
        equal[which[differ]] = False
        done += 8
        which = which[~differ & (left > 8)]
    return equal


def first_spans(data: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Marks one span of each set of equal ones, per owner.

    Inserts spans into an open hash table, many at a time: each claims its place if that is free, and
    is compared byte by byte with the span that holds the place. An equal one ends there, others go
    on to the next place of their probe. Equal spans probe alike, so they meet at the same place.
    """
    n = len(start)
    data = np.concatenate((data, np.zeros(8, np.uint8)))
    h = _hashes(data, owner, start, length) if hashes is None else hashes
    size = 1 << (2 * n).bit_length()
    table = np.full(size, -1, np.int64)
    place = (h & np.uint64(size - 1)).astype(np.int64)
    step = (h >> np.uint64(33)).astype(np.int64) | 1  # odd: passes all places
    fresh, open_ = np.zeros(n, bool), np.arange(n)
    while len(open_):
        at = place[open_]
        free = table[at] < 0
        table[at[free]] = open_[free]  # of several the last one written holds it
        holder = table[at]
        mine = holder == open_
        fresh[open_[mine]] = True
        rest = ~mine
        open_, holder = open_[rest], holder[rest]
        open_ = open_[~_same(data, owner, start, length, open_, holder)]
        place[open_] = (place[open_] + step[open_]) & (size - 1)
    return fresh


def text_figures(texts: Sequence[bytes]) -> np.ndarray:
    """Per text: words, distinct words, capitals, code points and symbols. Memory is bounded by the longest text."""
    out = np.zeros((len(texts), len(COLUMNS)), np.int64)
    for a, b in G.groups(texts):
        joined = b"\n".join(texts[a:b]) + b"\n"  # a text ends where white space does
        data = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts[a:b]])
        first = np.cumsum(sizes) - sizes
        found = transduce(data)
        start = np.flatnonzero(found & START)
        length = np.flatnonzero(found & END) - start
        owner = np.searchsorted(first, start, "right") - 1
        once = first_spans(data, owner, start, length)
        out[a:b, 0] = np.bincount(owner, minlength=b - a)
        out[a:b, 1] = np.bincount(owner[once], minlength=b - a)
        for k, what in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            out[a:b, k] = np.add.reduceat((found & what) != 0, first, dtype=np.int64)
        out[a:b, 3] -= 1
    return out
