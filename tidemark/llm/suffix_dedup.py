"""Suffix-array dedup: every byte of a long string that stands anywhere else is removed.

On request so is every passage of so many words that does, however few bytes it has.

Common prefixes come from breadth-first backward extension on a Burrows-Wheeler transform, by
increasing value, and the search stops at the least length that counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import grams as G
from tidemark.llm import window_dedup as W
from tidemark.llm.common import table
from tidemark.llm.passages import Unit, byte_runs, covered, doc_keys, marked_runs, word_runs

LENGTH = 400  # bytes
_PACK = 7  # symbols of nine bits in a number


def sort_rotations(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the rotations of ``symbols``, in order by at least ``depth`` symbols; and the first seven packed."""
    n = len(symbols)
    around = np.resize(symbols, n + _PACK).astype(np.int64)
    packed = np.zeros(n, np.int64)
    for k in range(_PACK):
        packed = packed << 9 | around[k : k + n]
    key, known = packed, _PACK
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        groups = np.cumsum(ordered[1:] != ordered[:-1])
        rank[order] = np.concatenate(([0], groups))
        if known >= depth or n == 1 or groups[-1] == n - 1:
            return order, packed
        shift = known % n
        key = rank * n + np.concatenate((rank[shift:], rank[:shift]))
        known *= 2


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ranks in the intervals, and the interval of each."""
    sizes = high - low
    of = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes - low, sizes), of


def _packed_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a ^ b
    return sum((differ >> 9 * (_PACK - 1 - k) == 0).astype(np.int16) for k in range(_PACK))


def common_prefix_reaches(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rotations, and for each whether it shares ``length`` symbols with the one before.

    Intervals of ranks with a common prefix are extended backward through the transform, all of one
    prefix length at a time. An extension that reaches a border not known yet gives it the present
    length and goes on; others stop. Borders still unknown at ``length`` share at least so much. The
    first 14 lengths are read off the packed sorting keys.
    """
    n = len(symbols)
    order, packed = sort_rotations(symbols, length)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    step = rank[order - 1]  # where the rotation that starts one symbol earlier stands
    lead = symbols[order]
    prefix = np.full(n + 1, -1, np.int16)
    prefix[0] = prefix[n] = 0
    if length > 2 * _PACK and n > 1:
        depth = 2 * _PACK
        near = _packed_prefix(packed[order[1:]], packed[order[:-1]])
        further = packed[(order + _PACK) % n]
        near = np.where(near < _PACK, near, _PACK + _packed_prefix(further[1:], further[:-1]))
        prefix[1:n] = np.where(near < depth, near, -1)
        borders = np.append(np.flatnonzero(prefix[:n] >= 0), n)
        low, high = borders[:-1], borders[1:]
        fresh = (prefix[high] == depth - 1) & (high < n)
        low, high = low[fresh], high[fresh]
    else:
        depth, low, high = 0, np.zeros(1, np.int64), np.full(1, n, np.int64)
    for known in range(depth, length):
        if not len(low):
            break
        ranks, of = _expand(low, high)
        key = np.sort(of << 32 | step[ranks])
        ranks, of = key & 0xFFFFFFFF, key >> 32
        symbol = lead[ranks]
        breaks = np.append(True, (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1]))
        first = np.flatnonzero(breaks)
        low, high = ranks[first], ranks[np.append(first[1:], len(ranks)) - 1] + 1
        fresh = prefix[high] < 0
        low, high = low[fresh], high[fresh]
        prefix[high] = known
    return order, prefix[:n] < 0


def repeated_strings(rows: Sequence[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """For each content, which of its ``length``-byte strings also start elsewhere in the contents."""
    sizes = np.array([len(r[0]) for r in rows])
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(int(ends[-1]), np.uint16)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).astype(np.uint16) + 1
    order, shared = common_prefix_reaches(symbols, length)
    starts = ends - sizes - 1
    valid = np.zeros(len(symbols), bool)
    for s, size in zip(starts.tolist(), sizes.tolist()):
        valid[s : s + max(size - length + 1, 0)] = True
    alike = np.cumsum(~shared) - 1
    counts = np.bincount(alike, weights=valid[order])
    hit = np.zeros(len(symbols), bool)
    hit[order] = counts[alike] > 1
    hit &= valid
    return [hit[s : s + max(size - length + 1, 0)] for s, size in zip(starts.tolist(), sizes.tolist())]


def _contents(text: bytes, runs: Sequence[tuple[int, int]], window: int) -> list[bytes]:
    return [text[s : s + c + window - 1] for s, c in runs]


def _windows(content: bytes, window: int) -> list[bytes]:
    return [content[i : i + window] for i in range(len(content) - window + 1)]


def byte_unit(length: int) -> Unit:
    return Unit(length, byte_runs, _contents, _windows, repeated_strings, True)


def repeated_windows(rows: Sequence[tuple[bytes, int, int]], window: int) -> list[np.ndarray]:
    """For each packed string, which of its windows of words also start elsewhere in the strings."""
    found = [W._windows(r[0], window) for r in rows]
    seen = Counter(w for windows in found for w in windows)
    return [np.array([seen[w] > 1 for w in windows], bool) for windows in found]


def passage_unit(words: int) -> Unit:
    return Unit(words, word_runs, W._contents, W._windows, repeated_windows, True)


def _remover(length: int, as_text: bool, words: int | None):
    @F.pandas_udf(f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")
    def remove(texts: pd.Series, places: pd.Series, passages: pd.Series) -> pd.DataFrame:
        out = []
        for text, marks, word_marks in zip(texts, places, passages):
            data = text.encode("utf-8", "surrogatepass")
            spans = covered(marks, length, len(data))
            if word_marks is not None and len(word_marks):
                _, starts, ends = G.word_hashes(data)
                found = covered(word_marks, words, len(starts))
                spans = _joined(np.concatenate((spans, np.stack([starts[found[:, 0]], ends[found[:, 1] - 1]], 1))))
            kept, at = [], 0
            for a, b in spans.tolist():
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((left.decode("utf-8", "ignore") if as_text else left, len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans)))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    return remove


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans in order, those that overlap or touch as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    gap = np.append(True, spans[1:, 0] > end[:-1])
    return np.stack([spans[gap, 0], end[np.append(np.flatnonzero(gap)[1:] - 1, len(end) - 1)]], 1)


def _marks(docs: DataFrame, unit: Unit, name: str, places: str) -> DataFrame:
    return marked_runs(docs, unit, name).withColumnsRenamed({"places": places, "doc": f"{places}_doc", "th": f"{places}_th"})


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, as_text: bool = False, words: int | None = None) -> DataFrame:
    """``docs`` as ``row``, with ``removal``: what is kept, and the numbers of bytes and removed runs.

    What is kept is bytes, or with ``as_text`` text, in which a character that was cut is left out.

    A byte goes if a string of ``length`` bytes that covers it starts at another place too, in any
    text including its own; overlapping places count, and all is judged on the input. A string never
    crosses from one text into another. Null text is empty, texts shorter than ``length`` stay whole.
    With ``words``, a run of so many words that starts at another place too goes as well, whatever its
    bytes and the white space between them; the white space around it stays.
    Repeated rows are texts of their own, so long ones go altogether; rows with one id, or none, are
    told apart by a check of their text. All given columns stay, also ones named like the results.
    """
    keyed = doc_keys(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", "row.doc_id", "row.text"))
    units = {"__bytes": (byte_unit(length), "suffix")} | ({"__words": (passage_unit(words), "passages")} if words else {})
    for places, (unit, name) in units.items():
        marks = _marks(docs, unit, name, places)
        keyed = keyed.join(marks, (F.col("doc") == F.col(f"{places}_doc")) & (F.col("th") == F.col(f"{places}_th")), "left")
    passages = F.col("__words") if words else F.lit(None).cast("array<long>")
    return keyed.select("row", _remover(length, as_text, words)(F.coalesce("text", F.lit("")), F.col("__bytes"), passages).alias("removal"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select(
        "row.doc_id", "removal.n_bytes", "removal.n_removed", "removal.n_spans", F.sha2("removal.kept", 256).alias("kept_sha256")
    )


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
