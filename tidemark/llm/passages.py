"""Finding repeated windows of texts by the minimiser of each window.

Every window of a text (so many words, or bytes) is known by the least hash among its short grams.
Consecutive windows with the same minimiser form a run, and a run travels as one row to the bucket
of its minimiser; equal windows have equal minimisers, so they meet there and nowhere else. First
only hashes of runs travel: a bucket with one run is done, and runs with equal hashes are equal.
Only where a bucket holds different runs is the text of each of them fetched, once, and its
windows compared. Buckets above a size are compared by window hash instead, in an aggregation that
combines on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import grams as G
from tidemark.llm.common import written

MAX_RUN = 1024  # windows of a run, longer ones are cut
BUCKET_RUNS = 4096  # different runs of a bucket that one task compares
NO_ID = (1 << 63) - 1

Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # text, start, count, minimiser, hash


@dataclass(frozen=True)
class Unit:
    """What windows are made of, and which of equal windows are marked."""

    window: int
    runs: Callable[[Sequence[bytes], int], Iterator[Run]]
    contents: Callable[[bytes, Sequence[tuple[int, int]], int], list[bytes]]  # text, (start, count) of runs
    windows: Callable[[bytes, int], list[bytes]]  # the windows of a run's content
    repeated: Callable[[list[tuple[bytes, int, int]], int], list[np.ndarray]]  # (content, doc, start): marks by window
    all_places: bool  # mark every place of a repeated window, else all but the first


def cut_runs(value: np.ndarray, valid: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of equal values among the valid windows."""
    n = len(value)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = np.ones(n, bool)
    breaks[1:] = (value[1:] != value[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(breaks)
    count = np.diff(np.append(first, n))
    keep = valid[first]
    first, count = first[keep], count[keep]
    if len(count) and count.max() > MAX_RUN:
        pieces = -(-count // MAX_RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, count = np.repeat(first, pieces) + nth * MAX_RUN, np.minimum(MAX_RUN, np.repeat(count, pieces) - nth * MAX_RUN)
    return first, count


PLACE_BITS = 20
SLICE = 1 << 19  # windows taken together, so that every place in a slice fits its bits


def placed(hashes: np.ndarray) -> np.ndarray:
    """Hashes with their place in the lowest bits: the least of a window is its leftmost least gram.

    A run then has its minimiser at one place. Equal windows have it equally far from their start,
    so no two windows of a run are equal.
    """
    bits = np.uint64(PLACE_BITS)
    return (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)


def unplaced(low: np.ndarray) -> np.ndarray:
    return low >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)


def word_runs(texts: Sequence[bytes], window: int, gram: int = 6) -> Iterator[Run]:
    gram = min(gram, window)
    for a, b in G.groups(texts):
        _, h, _, _, first_word = G.joined_words(texts[a:b])
        for at in range(0, max(len(h) - window + 1, 0), SLICE):
            low = G.window_minima(placed(G.gram_hashes(h[at : at + SLICE + window - 1], gram)), window - gram + 1)
            place = np.arange(at, at + len(low))
            text = np.searchsorted(first_word, place, "right") - 1
            first, count = cut_runs(low, place + window <= first_word[text + 1], text)
            of = text[first]
            first_at = first + at
            yield of + a, first_at - first_word[of], count, unplaced(low[first]), G.span_hashes(h, first_at, first_at + count + window - 1)


def byte_runs(texts: Sequence[bytes], window: int, doublings: int = 5) -> Iterator[Run]:
    while 1 << doublings > window:
        doublings -= 1
    for a, b in G.groups(texts):
        data = b"\n".join(texts[a:b])
        lengths = np.array([len(t) for t in texts[a:b]])
        offset = np.cumsum(lengths + 1) - lengths - 1
        view = memoryview(data)
        for at in range(0, max(len(data) - window + 1, 0), SLICE):
            piece = np.frombuffer(data, np.uint8)[at : at + SLICE + window - 1]
            low = G.window_minima(placed(G.byte_gram_hashes(piece, doublings)), window - (1 << doublings) + 1)
            place = np.arange(at, at + len(low))
            text = np.searchsorted(offset, place, "right") - 1
            valid = place + window <= offset[text] + lengths[text]
            first, count = cut_runs(low, valid, text)
            of = text[first]
            hashes = [xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip((first + at).tolist(), (first + at + count + window - 1).tolist())]
            yield of + a, first + at - offset[of], count, unplaced(low[first]), np.array(hashes, np.uint64)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def _place(start, count):
    """Start and number of windows in one number; also the order of places in a document."""
    return (start << 20) | count


def _unplace(place):
    return place >> 20, place & 0xFFFFF


# A text is known by its id and a 64-bit hash of it (``doc, th``), carried whole.
RUN_SCHEMA = "b long, sh long, doc long, th long, place long"  # a mark is a row with a negative place
NOTE_SCHEMA = "b long, doc long, th long, place long, kind int"  # 0: marked, 1: its text is asked for
_RUN = pa.schema([(c, pa.int64()) for c in ("b", "sh", "doc", "th", "place")])
_NOTE = pa.schema([*[(c, pa.int64()) for c in ("b", "doc", "th", "place")], ("kind", pa.int32())])
_PART = pa.schema([*[(c, pa.int64()) for c in ("b", "doc", "th", "place")], ("content", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64())])
PART_SCHEMA = "b long, doc long, th long, place long, content binary, h1 long, h2 long"


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _scan(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            ids, checks = batch["doc"].to_numpy(), batch["th"].to_numpy()
            found = [r for r in unit.runs(texts, unit.window) if len(r[0])]
            if not found:
                continue
            text, start, count, low, hashes = (np.concatenate(c) for c in zip(*found))
            b, sh, doc, th = _signed(low), _signed(hashes), ids[text], checks[text]
            place = _place(start.astype(np.int64), count.astype(np.int64))
            # runs that this batch holds twice are settled here: one of each goes on
            order = np.argsort(b)
            same = np.zeros(len(b) + 1, bool)
            same[1:-1] = b[order][1:] == b[order][:-1]
            several = order[same[1:] | same[:-1]]
            several = several[np.lexsort((th[several], place[several], doc[several], sh[several], b[several]))]
            after = np.zeros(len(several) + 1, bool)
            if len(several):
                x, y = several[1:], several[:-1]
                after[1:-1] = (b[x] == b[y]) & (sh[x] == sh[y])
            later = several[after[:-1]]
            marked, settled = several[after[:-1] | after[1:]] if unit.all_places else later, later
            if not unit.all_places and len(later):
                # an equal place is no earlier one: it is the same row again, or another row with that id, which goes on
                head = np.maximum.accumulate(np.where(after[:-1], -1, np.arange(len(several))))[after[:-1]]
                first = several[head]
                behind = (doc[later] != doc[first]) | (place[later] >> 20 != place[first] >> 20)
                marked, settled = later[behind], later[behind | (th[later] == th[first])]
            gone = np.zeros(len(b), bool)
            gone[settled] = True
            on = ~gone
            yield _batch(_RUN, b[on], sh[on], doc[on], th[on], place[on])
            if len(marked):
                spread = _signed(G.mix(doc[marked].astype(np.uint64)))
                yield _batch(_RUN, spread, np.zeros(len(marked), np.int64), doc[marked], th[marked], -place[marked] - 1)

    return run


def _settle(all_places: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a bucket come together, sorted by run hash and place; keeps one of them in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.empty(0, np.int64) for _ in range(5))
        head = None  # b, sh, doc, th, place of the first run with this hash
        waiting = marked = False  # the bucket's first run is not asked for yet; the head is marked
        batches = iter(batches)
        while True:
            batch = next(batches, None)
            fresh = tuple(np.empty(0, np.int64) for _ in range(5)) if batch is None else tuple(batch[c].to_numpy() for c in ("b", "sh", "doc", "th", "place"))
            columns = tuple(np.concatenate(p) for p in zip(held, fresh))
            b, place = columns[0], columns[4]
            upto = len(b) if batch is None else max(len(b) - 1, 0)
            held = tuple(c[upto:] for c in columns)
            same = np.zeros(len(b) + 1, bool)
            same[1:-1] = b[1:] == b[:-1]
            if head is not None and len(b):
                same[0] = head[0] == b[0]
            done = place < 0
            wanted = np.flatnonzero((same[1:] | same[:-1] | done)[:upto])
            out: list[tuple[int, int, int, int, int]] = []
            for row in zip(*(c[wanted].tolist() for c in columns)):
                vb, vsh, vdoc, vth, vplace = row
                if vplace < 0:
                    out.append((0, vdoc, vth, -vplace - 1, 0))
                elif head is None or head[0] != vb:
                    head, waiting, marked = row, True, False
                elif head[1] != vsh:
                    if waiting:
                        out.append((vb, *head[2:], 1))
                        waiting = False
                    out.append((vb, vdoc, vth, vplace, 1))
                    head, marked = row, False
                elif all_places:
                    out.append((0, vdoc, vth, vplace, 0))
                    if not marked:
                        out.append((0, *head[2:], 0))
                        marked = True
                elif vdoc != head[2] or vplace >> 20 != head[4] >> 20:
                    out.append((0, vdoc, vth, vplace, 0))
                elif vth != head[3]:  # another row with this id, at the same place: its windows are compared as well
                    if waiting:
                        out.append((vb, *head[2:], 1))
                        waiting = False
                    out.append((vb, vdoc, vth, vplace, 1))
            if out:
                yield _batch(_NOTE, *zip(*out))
            if batch is None:
                return

    return run


def _fetch(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            texts = batch["text"].cast(pa.binary())
            for i, asked in enumerate(batch["asked"].to_pylist()):
                doc, th = batch["doc"][i].as_py(), batch["th"][i].as_py()
                places = [_unplace(q["place"]) for q in asked]
                contents = unit.contents(texts[i].as_py(), places, unit.window)
                for q, (start, _), content in zip(asked, places, contents):
                    if not q["heavy"]:
                        rows.append((q["b"], doc, th, q["place"], content, None, None))
                    else:
                        for k, w in enumerate(unit.windows(content, unit.window)):
                            h = xxhash.xxh3_128_digest(w)
                            h1, h2 = (int.from_bytes(x, "big", signed=True) for x in (h[:8], h[8:]))
                            rows.append((q["b"], doc, th, _place(start + k, 1), None, h1, h2))
                    size += len(content)
                if size > 4_000_000 or len(rows) > 100_000:
                    yield _batch(_PART, *zip(*rows))
                    rows, size = [], 0
            if rows:
                yield _batch(_PART, *zip(*rows))

    return run


def _compare(unit: Unit, at_once: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole buckets, about ``at_once`` bytes of them together."""

    def marks(rows: list) -> pa.RecordBatch | None:
        out = []
        starts = [_unplace(r[3])[0] for r in rows]
        for (_, doc, th, _, _), start, hit in zip(rows, starts, unit.repeated([(r[4], r[1], s) for r, s in zip(rows, starts)], unit.window)):
            edges = np.flatnonzero(np.diff(hit.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
            out += [(0, doc, th, _place(start + x, y - x), 0) for x, y in zip(edges[::2], edges[1::2])]
        return _batch(_NOTE, *zip(*out)) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size, now = 0, None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("b", "doc", "th", "place", "content"))):
                if size > at_once and row[0] != now:
                    if (found := marks(rows)) is not None:
                        yield found
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                now = row[0]
        if rows and (found := marks(rows)) is not None:
            yield found

    return run


def doc_keys(docs: DataFrame) -> DataFrame:
    """``doc`` and ``th``: the id as a number, null last, and a 64-bit hash of the text, for ids held twice or missing."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "th": F.xxhash64(text)})


def marked_runs(docs: DataFrame, unit: Unit, name: str, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``doc, th, places``: the runs of repeated windows of each document that has any.

    ``docs`` has ``doc_id`` and ``text``. All windows of all texts take part.
    """
    given = doc_keys(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc", "th", "text")
    runs = given.mapInArrow(_scan(unit), RUN_SCHEMA)
    notes = runs.repartition("b").sortWithinPartitions("b", "sh", "doc", "place", "th").mapInArrow(_settle(unit.all_places), NOTE_SCHEMA)
    notes = written(notes, f"{name}-notes")
    asked = notes.where("kind = 1").select("b", "doc", "th", "place").distinct()  # repeated rows ask once
    heavy = asked.groupBy("b").count().where(F.col("count") > bucket_runs).select("b", F.lit(True).alias("heavy"))
    asked = asked.join(heavy, "b", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    by_doc = asked.groupBy("doc", "th").agg(F.collect_list(F.struct("b", "place", "heavy")).alias("asked"))
    parts = given.join(by_doc, ["doc", "th"]).select("doc", "th", "text", "asked").mapInArrow(_fetch(unit), PART_SCHEMA)
    parts = written(parts, f"{name}-parts")
    compared = (
        parts.where("content is not null").select("b", "doc", "th", "place", "content")
        .repartition("b").sortWithinPartitions("b", "doc", "place", "th")
        .mapInArrow(_compare(unit), NOTE_SCHEMA)
    )
    windows = parts.where("content is null").select("h1", "h2", "doc", "th", "place", F.struct("doc", F.shiftright("place", 20).alias("start")).alias("at"))
    first = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = windows.join(first, ["h1", "h2"])
    again = again if unit.all_places else again.where("at > first")
    marks = (
        notes.where("kind = 0").select("doc", "th", "place")
        .unionByName(compared.select("doc", "th", "place"))
        .unionByName(again.select("doc", "th", "place"))
    )
    # repeated rows have their places in common: each is listed once
    return marks.groupBy("doc", "th").agg(F.collect_set("place").alias("places"))


def covered(places: Sequence[int] | None, window: int, units: int) -> np.ndarray:
    """Edges ``[start, end)`` of the maximal stretches of units that marked windows cover, as an n x 2 array."""
    if places is None or not len(places):
        return np.empty((0, 2), np.int64)
    start, count = _unplace(np.sort(np.asarray(places, np.int64)))
    end = np.maximum.accumulate(np.minimum(start + count + window - 1, units))
    gap = np.append(True, start[1:] > end[:-1])
    return np.stack([start[gap], end[np.append(np.flatnonzero(gap)[1:] - 1, len(end) - 1)]], 1)
