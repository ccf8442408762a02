"""Repeated byte strings and word windows against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import grams, passages, suffix_dedup, window_dedup


def kept_bytes(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = "".join("x" if g else " " for g in gone).split()
        out.append((bytes(b for b, g in zip(t, gone) if not g), len(t), sum(gone), len(runs)))
    return out


def kept_words(rows, window):
    found = {}
    for doc, text in rows:
        words = text.split()
        for i in range(len(words) - window + 1):
            found.setdefault(tuple(words[i : i + window]), set()).add((doc, i))
    out = []
    for doc, text in rows:
        words = text.split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if min(found[tuple(words[i : i + window])]) < (doc, i):
                gone[i : i + window] = [True] * window
        out.append((" ".join(w for w, g in zip(words, gone) if not g), len(words), sum(gone)))
    return out


def some_texts(seed, n, alphabet, join):
    rng = random.Random(seed)
    base = [rng.choice(alphabet) for _ in range(300)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            a = rng.randrange(280)
            parts += base[a : a + rng.randrange(80)] + [rng.choice(alphabet) for _ in range(rng.randrange(6))]
        texts.append(join.join(parts))
    return [*texts, "", join.join(["a"] * 90), texts[0], join.join(["a", "b"] * 50)]


@pytest.mark.parametrize("length", [1, 3, 14, 15, 33])
def test_interval_expansion_finds_repeated_strings(length):
    for seed in range(60):
        texts = [t.encode() for t in some_texts(seed, 4, "abé", "")]
        hits = suffix_dedup.repeated_strings([(t, 0, 0) for t in texts], length)
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        assert [h.tolist() for h in hits] == [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


@pytest.mark.parametrize("bucket_runs", [passages.BUCKET_RUNS, 0])
def test_repeated_bytes(spark, monkeypatch, bucket_runs):
    """Also with every bucket compared by window hash."""
    monkeypatch.setattr(passages.marked_runs, "__defaults__", (bucket_runs,))
    texts = some_texts(5, 40, "abcdefgh é", "")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeated_bytes(docs, 40).select("row.doc_id", "removal.*").collect()}
    want = kept_bytes([t.encode() for t in texts], 40)
    assert [got[i] for i in range(len(texts))] == want
    assert 0 < sum(w[2] for w in want)


@pytest.mark.parametrize("bucket_runs", [passages.BUCKET_RUNS, 0])
def test_repeated_words(spark, monkeypatch, bucket_runs):
    monkeypatch.setattr(passages.marked_runs, "__defaults__", (bucket_runs,))
    texts = some_texts(8, 40, [f"w{i}" for i in range(30)], " ")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["n_words"], r["n_removed"]) for r in window_dedup.remove_repeated_words(docs, 12).select("row.doc_id", "removal.*").collect()}
    assert [got[i] for i in range(len(texts))] == kept_words(list(enumerate(texts)), 12)


def test_odd_rows(documents, nothing):
    for out, lengths in (
        (suffix_dedup.remove_repeated_bytes(documents), "n_bytes"),
        (window_dedup.remove_repeated_words(documents), "n_words"),
    ):
        rows = out.select("row.*", "removal.*").collect()
        assert len(rows) == documents.count() and set(documents.columns) < set(rows[0].asDict())
        by_id = {}
        for r in rows:
            by_id.setdefault(r["doc_id"], []).append(r)
        assert [by_id[i][0][lengths] for i in (1, 2)] == [0, 0]
        assert by_id[4][0]["n_removed"] == by_id[4][1]["n_removed"]
        # both stand in document 9 too: bytes go wherever they repeat, words where the larger id is, which is null
        assert [r["n_removed"] for r in by_id[None]] == [r[lengths] for r in by_id[None]]
    bytes_out = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeated_bytes(documents).select("row.doc_id", "removal.n_removed").where("doc_id is not null").collect()}
    assert bytes_out[6] == bytes_out[7] == len(" ".join(f"w{i}" for i in range(100, 220))) and bytes_out[11] == 700 and bytes_out[10] == 1800
    words_out = {r["doc_id"]: r["n_removed"] for r in window_dedup.remove_repeated_words(documents).select("row.doc_id", "removal.n_removed").where("doc_id is not null").collect()}
    assert words_out[5] == 0 and words_out[6] == words_out[7] == 120 and words_out[8] == 2999
    assert suffix_dedup.remove_repeated_bytes(nothing).count() == window_dedup.remove_repeated_words(nothing).count() == 0


def many_without_id():
    """5 000 rows without an id, one id held 2 000 times by two texts, and rows that share passages with both."""
    rng = random.Random(12)
    passages_ = [" ".join(f"p{k}x{j}" for j in range(9)) for k in range(40)]
    rows = []
    for i in range(5000):
        own = [f"o{i}x{j}" for j in range(4)]
        rows.append((None, " ".join(own[:2] + ([rng.choice(passages_)] if i % 100 == 0 else []) + own[2:])))
    held = ["h1 h2 h3 h4 h5 h6 h7 h8", "other " + passages_[0] + " words"]
    rows += [(7, held[i % 2]) for i in range(2000)]
    rows += [(i, f"lead{i} {passages_[i % 40]} tail{i}") for i in range(20, 60)]
    return rows


def test_rows_without_id_and_of_one_id_against_brute_force(spark):
    rows = many_without_id()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    window, length, none = 5, 24, 1 << 62
    first, seen = {}, Counter()
    for d, text in rows:
        words = text.split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, (none + 1, 0)), (none if d is None else d, i))
        for i in range(len(text) - length + 1):
            seen[text[i : i + length]] += 1
    want_words, want_bytes = Counter(), Counter()
    for d, text in rows:
        words = text.split()
        gone = {k for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < (none if d is None else d, i) for k in range(i, i + window)}
        want_words[d, " ".join(w for k, w in enumerate(words) if k not in gone), len(gone)] += 1
        cut = {k for i in range(len(text) - length + 1) if seen[text[i : i + length]] > 1 for k in range(i, i + length)}
        want_bytes[d, "".join(c for k, c in enumerate(text) if k not in cut), len(cut)] += 1
    got = window_dedup.remove_repeated_words(docs, window).select("row.doc_id", "removal.kept", "removal.n_removed").collect()
    assert Counter(map(tuple, got)) == want_words
    got = suffix_dedup.remove_repeated_bytes(docs, length, as_text=True).select("row.doc_id", "removal.kept", "removal.n_removed").collect()
    assert Counter(map(tuple, got)) == want_bytes
    assert sum(n for (d, _, cut), n in want_bytes.items() if d is None and cut) == 50


def test_places_of_repeated_rows_are_listed_once(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))] * 300 + [(2, " ".join(f"w{i}" for i in range(50)))], "doc_id long, text string")
    marks = passages.marked_runs(docs, suffix_dedup.byte_unit(30), "t").collect()
    assert {r["doc"] for r in marks} == {1, 2} and all(len(r["places"]) < 40 for r in marks)


def test_batch_borders_do_not_matter():
    rng = random.Random(2)
    for _ in range(200):
        rows = sorted((rng.randrange(3), rng.randrange(2), rng.randrange(5), rng.randrange(3) << 20 | 1, rng.randrange(2)) for _ in range(rng.randrange(1, 12)))
        rows = [dict(zip(("b", "sh", "doc", "place", "th"), r)) for r in rows]
        for all_places in (True, False):
            results = []
            for k in (1, 2, 100):
                batches = [pa.RecordBatch.from_pylist(rows[i : i + k], schema=passages._RUN) for i in range(0, len(rows), k)]
                results.append(sorted(tuple(r.values()) for o in passages._settle(all_places)(iter(batches)) for r in o.to_pylist()))
            assert results[0] == results[1] == results[2]


def test_words_are_those_of_the_pattern_also_in_long_texts():
    text = ("ab é\t" * 200_000 + "x" * 600_000 + " end").encode()
    h, s, e = grams.word_hashes(text)
    assert [text[a:b] for a, b in zip(s, e)] == text.split()
    assert len(np.unique(h)) == 4


def test_window_minima():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 300).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 100):
        assert grams.window_minima(h, w).tolist() == [min(h[i : i + w]) for i in range(len(h) - w + 1)]
