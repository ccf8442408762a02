import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import importance as I
from tests.llm.twins import compare

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text):
    w = words(text)
    return [" ".join(w[i : i + k]) for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w)]


def buckets(text, n=10_000):
    return [crc32(g.encode()) % n for g in grams(text)]


def brute(rows, target, n=10_000):
    s, t = (Counter(b for x in texts for b in buckets(x, n)) for texts in ([x for _, x in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + n) / ((s[b] + 1) * (t_all + n)))) for b in range(n)]
    out = []
    for d, text in rows:
        found = buckets(text, n)
        h = int(sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    long = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1:]))
    drawn = [(*r[:4], i) for i, r in enumerate(long[: len(long) * 5 // 100], 1)]
    rest = long[len(drawn) :] + [r for r in out if r[4] < 20]
    return drawn + [(*r[:4], None) for r in rest]


def got(docs, target, **more):
    return [tuple(r) for r in I.resample(docs, target, **more).select("doc_id", "n_features", "weight", "score", "rank").collect()]


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.text(), st.text("aB 9\x00\n{é\x7f\x80　", max_size=60)))
def test_spans_are_all_runs_of_words(text):
    text = text.encode("utf-8", "ignore").decode()
    n, found = I.gram_buckets(text.encode())
    assert n == len(words(text)) and list(found) == buckets(text)


def test_long_word_and_long_text():
    for text in ("x" * 300_000, " ".join(f"w{i % 977}" for i in range(60_000)), " ." * 50_000):
        n, found = I.gram_buckets(text.encode())
        assert n == len(words(text)) and list(found) == buckets(text)


@pytest.mark.parametrize("partitions", [4, 13])
def test_brute_force(spark, partitions):
    """Ties, repeated ids and rows, null ids; ranks across many ranges."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "straße", "X-y", "a.b"]
    text = lambda k: " ".join(rng.choice(vocabulary[: 6 + k % 58]) for _ in range(rng.choice((0, 5, 19, 20, 40, 90))))
    rows = [(rng.choice((i, i, i // 3, None)), text(i)) for i in range(700)]
    rows += rows[:40] + [(i, rows[600][1]) for i in range(900, 960)] + [(1, None)]
    target = [text(0) for _ in range(12)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(got(docs, bench), key=str) == sorted(brute(rows, target), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_odd_rows_and_columns(spark, documents, nothing):
    bench = spark.createDataFrame([("w1 w2 w3",)], "text string").withColumns({"doc_id": F.lit("x"), "weight": F.lit(1)})
    docs = documents.withColumns({"rank": F.lit("mine"), "score": F.lit(1), "row": F.lit(2), "buckets": F.lit(3)})
    out = I.resample(docs, bench, percent=50)
    assert out.select("row.*").columns == docs.columns and {r[0] for r in out.select("row.rank").collect()} == {"mine"}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(got(documents, bench), key=str) == sorted(brute(rows, ["w1 w2 w3"]), key=str)
    assert got(nothing, bench) == []
    assert sorted(got(documents, bench.where("false"), buckets=7), key=str) == sorted(brute(rows, [], 7), key=str)


def test_twin(spark):
    found = compare(spark, I, "op12_importance")
    assert sum(r[2] is not None for r in found) > 5


def test_drawn_documents_are_near_the_target(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{'in' if i % 10 == 0 else 'out'}{(i * 7 + j) % 50}" for j in range(40))) for i in range(1000)], "doc_id long, text string")
    bench = spark.createDataFrame([(" ".join(f"in{j}" for j in range(50)),)], "text string")
    assert {r["doc_id"] % 10 for r in I.resample(docs, bench).where("rank is not null").collect()} == {0}
