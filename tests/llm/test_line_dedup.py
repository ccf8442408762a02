import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as L
from tests.llm.twins import compare

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(WHITE)


def brute(rows, min_chars=20, min_docs=3):
    """``(doc_id, text)`` to ``(doc_id, lines, dropped, kept)``."""
    split = [(d, (t or "").split("\n")) for d, t in rows]
    held = defaultdict(list)
    for d, lines in split:
        for k in {key(x) for x in lines}:
            held[k].append(d)
    order = lambda d: (d is None, d or 0)
    out = []
    for d, lines in split:
        gone = [len(k := key(x)) >= min_chars and len(held[k]) >= min_docs and d != max(held[k], key=order) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def got(docs, **more):
    return [tuple(r) for r in L.drop_common_lines(docs, **more).select("row.doc_id", "removal.n_lines", "removal.n_dropped", "removal.kept").collect()]


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("broadcast_keys", [100_000, 3, 1])
def test_brute_force(spark, broadcast_keys):
    """Shared lines with other case and white space, repeated ids and rows, null ids; keys broadcast and joined."""
    rng = random.Random(4)
    pool = [f"Line number {i} of the shared ones" for i in range(12)] + ["short", "É" * 19, "É" * 20, "", " \t", "x" * 20, "X" * 20 + "\r", "é" * 20]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"own {rng.random()} {i} and more words" for _ in range(rng.randrange(9))]
        lines = [rng.choice(("", " ", "\t\x0b")) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(("", "\r", " ")) for x in lines]
        rows.append((rng.choice((i, i, i, i // 5, None)), "\n".join(lines) if i % 17 else None))
    rows += rows[:10]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(got(docs, broadcast_keys=broadcast_keys), brute(rows))


def test_long_text_and_hot_line(spark):
    hot = "the very same line that every document of the table holds"
    rows = [(i, f"{hot}\nown line {i} that stands here alone") for i in range(500)]
    rows.append((-1, "\n".join([hot, *(f"line {i % 20_000} of a long text, twice" for i in range(40_000)), hot])))
    rows.append((600, f"{hot}\n{hot}\nend"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(got(docs), brute(rows))
    same(got(docs, broadcast_keys=1), brute(rows))


def test_odd_rows_and_columns(spark, documents, nothing):
    docs = documents.withColumn("places", F.lit("mine")).withColumn("t1", F.lit(2)).withColumn("removal", F.lit(3)).withColumn("row", F.lit(4))
    out = L.drop_common_lines(docs)
    assert out.select("row.*").columns == docs.columns
    same(got(docs), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert L.drop_common_lines(nothing).count() == 0


def test_twin(spark):
    compare(spark, L, "op13_line_dedup")


def test_no_python_in_the_plan(spark):
    plan = L.op13_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_digest(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert L.drop_common_lines(docs).select(F.sha2("removal.kept", 256)).first()[0] == sha256(b"a\nb").hexdigest()
