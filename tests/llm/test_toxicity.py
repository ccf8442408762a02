import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as X


def corpus(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("aeiou") + rng.choice("bdfglmnrst") for _ in range(rng.randrange(1, 4))) for _ in range(800)]
    bad = ["idiot", "scum", "vile"]
    out = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice([*bad, "grobz" + rng.choice(clean)]).title())
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_rows_are_told_apart(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    scored = X.score_toxicity(docs, labels).select("row.doc_id", "toxicity.*").withColumn("held", X.held_out()).collect()
    held = [r for r in scored if r["held"]]
    assert 80 < len(held) < 220
    assert sum((r["score"] >= X.CUT) == bool(rows[r["doc_id"]][2]) for r in held) / len(held) > 0.97
    for r in scored:
        text = rows[r["doc_id"]][1]
        said = [text[a:b].lower() for a, b in zip(r["starts"], r["ends"])]
        assert sum(w in ("idiot", "scum", "vile") or w.startswith("grob") for w in said) >= 0.9 * len(said)
    again = X.score_toxicity(docs, labels).select("row.doc_id", "toxicity.score").collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in scored}


def test_held_out_labels_are_not_learned(spark):
    rows = corpus(400, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", X.F.when(X.held_out(), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    a, b = X.train(docs, labels), X.train(docs, turned)
    assert (a.weights == b.weights).all() and (a.score == b.score).all()


def test_marginals_are_those_of_all_paths():
    model = X.Model(np.empty(0, np.uint64), np.empty(0), -1.2, (-0.7, 0.4, 0.9), np.empty(0), 0.1)
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randrange(1, 9)
        places = np.array(sorted(rng.sample(range(n), rng.randrange(1, n + 1))))
        weights = np.array([rng.uniform(-2, 4) for _ in places])
        unary = np.full(n, model.bias)
        unary[places] += weights
        total, toxic = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            score, before = 0.0, 0
            for t, y in enumerate(path):
                score += (0, model.moves[0], model.moves[1], model.moves[2])[2 * before + y] + y * unary[t]
                before = y
            total += np.exp(score)
            toxic += np.exp(score) * np.array(path)
        assert model.chances(places, weights, n) == pytest.approx((toxic / total)[places])


def test_offsets_are_code_points(spark):
    model = X.fit([(t, y) for _, t, y in corpus(300, 4)], 0.25)
    text = "été 🙂 oumud Idiot! élan, SCUM"
    _, starts, ends, _ = model.scores([text])[0]
    assert [text[a:b] for a, b in zip(starts, ends)] == ["Idiot", "SCUM"]


def test_odd_rows(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r[0] for r in X.score_toxicity(documents, none).select("toxicity.score").collect()} == {0.0}
    one_kind = spark.createDataFrame([(4, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    kept = X.drop_toxic(documents, one_kind)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    assert X.score_toxicity(nothing, one_kind).count() == 0


def test_places_in_a_text_with_many_hits():
    text = ("é€𐍈 bad " * 40_000).encode()
    places = np.flatnonzero(np.frombuffer(text, np.uint8) == ord("b"))
    began = time.process_time()
    assert X.code_points(text, places) == [4 + 8 * i for i in range(40_000)]
    assert time.process_time() - began < 1 and X.code_points(text, places[:0]) == []


def test_repeated_ids_long_texts_and_clashing_columns(spark):
    """A sampled id that thousands of rows share brings one text to the driver; every row is scored, long ones whole."""
    docs = [(i, f"some plain words number {i} " + ("vileword again " if i % 3 == 0 else "fine words again "), "x") for i in range(300)]
    docs += [(3, f"copy {i} vileword", "x") for i in range(3000)] + [(1000, "fine words " * 60_000 + "vileword", "x"), (None, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxicity string").withColumn("score", F.lit(5))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1)], "doc_id long, toxic int")
    seen = []
    original = X.fit
    X.fit = lambda rows, prior: seen.append(len(rows)) or original(rows, prior)
    try:
        out = X.score_toxicity(df, labels)
    finally:
        X.fit = original
    rows = out.select("row.doc_id", "row.score", "toxicity.starts", F.col("toxicity.score").alias("found")).collect()
    assert len(rows) == len(docs) and seen[0] <= 300 and {r["score"] for r in rows} == {5}
    long = next(r for r in rows if r["doc_id"] == 1000)
    assert long["starts"] == [11 * 60_000] and min(r["found"] for r in rows if r["doc_id"] == 3) > max(r["found"] for r in rows if r["doc_id"] == 1)
