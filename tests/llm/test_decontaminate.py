import random

import numpy as np

from tidemark.llm import decontaminate as D


def test_search_finds_what_exact_containment_finds(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(500)]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in [1, 2, 4, 5, 6, 9, *[rng.randrange(10, 60) for _ in range(30)]]]
    docs = []
    for _ in range(120):
        words = [rng.choice(vocab) for _ in range(rng.choice((0, 3, 50, 900, 6000)))]
        item = rng.choice(items).split()
        if rng.random() < 0.7:
            for _ in range(rng.randrange(3)):
                item[rng.randrange(len(item))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in item]
        docs.append(" ".join(words))

    def shingles(text, k):
        w = D.normal(text).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, item in enumerate(items):
        k = min(5, len(item.split()))
        own = shingles(item, k)
        for d, doc in enumerate(docs):
            shared = len(own & shingles(doc, k))
            if shared >= 0.8 * len(own):
                want.add((d, i, len(own), shared))
    given = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    asked = spark.createDataFrame([*enumerate(items), (900, None), (901, " ")], "item_id long, text string")
    for block_words in (D.BLOCK_WORDS, 200):  # one block, and several
        found = D.contained_items(given, asked, block_words=block_words)
        assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in found.collect()} == want
    assert len(want) > 40


def test_drop_keeps_columns_and_clean_rows(spark, documents, nothing):
    items = documents.where("doc_id = 6").selectExpr("doc_id as item_id", "text", "1 as __check")
    kept = D.drop_contaminated(documents, items)
    assert kept.columns == documents.columns
    left = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert left == sorted([1, 2, 3, 4, 4, 8, 10, 11, None, None], key=str)
    assert D.drop_contaminated(nothing, items).count() == 0
    assert D.drop_contaminated(documents, items.where("false")).count() == documents.count()


def test_items_of_few_shingles_are_never_missed():
    """Every document of 300 shingles that holds an item of one shingle has it as a candidate."""
    rng = np.random.default_rng(5)
    items = D.Items([(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(400)], 5)
    for i in range(400):
        grams = np.append(rng.integers(0, 2**64, 299, dtype=np.uint64), items.hashes[i])
        assert D.candidates(items, grams, items.hashes[i], 5) == [i]
