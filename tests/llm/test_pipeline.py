import random
from collections import Counter

import corpus_pipeline as P
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = {f"op{n}_" for n in range(1, 14)}


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert {n[: n.index("_") + 1] for n in names} == NAMES and len(names) == 13
    assert "pipeline" in entry.queries()


def test_stages_in_order_on_odd_rows(spark, documents, nothing):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    for given in (docs, docs.where("false")):
        for name, stage in P.STAGES:
            given = P.written(stage(spark, given, SF), "t")
            assert given.columns[:5] == docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "near duplicates", "repeated passages", "decontamination", "mixture"]


def test_each_decision_takes_effect(spark):
    """What a stage reports is what it leaves, on the small tables."""
    from tidemark.llm.decontaminate import contained_items
    from tidemark.llm.suffix_dedup import remove_repeated_bytes
    from tidemark.llm.toxicity import CUT, score_toxicity

    docs = P.table(spark, SF, "documents")
    labels = P.table(spark, SF, "labels")
    bad = {r[0] for r in score_toxicity(docs, labels).where(f"toxicity.score >= {CUT}").select("row.doc_id").collect()}
    clean = P.written(P.toxicity(spark, docs, SF), "clean")
    assert {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in clean.select("doc_id").collect()} == bad
    once = P.written(P.near_duplicates(spark, clean, SF), "once")
    texts = [r["text"] for r in once.collect()]
    assert len(texts) == len(set(texts)) < clean.count()
    cut = P.written(P.repeated_passages(spark, once, SF), "cut")
    removed = {r["doc_id"]: r["n_removed"] for r in remove_repeated_bytes(once, words=P.PASSAGE_WORDS).select("row.doc_id", "removal.n_removed").collect()}
    before = {r["doc_id"]: r["text"] for r in once.collect()}
    for r in cut.collect():
        assert (r["text"] == before[r["doc_id"]]) == (removed[r["doc_id"]] == 0) and r["n_chars"] == len(r["text"])
    leaks = {r["doc_id"] for r in contained_items(cut, P.table(spark, SF, "benchmark")).collect()}
    left = {r["doc_id"] for r in P.decontamination(spark, cut, SF).collect()}
    assert left == set(before) - leaks


def test_passages_of_over_50_words_go(spark):
    """Planted passages of 40 to 70 short words, against brute force; none reaches 400 bytes."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    rows = []
    for n in [*range(40, 51), *range(51, 71)]:
        passage = [word() for _ in range(n)]
        for space in (" ", "\n"):
            lead, tail = ([f"{word()}{len(rows)}x{i}" for i in range(20)] for _ in range(2))
            rows.append((len(rows), space.join([*lead, *passage, *tail]), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = Counter(tuple(t.split()[i : i + 51]) for _, t, *_ in rows for i in range(len(t.split()) - 50))
    want = {}
    for d, text, *_ in rows:
        words = text.split()
        gone = {k for i in range(len(words) - 50) if seen[tuple(words[i : i + 51])] > 1 for k in range(i, i + 51)}
        want[d] = [w for k, w in enumerate(words) if k not in gone]
    got = {r["doc_id"]: r for r in P.repeated_passages(spark, docs, SF).collect()}
    assert {d: r["text"].split() for d, r in got.items()} == want
    assert {len(w) for d, w in want.items() if d >= 22} == {40}
    assert all(got[d]["text"] == rows[d][1] for d in range(22))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
