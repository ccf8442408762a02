import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import filter_audit as A
from tidemark.llm import transducer as T
from tests.llm.twins import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    words = WORD.findall(text)
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text)))


def brute(rows, labels):
    """Applies every order of filters to sets of rows."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = defaultdict(list)
    for d, text, _ in rows:
        least[text or ""].append(d)
    fails = []
    for d, text, _ in rows:
        w, u, caps, points, symbols = figures(text or "")
        ids = [x for x in least[text or ""] if x is not None]
        f = {"A": w < 100, "B": 100 * u < 80 * w, "C": 100 * caps > 10 * points, "D": symbols > 0, "E": bool(ids) and (d is None or d > min(ids))}
        fails.append({k for k, v in f.items() if v})
    out = []
    for part in {lang or "" for *_, lang in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                removed = [i for i in left if f in fails[i]]
                gone = set(mine) - set(left)
                left = [i for i in left if f not in fails[i]]
                shapley[f] += len(removed)
                found.append((
                    part, "".join(order), step, len(left), len(removed), sum(f in fails[i] for i in gone), sum(fails[i] == {f} for i in mine),
                    sum(rows[i][0] in good for i in removed), sum(rows[i][0] in toxic for i in removed), f,
                ))
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return out


def got(docs, labels):
    return [tuple(r) for r in A.audit_filters(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("aB\x85　 \n\t|é𐍈", max_size=900)), max_size=12))
def test_figures_of_any_text(texts):
    data = [t.encode("utf-8", "surrogatepass") for t in (x.encode("utf-8", "ignore").decode() for x in texts)]
    want = [figures(d.decode()) for d in data]
    assert T.text_figures(data).tolist() == [list(w) for w in want]


def test_lanes_cut_words_and_characters():
    """Lane borders inside characters of every width and inside very long words."""
    for unit in ("x", "é", "€", "𐍈", "aé€𐍈", "ab "):
        for lead in range(5):
            text = "." * lead + unit * 3000 + " A|"
            assert T.text_figures([text.encode()]).tolist() == [list(figures(text))]


def test_bytes_out_of_place_are_read_alike_wherever_lanes_begin():
    rng = random.Random(3)
    data = np.array([rng.choice((0x20, 0x41, 0x80, 0xBF, 0xC3, 0xE2, 0xF0, 0xFF)) for _ in range(6000)], np.uint8)
    state, slow = 0, []
    for b in data.tolist():
        slow.append(int(T._COUNT[state | b]))
        state = int(T._AFTER[state | b])
    assert T.transduce(data).tolist() == slow


@pytest.mark.parametrize("hashed", [False, True])
def test_hash_table_compares_bytes(hashed):
    """With all hashes equal only the comparison of bytes tells spans apart."""
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 30)))) for _ in range(300)]
    words += ["a" * 8 + "\0", "a" * 8, "a" * 9, "\0", "\0\0"]
    data = "".join(words).encode()
    length = np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    owner = np.arange(len(words)) % 3
    fresh = T.first_spans(np.frombuffer(data, np.uint8), owner, start, length, np.zeros(len(words), np.uint64) if hashed else None)
    assert Counter((o, w) for o, w, f in zip(owner.tolist(), words, fresh) if f) == Counter({(o, w) for o, w in zip(owner.tolist(), words)})


def test_brute_force(spark):
    rng = random.Random(8)
    base = ["", None, "word " * 120, " ".join(f"w{i}" for i in range(130)), "UP " * 150, " ".join(f"Wx{i} AB" for i in range(130)), "a|b " + " ".join(f"v{i}" for i in range(101)), "#"]
    rows = [(rng.choice((i, i, i, i // 4, None)), rng.choice(base) if rng.random() < 0.7 else " ".join(f"u{i}x{j}" for j in range(rng.randrange(90, 115))), rng.choice(("en", "de", None, ""))) for i in range(150)]
    rows += rows[:12]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(got(docs, marks)) == sorted(brute(rows, labels))
    assert sorted(got(docs, marks.where("false"))) == sorted(brute(rows, []))


def test_odd_rows_and_columns(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    docs = documents.withColumns({"part": F.lit("p"), "mask": F.lit(99), "good": F.lit(1), "f": F.lit("f"), "t1": F.lit(0)})
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    assert sorted(got(docs, labels.withColumn("mask", F.lit(3)))) == sorted(brute(rows, [tuple(r) for r in labels.collect()]))
    assert got(nothing, labels) == []


def test_long_text(spark):
    text = " ".join(f"word{i % 70_000}" for i in range(150_000)) + " É" * 10
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(got(docs, labels)) == sorted(brute([(1, text, "en"), (2, text, "en")], []))


def test_twin(spark):
    assert len(compare(spark, A, "op11_filter_audit")) == 4 * 600
