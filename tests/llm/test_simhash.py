import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import components as C
from tidemark.llm import simhash as S


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t", "One", "É a B c", "a b c d", "A b C d e", "x " * 40, "w1 w2 w3\x0bw4\x0cw5 w6 " * 9])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def near(rng, center, flips):
    for b in rng.sample(range(64), flips):
        center ^= 1 << b
    return center


def brute(values, radius):
    root = {v: v for v in values}
    find = lambda v: v if root[v] == v else find(root[v])
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {v: find(v) for v in values}


@pytest.mark.parametrize("members", [5, 70, 300])
def test_planes_find_every_pair(members):
    rng = random.Random(members)
    center = rng.getrandbits(64)
    v = np.array(sorted({near(rng, center, rng.randrange(6)) for _ in range(members)}), np.uint64).reshape(-1, 1)
    want = {(i, j) for j in range(len(v)) for i in range(j) if (int(v[i, 0]) ^ int(v[j, 0])).bit_count() <= 4}
    assert {(i, j) for a, b in S.tile_within(v, 4) for i, j in zip(a.tolist(), b.tolist())} == want
    i, j = np.triu_indices(len(v), 1)
    hit = S.pairs_within(v[i], v[j], 4)
    assert set(zip(i[hit].tolist(), j[hit].tolist())) == want


@pytest.mark.parametrize("tile", [S.TILE, 7])
def test_links_reach_what_brute_force_reaches(spark, tile):
    rng = random.Random(4)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        center = rng.getrandbits(64)
        values |= {near(rng, center, rng.randrange(7)) for _ in range(rng.choice((1, 2, 40)))}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in C.components(S.fingerprint_links(df, 4, tile), "t").collect()}
    want = brute([v & (1 << 64) - 1 for v in values], 4)
    classes = lambda m: sorted(sorted(v & (1 << 64) - 1 for v in values if m(v) == r) for r in {m(v) for v in values})
    assert classes(lambda v: roots.get(v, v)) == classes(lambda v: want[v & (1 << 64) - 1])


def test_block_masks_leave_no_pair_out():
    for n in (10, 10**6, 10**9, 10**11):
        masks = S.block_masks(n, 4)
        rng = random.Random(n)
        for _ in range(300):
            diff = near(rng, 0, 4)
            assert any(not m & diff for m in masks)


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(links, "a long, b long"), "p").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100: 100, 101: 100, 200: 100}}
    assert C.components(spark.createDataFrame([], "a long, b long"), "p").count() == 0


def test_similar_documents_and_one_of_each(spark, documents, nothing):
    rng = random.Random(1)
    base = [[f"{rng.choice('abcdef')}{rng.randrange(4000)}" for _ in range(300)] for _ in range(30)]
    rows = []
    for i, words in enumerate(base):
        rows.append((1000 + i, " ".join(words)))
        changed = list(words)
        changed[rng.randrange(300)] = "changed"
        changed[rng.randrange(300)] = "too"
        rows.append((2000 + i, " ".join(changed)))
        rows.append((3000 + i, " ".join(f"other{i}{w}" for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in S.keep_first(docs).collect()} == {1000 + i for i in range(30)} | {3000 + i for i in range(30)}
    kept = S.keep_first(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and ids.count(1) == 1 and 2 not in ids and 5 in ids and 6 not in ids and 7 not in ids and ids.count(None) == 2
    assert S.keep_first(nothing).count() == 0 and S.near_duplicates(nothing).count() == 0
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(documents).where("doc_id is not null").collect()}
    assert found[1] == found[2] == found[3] == 1 and found[7] == 5


def shingles_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similar_by_brute_force(texts, similarity=0.8):
    sets = [shingles_of(t) for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) / max(len(sets[i] | sets[j]), 1) >= similarity or not sets[i] | sets[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("tile", [S.TILE, 40])
def test_only_texts_of_the_similarity_are_linked(spark, monkeypatch, tile):
    """Pairs at 0.6 to 0.95 and a group of many around 0.7, also in tiles, against exact similarities."""
    monkeypatch.setattr(S.similar_links, "__defaults__", (tile,))
    rng = random.Random(9)
    words = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(4000)}" for _ in range(n)]
    texts = []
    for changed in range(8, 72, 2):
        base = words(300)
        at = rng.randrange(300 - changed)
        texts += [" ".join(base), " ".join(base[:at] + words(changed) + base[at + changed :])]
    base = words(300)
    for changed in [5] * 20 + [34] * 130:  # with few changes all alike, with more none is
        at = rng.randrange(300 - changed)
        texts.append(" ".join(base[:at] + words(changed) + base[at + changed :]))
    for _ in range(20):
        base = words(9)
        texts += [" ".join(base), " ".join(base[:8])]  # four shingles of five
    want = similar_by_brute_force(texts)
    got = {r["doc_id"]: r["component_id"] for r in S.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    pairs = [want[i] == want[i + 1] for i in range(0, 64, 2)]
    assert True in pairs and False in pairs and 20 < len(set(want[64:214])) < 150


def test_links_of_a_large_group_are_each_checked():
    """Members all within the radius, but alike only by parity."""
    values = np.zeros((200, 1), np.uint64)
    for n in (200, 50):  # as a tile, and in steps
        a, b = S.group_links(np.zeros(n, np.int64), values[:n], 4, alike=lambda x, y: (x - y) % 2 == 0)
        assert sorted(a.tolist()) == list(range(2, n)) and (b == a % 2).all()
