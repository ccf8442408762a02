"""Benchmark decontamination: containment search by MinHash bins, verified by exact shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import grams as G
from tidemark.llm.common import table, text_of, written

SHINGLE = 5  # words
THRESHOLD = 0.8
BLOCK_WORDS = 2_000_000  # words of benchmark items that are sent to the tasks at a time
BINS_PER_SHINGLE = 8
FEW_SHINGLES = 4  # items of so few are candidates wherever a document shares one, whatever its bins

# letters of ASCII in lower case, digits and all bytes beyond ASCII stay; the rest parts words
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64())])


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)


def shingle_length(n_words: int, size: int = SHINGLE) -> int:
    """A text of fewer words is one shingle as a whole."""
    return min(n_words, size)


class Items:
    """Benchmark items of one block: their shingles by hash and in words."""

    def __init__(self, rows: list[tuple[int, str]], size: int):
        self.ids, self.exact, self.hashes, owners, lengths = [], [], [], [], []
        for item_id, text in rows:
            words = normal(text).split()
            k = shingle_length(len(words), size)
            if not k:
                continue
            h, _, _ = G.word_hashes(b" ".join(words))
            grams = np.unique(G.gram_hashes(h, k))
            self.exact.append({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
            self.hashes.append(grams)
            owners.append(np.full(len(grams), len(self.ids)))
            lengths.append(np.full(len(grams), k))
            self.ids.append(item_id)
        none = np.empty(0, np.int64)
        all_hashes = np.concatenate(self.hashes) if self.ids else np.empty(0, np.uint64)
        order = np.argsort(all_hashes)
        self.sorted = all_hashes[order]
        self.owner = (np.concatenate(owners) if owners else none)[order]
        self.length = (np.concatenate(lengths) if lengths else none)[order]
        # a bitmap by the leading bits turns nearly all other shingles away
        self.shift = np.uint64(64 - max(16, min(26, int(len(all_hashes)).bit_length() + 5)))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self.sorted >> self.shift] = True
        self.sizes = sorted(set(self.length.tolist()))


def bin_minima(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash: the least hash of each bin that has any."""
    where = hashes % np.uint64(bins)
    order = np.lexsort((hashes, where))
    where = where[order]
    return hashes[order][np.append(True, where[1:] != where[:-1])] if len(hashes) else hashes


def bins_for(n_shingles: int) -> int:
    """Bins of the size partition (a power of two) that a document falls into."""
    return BINS_PER_SHINGLE << max(n_shingles - 1, 0).bit_length()


def candidates(items: Items, grams: np.ndarray, near: np.ndarray, length: int) -> list[int]:
    """Items whose MinHash bins agree with a document's in one bin or more.

    ``grams`` are all shingle hashes of the document, ``near`` those that items may have too. The
    bins grow with the document's size partition, so that a short item inside it still shows: each
    shared shingle is the least of its bin with a probability of 0.94 or more. An item of few shingles
    could still be missed by that, so it is a candidate as soon as one is shared.
    """
    known = items.sorted[np.searchsorted(items.sorted, near) % max(len(items.sorted), 1)] == near
    near = np.unique(near[known])
    if not len(near):
        return []
    unique = np.unique(grams)
    bins = bins_for(len(unique))
    least = np.isin(near, bin_minima(unique, bins))
    first, last = np.searchsorted(items.sorted, near), np.searchsorted(items.sorted, near, "right")
    found = set()
    for h, is_least, a, b in zip(near, least.tolist(), first.tolist(), last.tolist()):
        for at in range(a, b):
            i = int(items.owner[at])
            if items.length[at] != length or i in found:
                continue
            if len(items.hashes[i]) <= FEW_SHINGLES or is_least and h in bin_minima(items.hashes[i], bins):
                found.add(i)
    return sorted(found)


def _search(items_of, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_of()
        for batch in batches:
            texts = [normal(t) for t in batch["text"].to_pylist()]
            ids = batch["doc_id"].to_pylist()
            out = []
            for a, b in G.groups(texts):
                data, h, starts, ends, first_word = G.joined_words(texts[a:b])
                for k in items.sizes:
                    grams = G.gram_hashes(h, k)
                    maybe = np.flatnonzero(items.bitmap[grams >> items.shift])
                    of = np.searchsorted(first_word, maybe, "right") - 1
                    inside = maybe + k <= first_word[of + 1]
                    maybe, of = maybe[inside], of[inside]
                    for d in np.unique(of).tolist():
                        places = maybe[of == d]
                        own = grams[first_word[d] : first_word[d + 1] - k + 1]
                        for i in candidates(items, own, grams[places], k):
                            mine = places[np.isin(grams[places], items.hashes[i])]
                            said = {b" ".join(data[starts[p] : ends[p + k - 1]].split()) for p in mine.tolist()}
                            shared = len(said & items.exact[i])
                            if shared >= threshold * len(items.exact[i]):
                                out.append((ids[a + d], items.ids[i], len(items.exact[i]), shared))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_FOUND)

    return run


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every item found inside a document.

    Words are runs of letters and digits in lower case; an item of fewer than ``size`` words is one
    shingle. Containment is the share of the item's distinct shingles that the document has, counted
    exactly, in words. The items are the query set: they go to the tasks in blocks of about
    ``block_words`` words each, one block after the other however many there are, and all documents
    meet each block. No document is shuffled.

    Items without words are in nothing, null or empty documents hold nothing. Repeated items and
    documents are reported for each row; a null id is reported as null. Further columns are not used.
    """
    spark = docs.sparkSession
    given = items.select(F.col("item_id").cast("long"), text_of().alias("text"))
    total = given.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (block_words * 4)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    results = None
    for block in range(blocks):
        mine = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r["item_id"], r["text"]) for r in mine.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sent = spark.sparkContext.broadcast(rows)
        found = written(texts.mapInArrow(_search(lambda sent=sent: Items(sent.value, size), threshold), "doc_id long, item_id long, n_shingles long, n_shared long"), "contained")
        sent.destroy()
        results = found if results is None else results.unionByName(found)
    return results.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold an item; all columns stay. A null doc_id is judged by its text alone."""
    check = F.xxhash64(text_of())
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("__check", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    found = contained_items(docs.select(check.alias("doc_id"), "text"), items, threshold)
    bad = found.select(F.col("doc_id").alias("__bad")).distinct()
    return tagged.join(bad, F.col("__check") == F.col("__bad"), "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words(name: str, key: str) -> str:
    return f"select row_number() over () as r, {key}, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from {name}"


_SQL = f"""
with items as (select *, least(len(w), {SHINGLE}) as k from ({_words('benchmark', 'item_id')}) where len(w) > 0),
docs as ({_words('documents', 'doc_id')}),
asked as (select distinct r, item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from items, unnest(range(1, len(w) - k + 2)) as g(i)),
totals as (select r, count(*) as n from asked group by r),
sizes as (select distinct k from items),
held as (
  select distinct d.r, doc_id, z.k, array_to_string(w[i:i + z.k - 1], ' ') as s
  from docs d, sizes z, unnest(range(1, len(w) - z.k + 2)) as g(i) where len(w) >= z.k)
select h.doc_id, a.item_id, any_value(t.n) as n_shingles, count(*) as n_shared, count(*) / any_value(t.n) as containment
from held h join asked a using (k, s) join totals t on t.r = a.r
group by h.r, h.doc_id, a.r, a.item_id having count(*) >= {THRESHOLD} * any_value(t.n)
"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {"op4_decontaminate": _SQL}
