"""SimHash near-dedup: fingerprints compared in bit planes with carry-save counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import grams as G
from tidemark.llm.common import table, written
from tidemark.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 2048  # members of a bucket that are compared together
LANES = 64
NO_ID = (1 << 63) - 1

SIMILAR = 0.8  # share of common shingles of five words
SIMILAR_SHINGLE = 5
WORDS = 8  # of a wide fingerprint, 64 bits each
MARGIN = 6  # standard deviations of the distance at that similarity; what is a candidate is checked exactly
BANDS, ROWS = 16, 4  # least hashes that bring documents of that similarity together: all but one in 5000


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is in more than half of the shingle hashes. No words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        starts, ends = [0], [len(joined)]
    else:
        upto = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *upto[:-size].tolist()]
        ends = (upto[size - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])]
        planes = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += planes.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(starts)).tolist())


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


class Counter:
    """Counts of set bits in many lanes at once, one lane a bit of each word.

    The sum of a lane lies across ``k`` planes. It starts so high that the carry out of the last
    plane means just this: more than ``radius`` bits were set.
    """

    def __init__(self, shape, radius: int):
        k = max(radius.bit_length(), 1)
        start = (1 << k) - 1 - radius
        self.sums = [np.full(shape, 0xFFFFFFFFFFFFFFFF if start >> i & 1 else 0, np.uint64) for i in range(k)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, plane: np.ndarray) -> None:
        for i, total in enumerate(self.sums):
            carry = total & plane
            self.sums[i] = total ^ plane
            plane = carry
        self.over |= plane

    def open(self) -> np.ndarray:
        """Words in which a lane is still within the radius."""
        return self.over != np.uint64(0xFFFFFFFFFFFFFFFF)

    def keep(self, words: np.ndarray) -> None:
        self.sums = [s[words] for s in self.sums]
        self.over = self.over[words]


def bit_planes(values: np.ndarray, byte: int) -> np.ndarray:
    """Eight vertical planes of one byte of the values (n x words); n is a multiple of ``LANES``."""
    column = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1)[:, byte])
    bits = np.ascontiguousarray(np.unpackbits(column.reshape(-1, 1), axis=1).T)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of fingerprints (n x words) differ in at most ``radius`` bits. Blocks that all exceed it are abandoned."""
    n, words = a.shape
    differ = np.full((-(-n // LANES) * LANES, words), 0xFFFFFFFFFFFFFFFF, np.uint64)
    differ[:n] = a ^ b
    near = np.zeros(len(differ), bool)
    blocks = np.arange(len(differ) // LANES)
    counter = Counter(len(blocks), radius)
    for byte in range(8 * words):
        for plane in bit_planes(differ.reshape(-1, LANES, words)[blocks].reshape(-1, words), byte):
            counter.add(plane)
        left = counter.open()
        if not left.all():
            blocks = blocks[left]
            counter.keep(left)
            if not len(blocks):
                return near[:n]
    within = np.unpackbits((~counter.over).view(np.uint8), bitorder="little").astype(bool)
    near.reshape(-1, LANES)[blocks] = within.reshape(-1, LANES)
    return near[:n]


def tile_within(members: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) within the radius in one large group: planes of all members against 64 of them at a time."""
    m, words = members.shape
    padded = np.zeros((-(-m // LANES) * LANES, words), np.uint64)
    padded[:m] = members
    planes = np.concatenate([bit_planes(padded, byte) for byte in range(8 * words)])
    for at in range(0, m, LANES):
        bits = np.unpackbits(members[at : at + LANES].view(np.uint8), axis=1)
        queries = np.where(bits.astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        rest = planes[:, at // LANES :]  # earlier members have met these as queries
        counter = Counter((len(queries), rest.shape[1]), radius)
        for k in range(len(planes)):
            counter.add(rest[k][None, :] ^ queries[:, k][:, None])
            if k % 8 == 7 and not counter.open().any():
                break
        else:
            near = np.unpackbits((~counter.over).view(np.uint8), axis=1, bitorder="little")[:, : m - at]
            i, j = np.nonzero(near)
            later = j > i
            yield i[later] + at, j[later] + at


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels after joining ``a`` and ``b`` pairwise; ``label[x] <= x`` are roots."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


Alike = Callable[[int, int], bool]


def _union_alike(label: np.ndarray, a: np.ndarray, b: np.ndarray, alike: Alike, base: int = 0) -> np.ndarray:
    """As ``_union``, but a pair joins only if it is alike. Pairs that are joined already needn't be checked."""
    apart = label[a] != label[b]
    for x, y in zip(a[apart].tolist(), b[apart].tolist()):
        p, q = label[x], label[y]
        if p != q and alike(x + base, y + base):
            low, high = min(p, q), max(p, q)
            label[label == high] = low
    return label


def group_links(group: np.ndarray, values: np.ndarray, radius: int, small: int = 64, alike: Alike | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (by place) that join what lies within the radius inside each group; ``group`` is sorted.

    ``values`` are n x words. There is at most one link a member. With ``alike`` a pair within the radius
    counts only if that says so of its places; every pair is asked for, but for those joined by others.
    """
    label = np.arange(len(values))
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    for s, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        own = np.arange(size)
        for i, j in tile_within(values[s : s + size], radius):
            own = _union(own, i, j) if alike is None else _union_alike(own, i, j, alike, s)
        label[s : s + size] = own + s
    size_of = np.repeat(sizes, sizes)
    at = np.flatnonzero((size_of > 1) & (size_of <= small))
    step = 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        for k in range(0, len(at), 1 << 18):
            some = at[k : k + (1 << 18)]
            near = some[pairs_within(values[some], values[some + step], radius)]
            if alike is not None:
                apart = near[label[near] != label[near + step]]
                near = apart[np.array([alike(x, x + step) for x in apart.tolist()], bool)]
            label = _union(label, near, near + step)
        step += 1
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_set(text: bytes, size: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order. A text of fewer words is one shingle."""
    h, _, _ = G.word_hashes(text.lower())
    return np.unique(G.gram_hashes(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64)


def jaccard_reaches(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, each in order, share so much of their union."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) / len(b) < similarity:
        return not len(b)
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared) >= similarity


def _alike(ids: np.ndarray, texts: pa.ChunkedArray, similarity: float) -> Alike:
    sets: dict[int, np.ndarray] = {}

    def of(place: int) -> np.ndarray:
        fp = int(ids[place])
        if fp not in sets:
            sets[fp] = shingle_set(texts[place].as_py())
        return sets[fp]

    return lambda x, y: jaccard_reaches(of(x), of(y), similarity)


def _linker(radius: int, similarity: float | None = None, at_once: int = 1 << 16, at_most: int = 1 << 24):
    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        keys = [t[c].to_numpy() for c in ("t", "key", "i", "j")]
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        ids = t["fp"].to_numpy()
        values = ids.reshape(-1, 1).view(np.uint64)
        if "bits" in t.column_names:
            values = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
        alike = _alike(ids, t["text"].cast(pa.binary()), similarity) if similarity is not None else None
        a, b = group_links(np.cumsum(change), values, radius, alike=alike)
        return pa.RecordBatch.from_arrays([pa.array(ids[x]) for x in (a, b)], schema=_LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # whole buckets only: what has the last row's key waits
            same = np.ones(batch.num_rows, bool)
            for c in ("t", "key", "i", "j"):
                v = batch[c].to_numpy()
                same &= v == v[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            whole = sum(b.num_rows for b in held) + cut >= at_once or sum(b.nbytes for b in [*held, batch]) >= at_most
            if cut and whole:
                yield links([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield links(held)

    return run


def block_masks(n: int, radius: int) -> list[int]:
    """Masks of bits of which at least one is free of differences, for ``n`` values in 64 bits.

    The bits fall into radius + g blocks, of which two values within the radius share g. More blocks
    make more but finer keys; g grows until a key of random values is shared by few.
    """
    g = 1
    while g < 8 and 2 ** (64 * g / (radius + g)) < 4 * n:
        g += 1
    k = radius + g
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(k)]
    return [sum(c) for c in combinations(blocks, g)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(keyed: DataFrame, tile: int, once: bool = False) -> DataFrame:
    """``t, key, i, j, fp``: members of buckets by pairs of tiles. With ``once``, of buckets with the same members only one."""
    members = [F.bit_xor(F.xxhash64("fp")).alias("m1"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("m2")] if once else []
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), *members).where("n > 1")
    if once:
        sizes = sizes.groupBy("n", "m1", "m2").agg(F.min(F.struct("t", "key")).alias("one")).select("one.*", "n")
    sizes = sizes.select("t", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    met = keyed.join(sizes, ["t", "key"]).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = met.select("t", "key", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return dealt.select("t", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "fp")


def _tile_links(dealt: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    ordered = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return ordered.mapInArrow(_linker(radius, similarity), "a long, b long")


def bucket_links(keyed: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs within ``radius`` bits in one bucket.

    ``keyed`` has ``t, key, fp``: the buckets of each distinct ``fp``, which is the fingerprint itself.
    Buckets of one are dropped before anything more travels. A bucket above ``tile`` is dealt out: its
    members fall into tiles by hash and each pair of tiles is a task's group, so it is compared whole, by
    many tasks. A group yields a link a member at most, never all pairs.
    """
    return _tile_links(_dealt(keyed, tile), radius)


def similar_links(keyed: DataFrame, texts: Callable[[DataFrame], DataFrame], radius: int, similarity: float, tile: int = TILE) -> DataFrame:
    """As ``bucket_links``, but a pair within the radius links only if the texts' shingles are so similar.

    ``texts`` gives ``fp, bits, text`` of the ``fp`` asked for. Copies of a text meet in many bands, so of
    buckets with the same members one is compared. Texts are compared in the task of their bucket, pair by
    pair, without the pairs that others have joined already.
    """
    dealt = written(_dealt(keyed, tile, once=True), "dealt")
    return _tile_links(dealt.join(texts(dealt.select("fp").distinct()), "fp"), radius, similarity)


def fingerprint_links(values: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links of all pairs of distinct ``fp`` within ``radius`` bits, by buckets of shared blocks of bits."""
    masks = block_masks(values.count(), radius)
    keyed = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_long(m))) for m in masks])).alias("t", "key"))
    return bucket_links(keyed, radius, tile)


def _grouped(marked: DataFrame, values: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``doc_id, th, fp, component, component_id`` of rows by the components of their fingerprints."""
    roots = components(links, name).withColumnRenamed("node", "fp")
    placed = values.join(roots, "fp", "left").withColumn("component", F.coalesce("root", "fp"))
    linked = placed.where("root is not null").groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = placed.where("root is not null").join(linked, "component").select("fp", "component", "component_id")
    alone = placed.where("root is null").select("fp", "component", F.col("first_id").alias("component_id"))
    return marked.join(written(known.unionByName(alone), f"{name}-components"), "fp").select("doc_id", "th", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, th, fp, component, component_id`` for every row of ``docs`` (``doc_id, text``).

    Fingerprints link at ``radius`` or fewer differing bits and components are what links reach;
    ``component`` is the least fingerprint in one and ``component_id`` its least doc_id (null only if
    all are). ``th`` is a hash of the text. Equal fingerprints are one value from the start, so a group
    of exact copies costs no more than one text. Null or wordless texts have fingerprint zero and
    are linked like others; repeated rows stay repeated. Further columns are not used.
    """
    text = F.coalesce("text", F.lit(""))
    marked = written(docs.select("doc_id", F.xxhash64(text).alias("th"), fingerprints(text).alias("fp")), "fingerprints")
    values = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "values")
    return _grouped(marked, values, fingerprint_links(values.select("fp"), radius), "simhash")


def radius_for(similarity: float, n_bits: int, margin: float = MARGIN) -> int:
    """Bits in which fingerprints of two equally large sets differ at this similarity, plus a margin."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(n_bits * share + margin * np.sqrt(n_bits * share * (1 - share)))


def sketch(text: str, size: int = SIMILAR_SHINGLE, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> tuple[bytes, list[int]]:
    """A wide fingerprint of the set of shingles, and a key for each band of their least hashes."""
    shingles = shingle_set(text.encode("utf-8", "surrogatepass"), size)
    counts = np.zeros(64 * words, np.int64)
    least = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
    seeds = np.arange(1, words + bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1)
    for at in range(0, len(shingles), 1 << 10):
        some = shingles[at : at + (1 << 10), None]
        turned = G.mix(some * seeds[:words]).view(np.uint8)
        counts += np.unpackbits(turned, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        turned = some * seeds[words:]
        turned ^= turned >> np.uint64(29)
        turned *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, turned.min(axis=0), out=least)
    bits = np.packbits(2 * counts > len(shingles), bitorder="little").tobytes()
    return bits, G.mix((least.reshape(bands, rows) * G.powers(rows)).sum(axis=1, dtype=np.uint64)).view(np.int64).tolist()


@F.pandas_udf(T.StructType([T.StructField("bits", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]))
def sketches(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sketch(t) for t in texts], columns=["bits", "keys"])


def similar_documents(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """As ``near_duplicates``, for texts that share so much of their shingles of five words.

    64 bits can't tell such a similarity, so fingerprints have ``64 * WORDS`` bits. They only find
    candidates, in bands of least shingle hashes, within a radius that is the distance at the similarity
    plus ``MARGIN`` standard deviations. A link stands if the shingle sets of both texts (by 64-bit hash)
    reach the similarity exactly, which is checked before components are formed; components still chain
    links. Texts with equal sketches are one value from the start; wordless texts are equal to each other.
    """
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", F.xxhash64(text).alias("th"), sketches(text).alias("s"))
    marked = written(marked.select("doc_id", "th", F.xxhash64("s.bits", "s.keys").alias("fp"), "s.bits", "s.keys"), "sketches")
    by_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("of"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    values = written(by_fp, "values")
    keyed = values.select("fp", F.posexplode("keys").alias("t", "key"))
    given = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))

    def texts(asked: DataFrame) -> DataFrame:
        wanted = values.join(asked, "fp", "left_semi").select("fp", "bits", F.coalesce("of.doc_id", F.lit(NO_ID)).alias("doc"), F.col("of.th").alias("th"))
        return given.join(wanted, ["doc", "th"]).select("fp", "bits", "text").dropDuplicates(["fp"])  # rows held twice

    links = similar_links(keyed, texts, radius_for(similarity, 64 * WORDS), similarity)
    return _grouped(marked.select("doc_id", "th", "fp"), values.select("fp", "first_id"), links, "similar")


def keep_first(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """One row of each group of similar documents, the one with the least doc_id; all columns stay."""
    found = similar_documents(docs, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = found.groupBy("doc_id", "component").agg(F.min("th").alias("__th"))  # ids held twice, or null
    one = one.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), "__th").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.select("row", F.coalesce("row.doc_id", F.lit(NO_ID)).alias("__doc"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("__hash"))
    joined = row.join(one, (F.col("__doc") == F.col("__id")) & (F.col("__hash") == F.col("__th")))
    return joined.dropDuplicates(["__doc", "__hash"]).select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
