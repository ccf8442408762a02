"""Importance resampling towards a target distribution, on hashed n-grams of words.

A scan with overlapping matches emits the n-grams of a text as spans; a running CRC over the spans
gives their buckets. The log-ratio of the target's bucket shares to the corpus's, summed over a
document, is its weight, and the documents with the highest weight plus Gumbel noise are drawn.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, text_of, written

BUCKETS = 10_000  # at most 65 536
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Words are runs of digits, lower-case letters and bytes above ASCII; A-Z is lower-cased, all else separates.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: After each space: the word there, and with the one or two words that follow. The space in front is the
#: left border, literal so that the search skips from one to the next; a lookaround holds the right one.
_GRAMS = regex.compile(rb" ([^ ]++)( [^ ]++)?+( [^ ]++)?+(?![^ ])")


def collapsed(text: bytes) -> bytes:
    """The words of a text, in lower case, each behind a single space."""
    words = text.translate(_FOLD).split()
    return b" " + b" ".join(words) if words else b""


def gram_buckets(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run of one to three words."""
    found = array("I")
    add, words = found.append, collapsed(text)
    for match in _GRAMS.finditer(words, overlapped=True):
        one, two, three = match.groups()
        h = crc32(one)
        add(h)
        if two is not None:
            h = crc32(two, h)
            add(h)
            if three is not None:
                add(crc32(three, h))
    return words.count(b" "), (np.frombuffer(found, np.uint32) % np.uint32(buckets)).astype(np.uint16)


_SCANNED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("buckets", T.BinaryType())])


def _scanner(buckets: int):
    @F.arrow_udf(_SCANNED)
    def scan(texts: pa.Array) -> pa.Array:
        words, grams = [], []
        for i in range(len(texts)):
            n, found = gram_buckets(texts[i].as_py().encode("utf-8", "surrogatepass"), buckets)
            words.append(n)
            grams.append(found.tobytes())
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(grams, pa.binary())], ["n_words", "buckets"])

    return scan


def scanned(docs: DataFrame, carry: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``row`` (the columns to carry), ``doc_id``, ``n_words``, ``buckets``: two bytes for each feature of the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None)
    return docs.select(row.alias("row"), "doc_id", _scanner(buckets)(text_of()).alias("s")).select("row", "doc_id", "s.n_words", "s.buckets")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket. Each task sends one row a bucket, the driver gets ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for grams in batch["buckets"]:
                total += np.bincount(np.frombuffer(grams.as_py(), np.uint16), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of smoothed shares, rounded down."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64
    )


def noise(seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, drawn by the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weighed(features: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight, score`` of scanned rows."""
    sent = features.sparkSession.sparkContext.broadcast(gains)

    @F.arrow_udf(T.LongType())
    def weigh(grams: pa.Array) -> pa.Array:
        return pa.array([int(sent.value[np.frombuffer(g.as_py(), np.uint16)].sum()) for g in grams], pa.int64())

    rows = features.select("row", "doc_id", "n_words", (F.octet_length("buckets") / 2).cast("long").alias("n_features"), weigh("buckets").alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(seed))


def ranked(scores: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scores`` with ``rank``, 1 for the highest; null where it isn't drawn.

    Rows long enough are dealt out by ranges of the order, sorted within them and written with their
    places; the rank is the place plus the sizes of the ranges before, a row for each partition.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    long = scores.where(F.col("n_words") >= min_words)
    placed = written(long.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("place", 33)
    before = F.coalesce(F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("held"))
    drawn = placed.count() * percent // 100
    sizes = F.broadcast(sizes.select("part", before.alias("before")))  # as many rows as there are shuffle partitions
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.join(sizes, part == F.col("part")).withColumn("rank", F.when(rank <= drawn, rank))
    short = scores.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return out.select(*scores.columns, "rank").unionByName(short)


def resample(
    docs: DataFrame, target: DataFrame, carry: Sequence[str] | None = None, percent: int = PERCENT, min_words: int = MIN_WORDS,
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with its weight towards ``target`` (``text``) and its rank among those drawn.

    Returns ``row`` (the columns named by ``carry``, by default all of ``docs``), ``doc_id, n_words, n_features,
    weight, score, rank``. Of the documents with at least ``min_words`` words, ``percent`` of a hundred (rounded
    down) get a rank by descending score, ties by ascending id; others have none. To take the sample, keep the
    rows with a rank. Counts and weights cover all of every text, also of documents too short to be drawn.

    Null or empty text has no words and weight 0. Rows are documents of their own; rows with one id draw the
    same noise, a null id that of an empty one, and it comes last among ties. An empty target or an empty
    table is smoothed like any other; an empty ``docs`` stays empty. Columns named like the results stay in ``row``.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be from 1 to 65536")
    features = written(scanned(docs, docs.columns if carry is None else carry, buckets), "features")
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(scanned(target.select(F.lit(0).alias("doc_id"), "text"), (), buckets), buckets))
    return ranked(written(weighed(features, gains, seed), "scores"), percent, min_words)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark"), ["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


_SQL = f"""
with texts as (
  select doc_id, text, true as mine from documents union all select item_id, text, false from benchmark),
tokens as (
  select doc_id, mine, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from texts),
grams as (
  select doc_id, mine, array_to_string(w[i:i + k - 1], ' ') as gram
  from tokens, unnest(range(1, len(w) + 1)) as g(i), (values (1), (2), (3)) as s(k) where i + k - 1 <= len(w)),
bytes as (
  select gram, list_transform(regexp_extract_all(hex(encode(gram)), '..'), lambda x: ('0x' || x)::bigint) as b
  from (select distinct gram from grams)),
crcs as (
  select gram, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, ({_crc_table()}::bigint[])[1 + (xor(c, x) & 255)])), 4294967295::bigint) % {BUCKETS} as bucket
  from bytes),
features as (select doc_id, mine, bucket from grams join crcs using (gram)),
counts as (select bucket, count(*) filter (where mine) as s, count(*) filter (where not mine) as t from features group by bucket),
gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + {BUCKETS})::double / ((s + 1)::double * (sum(t) over () + {BUCKETS})::double)))::bigint as gain
  from counts),
weights as (select doc_id, count(*) as n, sum(gain)::bigint as weight from features join gains using (bucket) where mine group by doc_id),
scores as (
  select doc_id, len(w) as n_words, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from tokens left join weights using (doc_id) where mine),
ranks as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scores where n_words >= {MIN_WORDS})
select doc_id, n_features, weight, score, case when rank <= n * {PERCENT} // 100 then rank end as rank
from scores left join ranks using (doc_id)
"""

QUERIES = {"op12_importance": op12_importance}
ORACLES = {"op12_importance": _SQL}
