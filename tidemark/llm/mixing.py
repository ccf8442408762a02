"""Mix sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, table, text_of, written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SLICE_DIGITS = 3  # hex digits of the order key that deal a source into slices
MAX_SOURCES = 100_000  # rows of a plan that may be broadcast; a longer one is joined in salted parts
SALTS = 64


def n_words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def order_key(seed: int) -> Column:
    """Seeded order of documents, the same wherever and whenever it is computed."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))


def _source_key() -> Column:
    return F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name"))


def water_fill(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of sources: ``(skey, source_size)`` in, ``weight`` and ``target`` added.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes.
    What exceeds ``max_epochs`` times a source is reshared by weight among the others, until none
    is above. The fixed point of that resharing has a closed form: in the order of cap by weight
    the first sources are full, and the level of the rest is what is left over their weights. So
    it takes one pass over a table with a row per source, which is the only table gathered here.
    """
    by_name = W.orderBy("skey.none", "skey.name")
    full_first = W.orderBy("ratio", "skey.none", "skey.name")
    up_to = full_first.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("weight", F.get(turn, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    total = W.partitionBy().orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("all_size", F.sum("source_size").over(total)).withColumn("all_weight", F.sum("weight").over(total))
    rows = rows.withColumn("left", F.col("all_size") - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))).withColumn(
        "open", F.col("all_weight") - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    )
    # the first source whose cap the level does not reach sets the level of all after it
    level = F.min(F.when(F.col("left") <= F.col("ratio") * F.col("open"), F.struct("ratio", (F.col("left") / F.col("open")).alias("level")))).over(total)
    return rows.withColumn("level", level["level"]).select(
        "skey", "source_size", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), "cap").alias("target")
    )


def plan_mix(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 0, digits: int = SLICE_DIGITS
) -> DataFrame:
    """One row per source: size, target, whole repetitions, and the last key of the fraction.

    ``sized`` has ``doc_id, source, size``. In the seeded order of its documents a source gives
    the documents whose middle lies within the fraction of an epoch that its target leaves over;
    so what it gives misses the target by half a document at most. A source is never sorted as a
    whole: slices of its order are summed first, and only the slice that holds the end is sorted.
    """
    rows = sized.select(_source_key().alias("skey"), order_key(seed).alias("okey"), F.col("size"))
    slices = written(rows.groupBy("skey", F.substring("okey", 1, digits).alias("slice")).agg(F.sum("size").alias("words")), "slices")
    targets = water_fill(slices.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = written(targets, "targets")
    before = W.partitionBy("skey").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        slices.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(targets.select("skey", "rest"), "skey")
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    )
    inside = rows.withColumn("slice", F.substring("okey", 1, digits)).join(ends.select("skey", "slice", "before", "rest"), ["skey", "slice"])
    alike = inside.groupBy("skey", "slice", "before", "rest", "okey").agg(F.sum("size").alias("size"))
    earlier = W.partitionBy("skey", "slice").orderBy("okey").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.col("size") / 2
    taken = alike.withColumn("middle", middle).where("middle <= rest").groupBy("skey").agg(F.max("okey").alias("last_okey"))
    # slices that lie before the end as a whole
    full = (
        slices.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(targets.select("skey", "rest"), "skey")
        .where(F.col("before") + F.col("words") <= F.col("rest"))
        .groupBy("skey")
        .agg(F.max(F.concat("slice", F.lit("~"))).alias("last_full"))
    )
    plan = targets.join(taken, "skey", "left").join(full, "skey", "left").select(
        "skey", "source_size", "weight", "target", "whole", "rest", F.greatest("last_okey", "last_full").alias("last_okey")
    )
    return written(plan, "plan")


def repeats(docs: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``times``, the number of copies to take.

    The plan has a row per source. Up to ``MAX_SOURCES`` rows it is broadcast, so that no text travels;
    a longer plan is dealt out ``SALTS`` times, so that a source with many documents is split.
    """
    fraction = (F.col("rest") > 0) & F.coalesce(order_key(seed) <= F.col("last_okey"), F.lit(False))
    added = plan.select(F.col("skey").alias("__skey"), "source_size", "target", "whole", "rest", "last_okey")
    keyed = docs.withColumn("skey", _source_key())
    same = F.col("skey") == F.col("__skey")
    if plan.count() <= MAX_SOURCES:
        joined = keyed.join(F.broadcast(added), same, "left")
    else:
        salted = added.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) == F.col("__salt")
        joined = keyed.join(salted, same & part, "left").drop("__salt")
    return (
        joined.drop("__skey")
        .withColumn("times", F.col("whole") + F.when(fraction, 1).otherwise(0))
        .drop("skey", "whole", "rest", "last_okey")
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 0
) -> DataFrame:
    """The mixed corpus: each document as many times as its source's share asks, ``copy`` from 1.

    Takes ``doc_id, source, text`` and any further columns, which stay; working columns of the
    same name are kept apart. Null or empty text has size 0 and shares the fate of its place in
    the order. Rows with one doc_id, also null, are decided together. A null source is a source
    of its own, after the others. An empty table stays empty.
    """
    given = docs.columns
    sized = written(docs.select("doc_id", "source", n_words().alias("size")), "sized")
    plan = plan_mix(sized, weights, max_epochs, seed)
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"))
    out = repeats(packed, plan, seed).where("times > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("mix_copy"))
    return out.select("row.*", F.col("mix_copy").alias("copy" if "copy" not in given else "mix_copy"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words().alias("size")), "sized")
    return repeats(sized, plan_mix(sized)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


_SQL = """
with sized as (
  select doc_id, source is null as none, coalesce(source, '') as name, md5(coalesce(cast(doc_id as varchar), '') || ':0') as okey,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
  from documents),
sizes as (select none, name, cast(sum(size) as bigint) as source_size from sized group by all),
weighed as (
  select *, cast(1 + (row_number() over (order by none, encode(name)) - 1) % 3 as double) as weight,
    cast(3 * source_size as double) as cap from sizes),
sums as (
  select *, cap / weight as ratio, sum(source_size) over () as all_size, sum(weight) over () as all_weight,
    coalesce(sum(cap) over f, 0) as cap_before, coalesce(sum(weight) over f, 0) as weight_before
  from weighed window f as (order by cap / weight, none, encode(name) rows between unbounded preceding and 1 preceding)),
leveled as (
  select *, (select (all_size - cap_before) / (all_weight - weight_before) from sums
    where all_size - cap_before <= ratio * (all_weight - weight_before) order by ratio, none, encode(name) limit 1) as level from sums),
targets as (select none, name, source_size, coalesce(least(cap, weight * level), cap) as target from leveled),
counted as (
  select none, name, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets),
keyed as (select none, name, okey, sum(size) as size from sized group by all),
middles as (
  select *, coalesce(sum(size) over (partition by none, name order by okey rows between unbounded preceding and 1 preceding), 0) + size / 2.0 as middle
  from keyed)
select d.doc_id, d.size, c.source_size, c.target,
  cast(d.size * (c.whole + case when c.target - c.whole * c.source_size > 0 and m.middle <= c.target - c.whole * c.source_size then 1 else 0 end) as bigint) as taken
from sized d join counted c using (none, name) join middles m using (none, name, okey)
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": _SQL}
