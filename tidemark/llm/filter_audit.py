"""Filter interaction audit: what each filter removes, in every order in which they can be applied."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, text_of, written
from tidemark.llm.transducer import COLUMNS, text_figures

#: A document fails a filter where its condition holds. E, the repeated text, is judged across the table.
FILTERS = {
    "A": lambda f: f["n_words"] < 100,
    "B": lambda f: f["n_distinct"] * 100 < f["n_words"] * 80,
    "C": lambda f: f["n_capitals"] * 100 > f["n_points"] * 10,
    "D": lambda f: f["n_symbols"] > 0,
}
REPEATED = "E"
LETTERS = "".join(FILTERS) + REPEATED
AT_ONCE = 256  # texts of an Arrow batch that are copied together


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COLUMNS]))
def _figures(texts: pa.Array) -> pa.Array:
    data = texts.cast(pa.binary())
    found = np.concatenate([text_figures(data.slice(i, AT_ONCE).to_pylist()) for i in range(0, max(len(data), 1), AT_ONCE)])
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(COLUMNS))], list(COLUMNS))


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, t1, t2, mask``: per row the filters it fails within its text, one bit each; and 128 bits of its text."""
    text = text_of()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), _figures(text).alias("f"))
    mask = sum((F.when(fails(F.col("f")), 1 << k).otherwise(0) for k, fails in enumerate(FILTERS.values())), F.lit(0))
    return rows.select("doc_id", "part", "t1", "t2", mask.alias("mask"))


def _labels(labels: DataFrame) -> DataFrame:
    """One row per labelled document: whether any of its rows says good, and toxic."""
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    return marks.withColumnRenamed("doc_id", "__doc")


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail, at most 32 rows a part.

    Rows with one text and one id are counted before they are joined. The first of equal texts is found
    by a minimum that combines on the map side, and the join that marks it is by text and id, so a large
    group of copies is no hot key.
    """
    rows = written(failures(docs), "failures")
    first = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"))
    first = first.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "first_id", F.lit(True).alias("is_first"))
    marks = _labels(labels)
    labelled = rows.join(marks, F.col("doc_id") == F.col("__doc"), "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("good", "toxic")})
    counted = labelled.groupBy("t1", "t2", "doc_id", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    same = (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    bit = 1 << LETTERS.index(REPEATED)
    marked = counted.join(first, same, "left").withColumn("mask", F.col("mask") + F.when(F.col("is_first"), 0).otherwise(bit))
    total = lambda c: F.sum(F.col("n") * F.col(c)).alias(c)
    return marked.groupBy("part", "mask").agg(total("good"), total("toxic"), F.sum("n").alias("n"))


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every order and step over ``cells``: a row each per part, zeros included.

    A part has at most 32 cells, which are gathered and summed within the row.
    """
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    each = held.select("part", "cells", F.explode(orders).alias("filter_order")).select(
        "part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    )
    bits = F.array(*[F.lit(1 << k) for k in range(len(letters))])
    bit_at = lambda i: F.get(bits, F.position(F.substr("filter_order", i, F.lit(1)), F.lit(letters)) - 1)
    steps = F.sequence(F.lit(1), F.lit(len(letters)))
    earlier = F.aggregate(F.filter(steps, lambda j: j < F.col("step")), F.lit(0), lambda a, j: a + bit_at(j))
    each = each.withColumns({"own": bit_at(F.col("step")), "earlier": earlier})
    fails, failed = (lambda c: c["mask"].bitwiseAND(F.col("own")) > 0), (lambda c: c["mask"].bitwiseAND(F.col("earlier")) > 0)

    def total(where, what=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + what(c))

    removed = lambda c: fails(c) & ~failed(c)
    # a document that fails k filters is removed by each of them in one of k orders
    orders_first = lambda c: c["n"] * (F.lit(math.factorial(len(letters))) / F.bit_count(c["mask"])).cast("long")
    return each.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & ~failed(c)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: fails(c) & failed(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, orders_first).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per ``part``, order of the filters and step: what the filter of the step does where it stands.

    ``docs`` has ``doc_id, text, lang``, ``labels`` has ``doc_id, quality, toxic``. A part holds the rows
    with one value of ``lang``; null is the empty string. Columns: ``kept`` after the step, ``removed`` in
    it, ``redundant`` (fails its filter but was removed before), ``unique_fails`` (fails only its filter),
    ``good_lost`` and ``toxic_lost`` (removed in the step, with that label), ``shapley`` (what its filter
    removes, summed over all orders).

    A row is a document, so repeated rows count each. Null or empty text has no words. The repeated-text
    filter fails a row if a smaller id has the same text anywhere in the table; null is the largest id, and
    rows that share the least id are all first. Several label rows of a document count as one that says
    what any of them says; a null label or id says nothing. An empty table has no parts and gives no rows;
    further columns are not used. Texts are compared by 128 bits of hash.
    """
    return audit(failure_cells(docs, labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(LETTERS))
_SQL = f"""
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
failed as (
  select part, doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
    + 4 * (100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by text))::int as mask
  from docs),
cells as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from failed group by all),
steps as (
  select filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) as own,
    coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(substr(filter_order, j::int, 1)) - 65))), 0)::int as earlier
  from (values {_ORDERS}) as o(filter_order), (select unnest(range(1, 6))::int as step) as s)
select part, filter_order, step,
  coalesce(sum(n) filter (where mask & (own | earlier) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (where mask & own > 0 and mask & earlier = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (where mask & own > 0 and mask & earlier > 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (where mask = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where mask & own > 0 and mask & earlier = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (where mask & own > 0 and mask & earlier = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) filter (where mask & own > 0), 0)::bigint as shapley
from cells, steps group by all
"""

QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {"op11_filter_audit": _SQL}
