import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mixing


def fill(sizes, weights, epochs):
    """Clamp and reshare until nothing is above its cap."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > epochs * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            return target
        for i in over:
            target[i] = epochs * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_water_fill_is_repeated_clamping(spark, sizes):
    rows = spark.createDataFrame([((False, f"s{i:02d}"), n) for i, n in enumerate(sizes)], "skey struct<none:boolean,name:string>, source_size long")
    got = {r["skey"]["name"]: r["target"] for r in mixing.water_fill(rows).collect()}
    want = fill(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))], 3)
    assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(want)


def test_takes_come_near_targets_and_repeat(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.least(F.col("id") % 40, F.lit(7))).alias("source"), F.expr("repeat('w ', int(1 + id % 13))").alias("text")
    )
    sized = docs.select("doc_id", "source", mixing.n_words().alias("size"))
    rows = mixing.repeats(sized, mixing.plan_mix(sized)).withColumn("taken", F.col("size") * F.col("times"))
    again = mixing.repeats(sized, mixing.plan_mix(sized)).withColumn("taken", F.col("size") * F.col("times"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"), F.max("times").alias("times")).collect():
        assert abs(r["taken"] - r["target"]) <= r["size"]
        assert r["times"] <= 3


def test_mix_keeps_columns_and_odd_rows(documents):
    docs = documents.withColumn("copy", F.lit("mine")).withColumn("skey", F.lit(1)).withColumn("target", F.lit("t"))
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, "mix_copy"]
    rows = out.collect()
    assert {r["copy"] for r in rows} == {"mine"} and max(r["mix_copy"] for r in rows) <= 3
    taken = {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    assert taken["é"] == 0 or taken["é"] <= 6


def test_a_long_plan_is_joined_in_parts(documents, monkeypatch):
    sized = documents.select("doc_id", "source", mixing.n_words().alias("size"))
    whole = sorted(map(str, mixing.repeats(sized, mixing.plan_mix(sized)).collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 0)
    assert sorted(map(str, mixing.repeats(sized, mixing.plan_mix(sized)).collect())) == whole


def test_empty_table(nothing):
    assert mixing.mix_sources(nothing).count() == 0


def test_twin(spark, documents):
    con = duckdb.connect()
    con.register("given", documents.toPandas())
    con.execute("create table documents as select cast(doc_id as bigint) as doc_id, text, source from given")
    want = sorted(con.execute(mixing._SQL).fetchall(), key=str)
    sized = documents.select("doc_id", "source", mixing.n_words().alias("size"))
    got = mixing.repeats(sized, mixing.plan_mix(sized)).selectExpr("doc_id", "size", "source_size", "target", "size * times as taken")
    assert sorted(map(tuple, got.collect()), key=str) == want
