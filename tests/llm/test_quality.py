import duckdb

from tidemark.llm import quality

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_twin_on_odd_rows(spark, documents):
    more = spark.createDataFrame(
        [(100 + i, f"Common line {i} here\nown words " + " ".join(f"u{i}x{j}" for j in range(30)), "en", "h", 0, "x", 1) for i in range(40)], documents.schema
    )
    docs = documents.unionByName(more)
    con = duckdb.connect()
    con.register("given", docs.toPandas())
    con.execute("create table documents as select cast(doc_id as bigint) as doc_id, text, source from given")
    result = con.execute(quality._SQL)
    names = [d[0] for d in result.description]
    want = [tuple(r[names.index(c)] for c in COLUMNS) for r in result.fetchall()]
    got = [tuple(r) for r in quality.quality_rules(docs).select(COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_common_lines_deplete_a_document(spark):
    line = "every page of this host says this very same line of twenty words " * 3
    rows = [(i, line + "\n" + (" ".join("a" * (i + 1) + "b" * (j + 1) for j in range(100)) if i % 2 else ""), "h") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: (r["kept"], r["boiler_words"]) for r in quality.quality_rules(docs).collect()}
    assert {i for i, (k, _) in kept.items() if k} == {i for i in range(40) if i % 2}
    assert {b for _, b in kept.values()} == {39}


def test_empty_table(nothing):
    assert quality.quality_rules(nothing).count() == 0


def test_a_line_is_judged_alike_in_small_and_large_hosts(spark):
    """The same lines in 15 and in 5 documents of a host of 100 and of one of 10 000."""
    often, seldom = "this line stands in fifteen documents of its host", "this line stands in five documents of its host"
    rows = []
    for host, n in (("small", 100), ("large", 10_000)):
        for i in range(n):
            me = "".join(chr(97 + int(c)) for c in str(i))  # digits are alike in a normal line
            own = " ".join(f"{host}{me}{chr(97 + j)}" for j in range(25))
            rows.append((len(rows), f"{own}\n{often if i < 15 else seldom if i < 20 else own + ' more'}", host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality.quality_rules(docs)
    got = {(r["host"], r["boiler_words"]): r["count"] for r in out.groupBy("host", "boiler_words").count().collect()}
    assert got == {("small", 9): 15, ("small", 0): 85, ("large", 9): 15, ("large", 0): 9985}
