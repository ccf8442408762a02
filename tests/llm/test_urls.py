import pytest

from tidemark.llm import urls as U


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme/x", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("HTTP://A.Org/es/", "a.org", "/es/", "org/", "allow"),
        ("http://a.org", "a.org", "", None, "allow"),
        ("http://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        ("http://x.example.org/en/12?q=/a#b", "x.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        ("http://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"),
        ("http://a.com?x=1", "a.com", "", None, "allow"),
        ("x://É.net#a://b", "É.net", "", None, "allow"),
        ("http://www.Listed.net/p.html?utm_a=1&ref=2#t", "www.listed.net", "/p.html", None, "block"),
        ("http://listed.net/q?a=1&utm_b=2", "listed.net", "/q", None, "block"),
        ("http://listed.net/q?a=2", "listed.net", "/q", None, "allow"),
    ],
)
def test_rules_and_list(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string").selectExpr("*", "'z' as canonical", "1 as block")
    listed = spark.createDataFrame([("listed.net/p",), ("listed.net/q?a=1",), ("listed.net/p",), (None,), ("",)], "canonical string")
    r = U.filter_urls(pages, listed).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


@pytest.mark.parametrize("broadcast_blocks", [U.BROADCAST_BLOCKS, 0])
@pytest.mark.parametrize("bits", [0, U.BITS_PER_URL])
def test_filter_misses_nothing_and_the_join_takes_back_false_hits(spark, monkeypatch, bits, broadcast_blocks):
    monkeypatch.setattr(U, "BITS_PER_URL", bits)  # without bits one block holds all, so full that nearly everything passes
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h.net/', id) as url")
    listed = spark.range(0, 3000, 3).selectExpr("concat('h.net/', id) as canonical")
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(pages, listed, broadcast_blocks=broadcast_blocks).collect()}
    assert got == {i: "allow" if i % 3 else "block" for i in range(3000)}


def test_the_filter_grows_with_the_list(spark):
    """Few URLs pass that are not listed, whatever the length of the list."""
    assert U.blocks_for(0) == 1 and U.blocks_for(30_000_000) * 512 >= 30_000_000 * U.BITS_PER_URL > U.blocks_for(30_000_000) * 256
    listed = spark.range(20_000).selectExpr("concat('h.net/', id) as canonical")
    blocks = U.bloom_blocks(listed, U.blocks_for(20_000))
    others = spark.range(20_000, 40_000).selectExpr("concat('h.net/', id) as canonical")
    met = others.withColumn("block", U._block(U.F.col("canonical"), U.blocks_for(20_000))).join(blocks, "block")
    for i, bit in enumerate(U._bits(U.F.col("canonical"))):
        met = met.where(U.F.col(f"w{i}").bitwiseAND(bit) != 0)
    assert met.count() < 400


def test_a_very_long_url(spark):
    url = "http://Long.net/" + "a" * 500_000 + "?utm_x=1"
    pages = spark.createDataFrame([(1, url)] * 3, "page_id long, url string")
    listed = spark.createDataFrame([("long.net/" + "a" * 500_000,)], "canonical string")
    assert [r["verdict"] for r in U.filter_urls(pages, listed).collect()] == ["block"] * 3
    assert [r["verdict"] for r in U.filter_urls(pages, listed, broadcast_blocks=0).collect()] == ["block"] * 3


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "canonical string")
    assert [r["verdict"] for r in U.filter_urls(pages, none).collect()] == ["allow"] * 2
    assert U.filter_urls(pages.where("false"), none).count() == 0


def test_size_of_what_is_broadcast_is_bounded():
    assert U.blocks_for(0) == 1 and U.blocks_for(10**6) <= U.BROADCAST_BLOCKS < U.blocks_for(10**8) <= U.blocks_for(10**15) == 1 << 30
