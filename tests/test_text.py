from pyspark.sql import functions as F

from tidemark.functions import schedule as X
from tidemark.functions import states as S
from tidemark.functions import text as T
from tests.test_period import check, run


def test_truncate_bytes(spark):
    texts = ["αβγ δεζ ηθι κλμ νξο", "漢字かな交じり文", "plain words of ASCII only", "naïve café", "short", "", None]
    cut = lambda t: None if t is None else t.encode()[:20].decode(errors="ignore")
    check(spark, [(t, cut(t)) for t in texts], lambda c: T.utf8_truncate(c, 20))


def test_truncate_every_cut(spark):
    text = "aé€😀�z😀ß"
    for n in range(0, len(text.encode()) + 2):
        expected = text.encode()[:n].decode("utf-8", errors="ignore")
        assert run(spark, [text], lambda c, n=n: T.utf8_truncate(c, n)) == [expected], n


def test_names(spark):
    pairs = [("left", "right"), (None, "alone"), (None, None), ("", ""), ("one", "two::three::four")]
    df = spark.createDataFrame(pairs, "a string, b string")
    joined = ["::".join("None" if x is None else x for x in p) for p in pairs]
    assert [r[0] for r in df.select(T.build_name("a", "b")).collect()] == joined
    check(spark, [(j, tuple(j.split("::", 1))) for j in joined], lambda c: T.split_name(c))


def test_screen_label(spark):
    df = spark.createDataFrame([(111, 77), (None, None)], "x long, y long")
    assert [r[0] for r in df.select(T.screen_label("x", "y")).collect()] == ["(111, 77)", "(None, None)"]


def test_uri(spark):
    df = spark.createDataFrame([("b", "2010120000", "f.gz")], "b string, t string, f string")
    row = df.select(T.partition_uri("b", "t", "f").alias("u")).select("u", T.split_uri("u").alias("s")).first()
    assert row.u == "s3://b/2010120000/f.gz"
    assert tuple(row.s) == ("s3://b", "2010120000/f.gz")


def test_name_like(spark):
    check(spark, [("my_FLOW_x", True), ("flo", True), ("flowww", True), ("fl", False)], lambda c: T.name_like(c, "flow"))


def test_overlay(spark):
    df = spark.createDataFrame(
        [({"a": "1", "b": "1"}, {"b": "2", "c": None}, {"c": "3"}), (None, {"x": "1"}, None)],
        "m map<string,string>, n map<string,string>, o map<string,string>",
    )
    out = [r[0] for r in df.select(T.overlay_maps("m", "n", "o")).collect()]
    assert out == [{"a": "1", "b": "2", "c": "3"}, {"x": "1"}]


def test_stringify(spark):
    df = spark.sql("select 1 as i, true as b, cast(null as int) as n, named_struct('x', 2) as s, array(1, 2) as l, map('k', 3) as m")
    row = T.stringify_json(df).first()
    assert row.json == '{"i":"1","b":"True","n":"None","s":{"x":"2"},"l":["1","2"],"m":{"k":"3"}}'


def test_states(spark):
    states = [S.EMBRYO, S.IN_PROGRESS, S.FINAL_RUN, S.PROCESSED, S.SKIPPED, S.NOOP]
    check(spark, [(s, i < 3) for i, s in enumerate(states)], S.is_active)
    check(spark, [(s, i >= 3) for i, s in enumerate(states)], S.is_finished)
    attempts = [S.REQUESTED, S.IN_PROGRESS, S.INVALID, S.PROCESSED, S.CANCELED, S.NOOP]
    check(spark, [(s, i < 3) for i, s in enumerate(attempts)], lambda c: S.is_active(c, attempt=True))
    check(
        spark,
        [(S.PROCESSED, S.PROCESSED), (S.NOOP, S.NOOP), (S.CANCELED, S.SKIPPED), (S.INVALID, "was"), (S.REQUESTED, "was")],
        lambda c: S.terminal_state(c, F.lit("was")),
    )


def parts_of(text):
    """(day, hour, minute) of each entry, read with plain string methods."""
    out = []
    for entry in text.removeprefix("at").split(","):
        day, _, clock = entry.strip().rpartition("-")
        hour, minute = clock.split(":")
        out.append((day or "*", int(hour), int(minute)))
    return out


TIMES = ["at 6:05", "at *-23:59", "at 2-11:10 , 6-00:00", "at  3-07:45,*-12:00 ,0-21:30", "at 1-1:01,1-1:02"]


def test_schedule_entries(spark):
    given = [[e.strip() for e in t.removeprefix("at").split(",")] for t in TIMES]
    check(spark, [*zip(TIMES, given), ("every 42", None)], X.entry_texts)
    check(spark, [("every 42", 42), ("every   86399", 86399), ("every 7", 7), (TIMES[0], None)], X.interval_seconds)
    long = "every " + " " * 40 + "1234567"
    check(spark, [(long, 1234567)], X.interval_seconds)
    assert [[tuple(e) for e in r] for r in run(spark, TIMES, X.entries)] == [parts_of(t) for t in TIMES]


def test_next_trigger(spark):
    from datetime import datetime, timedelta

    def step(now, text):
        at = now.replace(second=0) + (timedelta(minutes=1) if now.second else timedelta(0))
        while not any((h, m) == (at.hour, at.minute) and d in ("*", str(at.weekday())) for d, h, m in parts_of(text)):
            at += timedelta(minutes=1)
        return at

    for now in (datetime(2019, 3, 31, 11, 10), datetime(2021, 12, 31, 23, 58, 30), datetime(2020, 2, 29, 6, 5)):
        fixed = F.lit(str(now)).cast("timestamp_ntz")
        check(spark, [(t, step(now, t)) for t in TIMES], lambda c, f=fixed: X.next_trigger(f, c))
        check(spark, [("every 77", now + timedelta(seconds=77))], lambda c, f=fixed: X.next_trigger(f, c))
