"""Quality rules: figures of each text, and lines that too many documents of a host share.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, let, table, text_of, written

WINDOW = 8  # words
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate if more documents of its host hold it than this, however large the host is.
LINE_DOCS = 10
#: A document is depleted if less than this share of its words is left.
KEEP_PERCENT = 50
SALTS = 8


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words of ``tokens`` that lie in a window found twice or more. Sorts windows within the row."""

    def of_windows(hashes: Column) -> Column:
        n = F.size(hashes)

        def covered(places: Column) -> Column:
            # places: sorted starts of repeated windows; each adds the words up to the next start
            last = F.size(places) - 1
            steps = F.transform(places, lambda p, i: F.when(i < last, F.least(F.get(places, i + 1) - p, F.lit(window))).otherwise(F.lit(window)))
            return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

        def starts(ordered: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(ordered, j)["h"] == F.get(ordered, i)["h"], F.lit(False))
            twice = F.filter(ordered, lambda x, i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        repeated = let(let(F.sort_array(pairs), starts), covered)
        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(repeated)

    def hashed(each: Column) -> Column:
        last = F.size(each) - window
        at = F.sequence(F.lit(0), last)
        whole = F.transform(at, lambda i: F.xxhash64(*[F.get(each, i + k) for k in range(window)]))
        return F.when(last >= 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(let(F.transform(tokens, lambda w: F.xxhash64(w)), hashed), of_windows)


def normal_line(line: Column) -> Column:
    """Lower case, digits alike, white space single: what makes two lines the same."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"[{WHITE}]+", " "))


def figures(docs: DataFrame) -> DataFrame:
    """Per row: the base figures, and its distinct normalised lines as hashes with their words.

    Long texts stay within their row: nothing but hashes of lines leaves it.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{WHITE}]")))
    per_line = lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(words(x)).alias("n"))
    cols = {
        "n_words": let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r"))),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "lines": F.transform(lines, per_line),
    }
    rows = docs.select("doc_id", F.col("source").alias("host"), *[c.alias(k) for k, c in cols.items()])
    return rows.select(
        "doc_id", "host", F.col("n_words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("n_words.r").alias("n_repeat_words"), "lines",
    )


def quality_rules(
    docs: DataFrame,
    line_docs: int = LINE_DOCS,
    keep_percent: float = KEEP_PERCENT,
) -> DataFrame:
    """Base figures and verdict of every row of ``docs`` (``doc_id, text, source``).

    Besides the base rules, lines are counted across documents: a normalised line that more than
    ``line_docs`` rows of its host hold is boilerplate, in a small host as in a large one. Its words leave the document (``boiler_words``), and a document with less than
    ``keep_percent`` of its words left, or too few, is rejected.

    A row is a document, so repeated rows count each. Null text is empty, and fails the base rules;
    null source is a host of its own. Lines are compared by 64-bit hash within a host. Counting
    combines on the map side, and the return join deals each line out ``SALTS`` times, so neither
    a frequent line nor a large host meets in one task. Further columns are not used.
    """
    rows = written(figures(docs).withColumn("row_id", F.monotonically_increasing_id()), "figures")
    host = F.struct(F.col("host").isNull().alias("none"), F.coalesce("host", F.lit("")).alias("name"))
    held = rows.select("row_id", host.alias("hkey"), F.explode("lines").alias("line")).select("row_id", "hkey", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    once = rows.select(host.alias("hkey"), F.explode(F.array_distinct("lines.h")).alias("h"))
    frequent = (
        once.groupBy("hkey", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > line_docs)
        .select("hkey", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    boiler = (
        held.withColumn("salt", (F.col("row_id") % SALTS).cast("int"))
        .join(frequent, ["hkey", "h", "salt"])
        .groupBy("row_id")
        .agg(F.sum("n").alias("boiler_words"))
    )
    left = F.col("n_words") - F.col("boiler_words")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return (
        rows.drop("lines")
        .join(boiler, "row_id", "left")
        .withColumn("boiler_words", F.coalesce("boiler_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= MIN_WORDS) & (left * 100 >= F.col("n_words") * keep_percent))
        .drop("row_id")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_SQL = f"""
with docs as (select row_number() over () as r, doc_id, source is null as none, coalesce(source, '') as host, coalesce(text, '') as text from documents),
tokens as (select r, doc_id, none, host, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
  list_filter(string_split(text, '\n'), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from docs),
windows as (
  select r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as win from tokens, unnest(range(1, len(w) - {WINDOW - 2})) as g(i)
  where len(w) >= {WINDOW}),
twice as (select r, i from (select r, i, count(*) over (partition by r, win) as c from windows) where c > 1),
covered as (
  select r, sum(least({WINDOW}, coalesce(lead - i, {WINDOW}))) as n
  from (select r, i, lead(i) over (partition by r order by i) as lead from twice) group by r),
held as (
  select r, none, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as line,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as n
  from (select r, none, host, unnest(lines) as line from tokens)),
frequent as (select none, host, line from held group by all having count(distinct r) > {LINE_DOCS}),
boiler as (select r, sum(n) as n from held join frequent using (none, host, line) group by r),
figures as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(translate(text, ' \t\n\x0b\x0c\r', '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '{SYMBOLS}', '')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words, cast(coalesce(b.n, 0) as bigint) as boiler
  from tokens left join covered c using (r) left join boiler b using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    and n_words - boiler >= {MIN_WORDS} and 100 * (n_words - boiler) >= {KEEP_PERCENT} * n_words as kept
from figures
"""

QUERIES = {"op5_quality": op5_quality}
ORACLES = {"op5_quality": _SQL}
