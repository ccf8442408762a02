"""Line dedup: a line that many documents hold stays in one of them. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, table, text_of, written

MIN_CHARS = 20  # code points of a key that counts
MIN_DOCS = 3
BROADCAST_KEYS = 100_000  # most keys that are broadcast; see drop_common_lines
_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """What makes two lines the same: white space stripped at both ends, A-Z in lower case."""
    return F.btrim(F.translate(line, string.ascii_uppercase, string.ascii_lowercase), F.lit(_WHITE))


def _same_text(text: Column) -> dict[str, Column]:
    """128 bits of the text: beside its id they tell rows apart whose lines may fare differently."""
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, t1, t2, lines``: per row the hashed keys that are long enough, with their places.

    ``once`` marks one of the places of each key, so that summing it counts documents.
    """
    text = text_of()
    keys = F.transform(F.split(text, "\n"), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("at")))
    long = F.filter(keys, lambda k: F.length(k["key"]) >= min_chars)
    hashes = F.transform(long, lambda k: F.struct(F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit(1), k["key"]).alias("h2"), k["at"].alias("at")))

    def marked(ordered: Column) -> Column:
        def new(k: Column, i: Column) -> Column:
            before = F.get(ordered, F.greatest(i - 1, F.lit(0)))
            return (i == 0) | (before["h1"] != k["h1"]) | (before["h2"] != k["h2"])

        return F.transform(ordered, lambda k, i: F.struct(k["h1"], k["h2"], k["at"], new(k, i).cast("int").alias("once")))

    return docs.select("doc_id", *[c.alias(k) for k, c in _same_text(text).items()], let(F.sort_array(hashes), marked).alias("lines"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``doc_id, t1, t2, places``: the places, sorted, of the lines that each text loses, if any.

    Counting combines on the map side. To mark the lines, keys of more than a ``broadcast_keys``-th of
    all lines are broadcast, of which there cannot be more than ``broadcast_keys``; all others have so
    few lines each that a join by key is even.
    """
    hashed = written(hashed_lines(docs, min_chars), "lines")
    each = hashed.select("doc_id", "t1", "t2", F.inline("lines"))
    held = each.groupBy("h1", "h2").agg(
        F.sum("once").alias("docs"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("no_id_last"), F.count(F.lit(1)).alias("n")
    )
    common = written(held.where(F.col("docs") >= min_docs), "common-lines")
    total = hashed.agg(F.sum(F.size("lines"))).first()[0] or 0
    limit = total // broadcast_keys
    heavy = F.col("n") > limit
    found = each.join(F.broadcast(common.where(heavy)), ["h1", "h2"])
    if limit >= min_docs:  # else every key that counts is among the heavy ones
        found = found.unionByName(each.join(common.where(~heavy), ["h1", "h2"]))
    stays = F.col("doc_id").isNull() | (~F.col("no_id_last") & (F.col("doc_id") == F.col("last")))
    return found.where(~stays).groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("places"))


def without_lines(text: Column, places: Column) -> Column:
    """``text`` without the lines at ``places`` (sorted): the stretches between them, joined again in order."""

    def cut(lines: Column) -> Column:
        last = F.size(places)
        start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(places, k - 1) + 1)
        end = lambda k: F.when(k == last, F.size(lines)).otherwise(F.get(places, k))
        stretches = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k)))
        return F.array_join(F.flatten(stretches), "\n")

    return F.when(places.isNull(), text).otherwise(let(F.split(text, "\n"), cut))


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` as ``row``, with ``removal``: the text kept, and the numbers of lines and of dropped ones.

    A line's key is the line without white space at both ends, A-Z in lower case. A key of at least
    ``min_chars`` code points that at least ``min_docs`` rows hold loses all its lines, except in the
    largest ``doc_id`` that holds it, which keeps all of them. Null is the largest id, and all rows with
    the largest id keep theirs, so ties need no choice. Null or empty text is one empty line. A row is
    a document, so repeated rows count each, and fare alike. Keys and texts are compared by 128 bits of
    hash. An empty table stays empty; all given columns stay in ``row``, also ones named like the results.
    """
    drops = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs, broadcast_keys).withColumnsRenamed({"doc_id": "__doc", "t1": "__t1", "t2": "__t2"})
    text = F.coalesce("row.text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns(_same_text(text))
    joined = rows.join(drops, F.col("row.doc_id").eqNullSafe(F.col("__doc")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2")), "left")
    removal = F.struct(
        without_lines(text, F.col("places")).alias("kept"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return joined.select("row", removal.alias("removal"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs).select("row.doc_id", "removal.n_lines", "removal.n_dropped", F.sha2("removal.kept", 256).alias("kept_sha256"))


_SQL = f"""
with lines as (
  select doc_id, i, line[i] as line,
    trim(translate(line[i], '{string.ascii_uppercase}', '{string.ascii_lowercase}'), ' \t\n\x0b\x0c\r') as key
  from (select doc_id, string_split(coalesce(text, ''), '\n') as line from documents), unnest(range(1, len(line) + 1)) as g(i)),
common as (
  select key, max(doc_id) as last from lines where length(key) >= {MIN_CHARS}
  group by key having count(distinct doc_id) >= {MIN_DOCS}),
judged as (select doc_id, i, line, coalesce(doc_id <> last, false) as gone from lines left join common using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, '\n' order by i) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

QUERIES = {"op13_line_dedup": op13_line_dedup}
ORACLES = {"op13_line_dedup": _SQL}
