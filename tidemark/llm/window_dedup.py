"""Substring dedup by super-k-mers: words in a window that already stood earlier are removed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import grams as G
from tidemark.llm.common import table
from tidemark.llm.passages import Unit, covered, doc_keys, marked_runs, word_runs

WINDOW = 20  # words


def _contents(text: bytes, runs: Sequence[tuple[int, int]], window: int) -> list[bytes]:
    """Packed strings: the words of each run, joined by a space."""
    _, starts, ends = G.word_hashes(text)
    return [b" ".join(text[starts[s] : ends[s + c + window - 2]].split()) for s, c in runs]


def _windows(content: bytes, window: int) -> list[bytes]:
    words = content.split(b" ")
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def later_windows(rows: Sequence[tuple[bytes, int, int]], window: int) -> list[np.ndarray]:
    """Sorts the windows of packed strings ``(content, doc, start)``; marks those with an equal one before them."""
    sorted_windows, hits = [], []
    for i, (content, doc, start) in enumerate(rows):
        found = _windows(content, window)
        hits.append(np.zeros(len(found), bool))
        sorted_windows += [(w, doc, start + k, i, k) for k, w in enumerate(found)]
    sorted_windows.sort()
    now = None
    for w, doc, place, i, k in sorted_windows:
        if now is None or w != now[0]:
            now = (w, doc, place)
        elif (doc, place) != now[1:]:
            hits[i][k] = True
    return hits


def word_unit(window: int) -> Unit:
    return Unit(window, word_runs, _contents, _windows, later_windows, False)


def _remover(window: int):
    @F.pandas_udf("kept string, n_words long, n_removed long")
    def remove(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for text, marks in zip(texts, places):
            words = text.encode("utf-8", "surrogatepass").split()
            n = len(words)
            spans = covered(marks, window, n)
            for a, b in spans[::-1].tolist():
                del words[a:b]
            out.append((b" ".join(words).decode("utf-8", "surrogatepass"), n, n - len(words)))
        return pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])

    return remove


def remove_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``removal``: the words kept, joined by a space, and the numbers of words and of removed ones.

    A word goes if a window of ``window`` words that covers it has the same words as one that starts
    earlier: in a document with a smaller id (null is largest), or before it in the same document.
    All is judged on the input. Null text has no words; texts shorter than a window stay whole. Rows
    that share an id and a place are not earlier than each other, so repeated rows both keep what
    none has before them. All given columns stay, also ones named like the results.
    """
    marks = marked_runs(docs, word_unit(window), "windows").withColumnRenamed("places", "__places")
    marks = marks.withColumnsRenamed({"doc": "__doc", "th": "__th"})
    keyed = doc_keys(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", "row.doc_id", "row.text"))
    joined = keyed.join(marks, (F.col("doc") == F.col("__doc")) & (F.col("th") == F.col("__th")), "left")
    return joined.select("row", _remover(window)(F.coalesce("text", F.lit("")), F.col("__places")).alias("removal"))


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_words(docs).select(
        "row.doc_id", "removal.n_words", "removal.n_removed", F.sha2("removal.kept", 256).alias("kept_sha256")
    )


_SQL = f"""
with tokens as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as win from tokens, unnest(range(1, len(w) - {WINDOW - 2})) as g(i)
  where len(w) >= {WINDOW}),
later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as n from windows) where n > 1),
gone as (select distinct doc_id, i + k as i from later, unnest(range(0, {WINDOW})) as g(k)),
placed as (select doc_id, i, w[i] as word from tokens, unnest(range(1, len(w) + 1)) as g(i)),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by i) as words from placed p
  where not exists (select 1 from gone g where g.doc_id = p.doc_id and g.i = p.i) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(words, '')) as kept_sha256
from tokens left join kept using (doc_id)
"""

QUERIES = {"op9_window_dedup": op9_window_dedup}
ORACLES = {"op9_window_dedup": _SQL}
