"""A training corpus from ``documents``: five stages, each a table that the next one reads.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last keep the
columns of ``documents``; the last adds ``copy``, since a document may enter the mix repeatedly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.mixing import mix_sources
from tidemark.llm.simhash import keep_first
from tidemark.llm.suffix_dedup import remove_repeated_bytes
from tidemark.llm.toxicity import drop_toxic

PASSAGE_WORDS = 51  # a passage of over 50 words that stands elsewhere too goes, however short its words

def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, or long strings, that stand elsewhere too; all documents stay.

    A passage is judged by its words, since 51 of them may have anything from 101 bytes up; strings of
    400 bytes go as in ``op3_suffix_dedup``, also where they hold fewer words.
    Where a cut falls inside a character, what is left of that character goes as well. ``n_chars``
    follows the text; a null text stays null.
    """
    cleaned = remove_repeated_bytes(docs, as_text=True, words=PASSAGE_WORDS)
    text = F.when(F.col("row.text").isNotNull(), F.col("removal.kept"))
    out = cleaned.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the share of its source asks."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: The stages hold a trained model, fingerprints and byte strings, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
