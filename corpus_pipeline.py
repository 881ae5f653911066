"""A training corpus from raw documents: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a DataFrame; all but the last
return the columns of ``documents``. The last returns them with ``domain``, ``n_tokens`` and ``epoch``, a row for each time a
document is drawn. Near-duplicates are word 5-gram sets of similarity 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm import contamination, language, lines, mixing, ngram_join
from placewright.llm.common import settled, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language."""
    return language.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in three or more documents from all but the last of them; lengths follow the text."""
    out = lines.dedup(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, within its edit budget."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws half of all tokens by the target weights."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix_sources),
]
#: No stage but line dedup can be stated in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


@settled
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage)(spark, docs, sf_dir)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, cleaned(spark, sf_dir), sf_dir)
