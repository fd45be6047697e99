"""The corpus pipeline: language ID, near duplicates, decontamination, personal data, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a table that
is written and read again as the next one's docs.  All but the last return the columns of
documents; the last adds the place in the mix.

Defined results: null and empty texts have no letter, so the first stage drops them; an empty
table passes all stages; further columns of documents are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgercheck.llm import decontaminate, jaccard, langid, mixing, pii
from ledgercheck.llm.common import learned, settled, table, unpacked
from ledgercheck.session import tune

MIN_LANGUAGE_SCORE = 0.4  # below, the codes leave the language open


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; drops those without a letter and those whose
    best codeword has a share below MIN_LANGUAGE_SCORE."""
    model = langid.learn(docs.where(learned()).select("text", "lang"))
    told = langid.identify(docs, model).where(
        (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return unpacked(told, docs.columns, text=F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; drops documents that are mostly benchmark."""
    return decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs, pii.learn(docs.select("text")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their place in the mix of sources."""
    placed = mixing.mix(docs)
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns],
                         *[F.col(c) for c in ("share", "slot", "position", "in_mix")
                           if c not in docs.columns])


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("benchmark_passages", benchmark_passages), ("personal_data", personal_data),
          ("mixed", mixed)]

# Language ID and the field of the personal-data stage can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
