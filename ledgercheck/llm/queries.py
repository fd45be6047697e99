"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgercheck.llm import (archive, conversations, divergence, jaccard, langid, mixing,
                             neighbours, pii, repeats, toxicity, unigram, urls)
from ledgercheck.llm.common import learned, table
from ledgercheck.llm.decontaminate import decontaminate
from ledgercheck.session import tune


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(tune(spark), sf_dir, "embeddings")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs, pii.learn(docs)).select(
        "row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, docs.where(learned()), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "row.doc_id", (~learned("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "nearest_cosine",
        "nearest_toxic", "voters")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    model = langid.learn(docs.where(learned()).select("text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id", (~learned("row.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


# fixed values: the rules of the query
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"),
             ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(tune(spark), sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    return mixing.mix(docs, columns=["doc_id", "source"]).select(
        "row.doc_id", "row.source", "share", "period", "block", "slot", "position", "in_mix")


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(tune(spark), sf_dir, "documents"), VOCABULARY)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).drop("kept")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    return jaccard.similarity_join(docs).select("doc_id", "n_shingles", "component_id")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(tune(spark), sf_dir, "conversations"))
    return conversations.digests(rows, conversations.audits(rows))


def op12_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(tune(spark), sf_dir, "pages").select("page_id", "url", "html")
    return archive.read(archive.store(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(tune(spark), sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_neighbours, op3_pii, op4_toxicity, op5_language, op6_urls,
    op7_mixing, op8_tokens, op9_repeats, op10_jaccard, op11_conversations, op12_archive,
    op13_divergence)}
