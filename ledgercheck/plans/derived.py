"""The derived client of a data folder, built once per session and kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgercheck.checks.contract import Model
from ledgercheck.operators import findings
from ledgercheck.plans.bridge import raw_exports
from ledgercheck.plans.run import Prepared, Settler, check_all, prepare
from ledgercheck.session import tune_tables, work_folder
from ledgercheck.sources.files import write_export

CONTEXT = findings.RunContext("derived-run", "2026-01-01T00:00:00Z")
_BUILT: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, build):
    """Build a stage for the first query that needs it; later ones read its tables."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def settle_for(spark: SparkSession, name: str) -> Settler:
    return Settler(spark, work_folder(spark, name))


def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    """Raw exports, typed and mapped to the canonical tables; each when a query first needs it."""
    tune_tables(spark)
    return _once(spark, sf_dir, "model", lambda: prepare(
        raw_exports(spark, sf_dir), settle_for(spark, "model"), lazy=True))


def model(spark: SparkSession, sf_dir: str) -> Model:
    return prepared(spark, sf_dir).model


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all checks; a check that was not executed ends the query."""
    def build() -> DataFrame:
        settle, p = settle_for(spark, "findings"), prepared(spark, sf_dir)
        p.staged.all()
        m = p.model
        m.tables.all()
        found, told = check_all(m, CONTEXT, settle)
        told.refuse_gaps()
        found = settle(found, "findings")
        settle.drop("hits")
        return found

    return _once(spark, sf_dir, "findings", build)


def export_folder(spark: SparkSession, sf_dir: str) -> str:
    """The raw exports as files: three encodings, both delimiters."""
    def build() -> str:
        folder = work_folder(spark, "exports")
        for name, df in raw_exports(tune_tables(spark), sf_dir).items():
            rows = df.drop("_row_no")
            if name == "LFB1":
                # Latin-1 bytes that are no valid UTF-8
                rows = rows.withColumn("AKONT", F.lit("Kreditoren für Anlagen"))
            write_export(
                rows, folder, f"{name}_export.txt", sep=";" if name in ("T001", "LFA1") else "\t",
                encoding={"LFB1": "ISO-8859-1", "KNBK": "UTF-16"}.get(name, "UTF-8"))
        return folder

    return _once(spark, sf_dir, "exports", build)


def flawed_exports(spark: SparkSession, sf_dir: str) -> str:
    """One export per nation with its customers by segment; two nations share a table name, and
    three of five headers are wrong: a column twice, a blank one, no delimiter."""
    def build() -> str:
        folder = work_folder(spark, "flawed")
        number = F.col("c_nationkey")
        name = F.concat(F.lit("T"), F.expr("c_nationkey DIV 2"), F.lit("_"), number, F.lit(".txt"))
        kind = F.expr("c_nationkey % 5")
        counts = tune_tables(spark).read.parquet(f"{sf_dir}/customer.parquet").groupBy(
            "c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
        rows = counts.select(name.alias("name"), F.lit(1).alias("place"), F.concat_ws(
            "\t", "c_mktsegment", "n", number).alias("value"))
        header = F.when(kind == 1, "SEG\tN\tSEG").when(kind == 2, "SEG\t\tN").when(
            kind == 3, "SEG").otherwise("SEG\tN\tLAND")
        headers = counts.select("c_nationkey").distinct().select(
            name.alias("name"), F.lit(0).alias("place"), header.alias("value"))
        rows.union(headers).repartition("name").sortWithinPartitions("name", "place", "value") \
            .select("name", "value").write.partitionBy("name").text(folder)
        return folder

    return _once(spark, sf_dir, "flawed", build)
