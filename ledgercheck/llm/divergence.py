"""How the sources of a language differ in their words: translate-table tokenizer, sparse counts.

A text's bytes go through one `bytes.translate`: letters A-Z become lower case, every other ASCII
byte that is no letter becomes a blank, bytes beyond ASCII stay.  `bytes.split` gives the terms
and a Counter per document their frequencies and, by its keys, the documents they occur in.  A
task adds documents up per language and source before it sends them on, in at most HELD entries.

A language keeps the V terms that occur in at least `min_docs` of its documents.  With N the count
of kept terms of a group, p = 1 + floor(10^9 (count + 5) / (N + 5 V)).  All of it is whole numbers
in 64 bits: the division is done in two steps, exact up to 2.8 10^14 occurrences.

Only occurring (language, source, term) triples are stored.  The distance of two sources is summed
over buckets of about BUCKET_TERMS terms: a bucket's counts become a matrix of terms by sources,
whose rows of distances are added up by Spark.  A language with a third of all rows has as many
buckets as its terms need; a bucket holds BUCKET_TERMS times the sources of the language.

Defined results: null text, lang and source are empty; groups without terms have count 0 for all;
a language without kept terms has value 0 for each pair.  Ties rank by the UTF-8 bytes of the
item.  Repeated rows are documents of their own.  A very long text is one row, taken whole: its
Counter holds its different terms.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgercheck.llm.common import settled, slices, small_batches, to_batch

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
SCALE = (31_250, 32_000)   # whose product is 10^9
HELD = 1 << 18             # entries of counters a task holds
SENT = 1 << 14             # entries sent in one batch
BUCKET_TERMS = 512
TILE_SOURCES = 64          # sources whose distances to all others one group returns

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
                for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs, added up per task; to be summed."""
    schema = T.StructType.fromDDL("lang string, source string, term string, n long, docs long")
    types = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_with) in found.items():
                items = list(n.items())
                for lo in range(0, len(items), SENT):
                    part = items[lo:lo + SENT]
                    size = len(part)
                    yield to_batch({
                        "lang": pa.repeat(lang, size), "source": pa.repeat(source, size),
                        "term": pa.array([t for t, _ in part], pa.binary()).cast(pa.string()),
                        "n": [c for _, c in part], "docs": [docs_with[t] for t, _ in part],
                    }, types)
            found.clear()

        for rows in slices(batches, "text"):
            columns = [rows.column(c).to_pylist() for c in ("lang", "source")]
            for lang, source, text in zip(*columns, rows.column("text")):
                own = Counter(terms(text.as_py()))
                n, docs_with = found.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(own)
                docs_with.update(own.keys())
                held += len(n)
            if held >= HELD:
                yield from flush()
                held = 0
        yield from flush()

    small_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(work, schema)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term, n) and their occurrences (lang, source, term, n)."""
    triples = settled(counted(docs).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "triples")
    kept = settled(triples.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs),
        "kept-terms").drop("docs")
    sparse = settled(triples.join(kept.select("lang", "term"), ["lang", "term"]).select(
        "lang", "source", "term", "n"), "kept-triples")
    return kept, sparse


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kinds)) in whole numbers."""
    a, b = (F.lit(x).cast("long") for x in SCALE)
    bottom = total + kinds * SMOOTHING
    top = (n + SMOOTHING) * a
    return F.call_function("div", top, bottom) * b + F.call_function(
        "div", F.pmod(top, bottom) * b, bottom) + 1


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept, sparse = kept_counts(docs, min_docs)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("lang_total"))
    groups = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    groups = settled(
        groups.join(sparse.groupBy("lang", "source").agg(F.sum("n").alias("total")),
                    ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                for c in ("total", "kinds", "lang_total")]), "groups")

    found = sparse.join(groups, ["lang", "source"]).join(
        kept.withColumnRenamed("n", "lang_n"), ["lang", "term"])
    p = share(F.col("n"), F.col("total"), F.col("kinds"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    over = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                        (p - q).alias("value")).where(F.col("value") > 0)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)

    pairs = distances(sparse, groups).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value",
        F.row_number().over(by).alias("rank"))
    return pairs.unionByName(top)


def distances(sparse: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value."""
    buckets = F.greatest(F.lit(1), F.ceil(F.col("kinds") / BUCKET_TERMS)).cast("int")
    size = groups.groupBy("lang").agg(
        F.max(buckets).alias("buckets"),
        F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("tiles"))
    each_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    spread = groups.join(size, "lang").withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).withColumn(
        "tile", each_tile).select(
        "lang", "bucket", "tile", "source", "total", "kinds",
        (F.pmod(F.xxhash64("source"), F.col("tiles")) == F.col("tile")).alias("own"))
    dealt = sparse.join(size, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"),
        each_tile.alias("tile"), "source", "term", "n")
    a, b = SCALE

    def rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("source", kind="stable").reset_index(drop=True)
        sources, own = right["source"].to_numpy(object), right["own"].to_numpy(bool)
        bottom = (right["total"] + SMOOTHING * right["kinds"]).to_numpy(np.int64)
        place = {s: i for i, s in enumerate(sources)}
        numbers, _ = pd.factorize(left["term"])
        counts = np.zeros((int(numbers.max()) + 1 if len(numbers) else 0, len(sources)), np.int64)
        counts[numbers, [place[s] for s in left["source"]]] = left["n"].to_numpy(np.int64)
        if len(counts):
            top = (counts + SMOOTHING) * a
            counts = top // bottom * b + top % bottom * b // bottom + 1
        parts = [
            (np.full(len(sources), i), np.arange(len(sources)),
             np.abs(counts - counts[:, i:i + 1]).sum(axis=0)) for i in np.flatnonzero(own)]
        one, other, value = (np.concatenate(x) for x in zip(*parts or [[np.zeros(0, int)] * 3]))
        lang = np.full(len(sources), right["lang"].iloc[0], object)
        apart = one != other
        return pd.DataFrame({"lang": lang[one], "source": sources[one], "item": sources[other],
                             "value": value})[apart]

    by = ("lang", "bucket", "tile")
    parts = dealt.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(
        rows, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
