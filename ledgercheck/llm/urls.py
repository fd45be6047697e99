"""URL verdicts: rules by host and path, and a logistic regression for the rest.

DataFrame functions only: n-grams and hashes are SQL expressions, the regression is Spark ML's.

Hosts and paths are read from the URL text; the longest rule that fits decides.  Where none fits,
the regression on hashed character n-grams of host and path does.  It is fitted on a small
labelled table (host, path, verdict): at most ROWS_PER_VERDICT different URLs per verdict, the
first by a hash of host and path, in one partition so that sums have one order.

Defined results: a null URL, or one without `://`, has empty host and path, no rule, and the
regression's verdict for empty text.  With one verdict among the labels every other URL gets it;
with no label at all, `allow`.  Repeated pages are judged each by itself; other columns are not
read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_VERDICT = 2000
DIMENSIONS = 1 << 14
LENGTHS = (2, 3, 4)
MAX_RULES = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL text; empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"\A[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null.  Rules: (verdict, host, path)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by where they are from; ends are marked."""
    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))),
                       ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        for n in LENGTHS:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
            parts.append(F.transform(starts, _gram(mark, text, n)))
    return F.concat(*parts)


def _gram(mark: str, text: Column, n: int):
    return lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n)))


def fit(labelled: DataFrame, rows_per_verdict: int = ROWS_PER_VERDICT):
    """The regression, from (host, path, verdict); the one verdict there is; or `allow`."""
    rows = labelled.select("host", "path", "verdict").distinct()
    first = [rows.where(F.col("verdict") == v).orderBy(F.xxhash64("host", "path"), "host", "path")
             .limit(rows_per_verdict) for v in ("allow", "block")]
    sample = first[0].union(first[1]).coalesce(1).select(
        grams(F.col("host"), F.col("path")).alias("grams"),
        (F.col("verdict") == "block").cast("double").alias("label"))
    sample = _hashing().transform(sample)
    seen = {r[0] for r in sample.select("label").distinct().collect()}
    if len(seen) < 2:
        return "block" if seen == {1.0} else "allow"
    return LogisticRegression(maxIter=50, regParam=1e-3, featuresCol="features").fit(sample)


def _hashing() -> HashingTF:
    return HashingTF(numFeatures=DIMENSIONS, inputCol="grams", outputCol="features")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]],
          labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's block_score of every page.

    Without a labelled table the URLs that a rule decides are the labels."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    read = read.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = read.where(F.col("found").isNotNull()).select("host", "path", "found.verdict")
    model = fit(labelled)
    if isinstance(model, str):
        scored = read.withColumn("block_score", F.lit(1.0 if model == "block" else 0.0))
    else:
        scored = model.transform(_hashing().transform(
            read.withColumn("grams", grams(F.col("host"), F.col("path"))))) \
            .withColumn("block_score", vector_to_array("probability")[1])
    learnt = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce(F.col("found.verdict"), learnt).alias("verdict"),
                         "block_score")
