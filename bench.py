"""Timings of the headline queries: one JSON line.

`model` is the way from raw text to the canonical tables; the checks and lists read what
it wrote, as a run does.
"""

from __future__ import annotations

import json
import os
import time

from ledgercheck.plans import derived, flow_catalog, match_catalog  # noqa: F401
from ledgercheck.plans.catalog import QUERIES
from ledgercheck.session import local_session

HEADLINE = [
    "parse_amount", "parse_date", "control_totals", "conservation", "partner_relevance",
    *[name for name in QUERIES if name.startswith("check_")],
    "netted_invoices", "cross_role_values", "discount_buckets", "top_findings", "category_totals",
    "rule_groups", "finding_sample", "record_comparison", "decision_overlay",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "ledgercheck-bench")
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.time()
        work()
        timings[name] = round(time.time() - start, 3)

    timed("model", lambda: derived.prepared(spark, folder))
    timed("findings", lambda: derived.all_findings(spark, folder))
    timed("match", lambda: match_catalog.planted(spark, folder))
    for name in HEADLINE:
        timed(name, lambda n=name: QUERIES[n](spark, folder)
              .write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "ledgercheck headline queries, total", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
