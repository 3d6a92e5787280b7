"""Bench: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is fully computed with the ``noop`` sink (every row and column is
produced, nothing is collected to the driver).  One warm-up pass of the
flagship absorbs JVM/codegen start-up.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskscope.plans.catalog import QUERIES  # noqa: E402
from riskscope.session import get_spark  # noqa: E402

HEADLINE = (
    "score_pages",
    "url_features",
    "url_features_mutated",
    "page_extract",
    "content_features_documents",
    "tfidf_top_terms",
    "dedupe_reference",
    "balanced_sample",
    "domain_features",
    "resolve_captures",
    "holdout_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", app="riskscope-bench", shuffle_partitions=int(cpus) * 2)
    names = [n for n in HEADLINE if n in QUERIES]
    QUERIES["score_pages"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
