"""Times the registered queries: ``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` cores, one JSON line.

``BENCH_QUERIES`` names a subset, ``BENCH_RUNS`` timed runs (best counts). Results are evaluated in full
with the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from figtrace.session import build_session

# A full pass over all queries is long; these cover every sort of plan.
HEADLINE = (
    "search_points", "summarise", "get_source", "compare_evidence", "doc_canonical", "text_dedup", "repetition_scope",
    "restated_figures", "label_profile", "table_profile", "context_tag", "points_tagged", "tag_claims", "gold_by_year",
    "skip_disclosure", "audit_redact",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    names = list(QUERIES) if names == ["all"] else names
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["search_points"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "query_seconds_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
