"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
cores (default 8).  Every query is computed in full into the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.compare import session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "regex_findings_raw_docs",
    "regex_findings",
    "call_findings",
    "static_findings",
    "findings_by_group",
    "new_since_baseline",
    "suspicious_lines_targeted",
    "evidence_blocks_full",
    "discovery_requests",
    "review_requests",
    "chunk_requests",
    "redacted_raw_documents",
    "discovered_findings",
    "review_records",
    "sarif_results",
    "markdown_rows",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    run(spark, "regex_findings_raw_docs", sf_dir)  # starts the Python workers
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
