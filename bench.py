"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names instead of the default set
BENCH_RUNS     timed runs per query after one untimed (default 1); the median counts
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgermatch.plans import catalog  # noqa: E402
from ledgermatch.session import build_session  # noqa: E402

HEADLINE = [
    "reconcile_books", "match_exact_1_1_1", "match_many_invoices_to_bank", "match_installments", "match_bank_gl",
    "match_bank_gl_discrepancy", "similar_name_pairs", "evaluate_groups", "trial_balance", "vendor_baselines",
    "firm_dashboard", "finding_citation", "pending_entities", "review_queue", "scan_csv_entities",
    "scan_ofx_transactions", "scan_ocr_layout", "dedupe_documents_by_hash", "overlapping_regions",
    "stream_idempotent_requests",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for i, name in enumerate(names):
        times = []
        for attempt in range(runs + (1 if runs > 1 else 0)):
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times[1:] if runs > 1 else times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
