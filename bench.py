"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from rosterline.plans import catalog
from rosterline.session import local_session

QUERIES = [
    "final_roster", "final_roster_gap0", "records_html", "records_gap0", "candidates", "merged_blocks", "table_candidates", "html_vertical",
    "specialty_union", "organizations", "transaction_type", "word_dates", "phone_candidates_documents", "html_to_text",
    "mail_decode", "validate_fields", "field_success", "extractor_analysis", "priority_ranking", "message_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, partitions=int(cpus))
    mails = spark.read.parquet(os.path.join(sf_dir, "customer.parquet")).count()
    # start-up of the session and its code cache is not part of any query
    catalog.QUERIES["merged_blocks"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, planning = {}, {}
    for name in QUERIES:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        # planned once more on its own, in a warm session
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
        planning[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, planning included, after one warm-up query", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "planning": planning, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "mails": mails,
        "final_roster_mails_per_sec": round(mails / times["final_roster"], 1),
    }))


if __name__ == "__main__":
    main()
