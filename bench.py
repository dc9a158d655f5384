"""Times the headline queries once warm and prints one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from capledger.queries import QUERIES  # noqa: E402
from capledger.session import build_session  # noqa: E402

HEADLINE = [
    "compliance_projection", "entity_verdict", "deviation_stats", "weighted_sum", "effective_rate", "cap_join",
    "membership_flag", "reconcile_counts", "latest_per_key", "silver_clean", "bronze_load", "layout_lines",
    "duplicate_audit", "fact_conflicts", "profile", "median_by_group", "section_fill", "header_inherit",
    "table_rows", "version_history", "chunk_documents", "cosine_topk", "parse_answers", "explode_records",
    "validate_ok", "insert_new",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for seconds in (cold, warm):
        for name in HEADLINE:
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": pathlib.Path(folder).name, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
