"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from recordloom.plans import QUERIES
from recordloom.session import local_session

HEADLINE = [
    "snapshot_diff", "change_report", "upsert", "patch_fill", "check_references", "title_mismatch",
    "first_wins", "merge_labels", "invert_membership", "people_per_record", "text_per_unit", "full_titles",
    "upload_batches", "validate_fields", "heading_split", "coded_links", "html_nodes", "carry_forward",
    "marker_slice", "unicode_clean", "clock_24h", "date_line", "normalize_sessions", "company_url",
    "vector_search", "match_cascade", "json_array_source", "text_records_source", "incremental_results",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # JVM warm-up
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
