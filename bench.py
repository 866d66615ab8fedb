"""Time the queries on one machine and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores, ``BENCH_QUERIES`` (optional) a
comma-separated choice. Each query runs once to warm up and once for the clock; results go to the noop
sink, so every row and column is computed and nothing is fetched.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docloom import plans  # noqa: E402
from docloom.session import get_spark  # noqa: E402

HEADLINE = [
    "scan_project", "fk_join", "upsert", "delete_first", "dq_duplicates", "dq_orphans", "union_dedupe",
    "search_sections", "search_hits", "search_hits_ci", "search_docs", "search_context", "search_term_table", "asof_heading", "asof_events",
    "tag_counts", "attr_counts", "tag_depth", "text_nodes", "link_facts", "rule_hits", "rule_hits_default", "rule_summary",
    "rule_pivot", "top_files", "js_functions", "line_numbers", "wsdl_ports", "wsdl_operations", "wsdl_fields",
    "wsdl_catalogue", "group_records", "kind_rollup", "render_group", "log_levels", "log_expectations", "latest_n",
    "import_paths", "incremental_pending", "a1_columns", "tiered_rescale_counts", "sheet_scan", "find_row",
    "section_slice", "grid_insert_range", "grid_insert_rows", "display_width",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = get_spark("docloom-bench", cores=cores)
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(run(spark, name, folder), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, second run, noop sink",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
