"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
Every query runs to its end over its whole input; results are not kept.
"""

import json
import os
import time

from copperbook.plans import catalog
from copperbook.session import build_session

HEADLINE = [
    "e7_merge_continuations",
    "e8_tag_structure",
    "e9_data_items",
    "e11_item_hierarchy",
    "e12_item_types",
    "e14_program_header",
    "e15_file_control",
    "e16_statements",
    "e18_block_depth",
    "e20_sql_blocks",
    "e24_calls",
    "e28_detect_dialect",
    "e29_program_summary",
    "e30_class_summary",
    "e32_record_schemas",
    "e33_enum_members",
    "e34_service_groups",
    "e34_service_members",
    "e36_readiness",
    "e37_verb_counts",
    "e37_verb_profile",
    "e39_diff_estates",
    "r6_add_subtract_multiply",
    "r7_divide",
    "r9_evaluate",
    "r9_evaluate_ranges",
    "r15_perform_table",
    "r15_running_total",
    "r15_balance_resets",
    "r18_unstring",
    "r19_inspect",
    "r22_occurs",
    "r22_varying_records",
    "k1_keyed_read",
    "k3_keyed_rewrite",
    "k5_apply_changes",
    "k5_changes_by_range",
    "k6_browse_pages",
    "k7_organize_relative",
    "k11_queue_append",
    "k12_sql_merge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "copperbook-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # one read of each kind, so that the first query does not pay for the start
    queries["e14_program_header"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
