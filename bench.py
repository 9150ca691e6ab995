"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from convoframe.plans import QUERIES  # noqa: E402
from convoframe.session import build_session, cleanup  # noqa: E402

HEADLINE = [
    "titled_listing",
    "s1_read_chats",
    "s3_write_chats",
    "s4_upsert_chats",
    "s5_delete_chats",
    "p2_load_chat",
    "p3_fold_messages",
    "w1_pair_turns",
    "w2_build_context",
    "w3_build_prompts",
    "w4_effective_settings",
    "w5_settings_at",
    "w7_recent_deployments",
    "w8_prioritised_fill",
    "j2_manageable",
    "j3_time_to_state",
    "c1_clean_errors",
    "c3_extract_json",
    "c5_status_report",
    "c11_title_chats",
    "a3_error_summary",
    "u1_batch_generate",
    "t1_stream_autosave",
    "x5_usage_stats",
    "r1_search_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in only or HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    cleanup(spark)
    spark.stop()


if __name__ == "__main__":
    main()
