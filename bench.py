"""Time the headline queries: every row is computed, nothing is collected.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores;
names on the command line choose queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidepost.catalog import QUERIES
from tidepost.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "top_words clean_text latin_filter script_filter quality_filter quality_extended "
    "keyword_filter search_posts_spanned prefix_dedup url_dedup unseen_posts hashtag_top context_words "
    "auto_expand lexicon_sentiment model_sentiment frequency_topics page_links page_records "
    "page_markers date_chunks adaptive_chunks planned_quota match_posts work_yield dynamic_quota "
    "chunk_cap rate_status rate_by_type job_latest batch_files stall_runs fallback_fill_uncapped "
    "mixed_union standard_job_spanned expand_job_spanned lda_topics stream_dedup stream_rate "
    "stream_intake_uncapped lexicon_table expand_job_quota smart_job"
).split()


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run(spark, "preview")  # starts the JVM's code paths before the clock counts
    times = {name: run(spark, name) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
