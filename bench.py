"""Times the headline queries after one warm-up pass on the smallest tables; prints one JSON line.

Settings: BENCH_SF_DIR (table folder), BENCH_CPUS (local threads), BENCH_QUERIES
(names, comma separated; ``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioweave import build_session  # noqa: E402
from folioweave.plans import QUERIES, load_all  # noqa: E402

HEADLINE = [
    "rank_nav_targets", "extract_nav_links", "select_elements", "extract_chapters", "extract_content", "merge_hits",
    "rank_hits_tiered", "precise_match", "alternative_sources", "dedupe_first", "paginate_hits", "build_toc", "next_chapter",
    "next_page_chain", "stitch_pages", "apply_replace_rules", "effective_rules", "finish_content", "resegment",
    "latest_state", "search_history", "prefetch_window", "source_health", "rate_limit_audit", "new_item_counts",
    "catalog_diff", "rule_report", "stream_extract", "stream_merge_hits", "page_chains",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        f"local[{cpus}]", "folioweave-bench",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm_up = Path(folder).parent / "sf0.001"
    if warm_up.exists():  # compile code and start workers outside the clock
        for name in names:
            run(spark, name, str(warm_up))
    timings = {name: round(run(spark, name, folder), 3) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "warm_up": warm_up.exists(),
        "queries": timings, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
