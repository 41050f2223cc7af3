"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from playbill.plans import catalog
from playbill.session import build_session

HEADLINES = (
    "feed_window", "hydrated_scan", "exact_duplicates", "exact_matches", "partial_matches", "venue_resolution", "spotlight_pool",
    "url_outcomes", "distinct_events_per_url", "scorecards", "source_memory", "ranked_search", "link_graph", "top_page_links",
    "page_text", "assigned_images", "duplicate_clusters", "weighted_venue_sample", "fingerprint_rows", "merged_store",
    "indexed_search", "partial_duplicates", "full_remediation",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog.entries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
