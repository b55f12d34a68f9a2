"""Wall time of the headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "archive_scan calendar_tiles list_page public_venues moderation_view series_occasions layered_verdicts reclassify_stats deduped_batch linked_rows "
    "merge_plan review_scores archive_clusters archive_summary visitor_view night_histogram poster_events fold_decisions checked_manual_events "
    "admitted_submissions ticketing_feed jsonld_venue_sites subscription_feed page_text"
).split()


def main() -> None:
    from marquee.plans.catalog import entries
    from marquee.plans.catalog.standin import Tables
    from marquee.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    tables, known = Tables(spark, sf_dir), entries()
    tables.listings().limit(1).collect()  # start the engine before timing
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name].run(tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
