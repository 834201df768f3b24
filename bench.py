"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans.catalogue import QUERIES  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = [
    "profile_lineitem", "profile_snapshot", "profile_windowed", "category_frequency", "orphans_single",
    "orphans_composite", "orphan_rows", "verify_contract", "anomaly_detect", "backtest_summary", "n_plus_one",
    "shape_stats", "endpoint_repetition", "in_session", "findings_diff", "finding_ids", "score_counts",
    "compare_configurations", "cliffs_delta", "wilcoxon", "stratified_sample", "q08_order_with_items",
    "q14_average_rating_per_category", "q18_top_products", "q26_authors_per_tag", "q30_product_detail", "stream_dedupe",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["q13_price_range_per_category"](spark, directory).collect()  # start the JVM's workers
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
