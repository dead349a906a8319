"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewire.catalog import QUERIES  # noqa: E402
from tidewire.session import get_session  # noqa: E402

HEADLINE = (
    "flt02_clean_articles", "flt10_near", "flt15_subscription_match",
    "scl12_keywords", "scl22_content_policy", "scl28_guess_language",
    "jn01_resolve_countries", "jn03_languages", "jn05_entity_combinations", "jn08_query_history",
    "jn09_contradictions",
    "dd01_first_per_url", "dd02_merge_feeds", "dd03_greedy_near_duplicates", "dd04_similar_texts",
    "dd07_cluster_flashpoints",
    "ag01_top_topics", "ag02_topic_trends", "ag05_geo_patterns", "ag07_correlations", "ag20_audit_by_agent",
    "ag21_session_costs", "ag28_timelinelang", "ag30_business_rules", "ag35_verification",
    "wn01_trend_direction", "wn03_window_counts", "wn03_window_decisions", "wn05_page",
    "vec02_top_per_query", "vec03_threshold_search", "src07_page_text", "str05_routed_updates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    spark = get_session(
        "tidewire-bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "20g",
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("ag01_top_topics")  # start the JVM, the scan and the code generator
    times = {}
    for name in names:
        times[name] = round(run(name), 3)
        if "-v" in sys.argv:
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
