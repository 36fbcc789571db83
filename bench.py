"""Time the headline queries; one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ALL=1 for every
registered query, BENCH_ONLY=a,b for a choice.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from salesloom.plans import load_all  # noqa: E402
from salesloom.session import build_session  # noqa: E402

HEADLINE = (
    "scan_manifest_csv latest_snapshot dedup_keep_last paged_scan doc_upsert chunk_upsert "
    "account_nest opportunity_enrich derive_account_link star_join drill_across resolve_name interval_overlap "
    "lens_solution lens_salesperson lens_industry "
    "m_total_plan m_win_rate m_at_risk m_achievement m_ytd p_accum_actual p_possibility_delta group_total "
    "actual_vs_target_month top_sellers top_accounts top_open_deals winrate_accounts possibility_drops pipeline_by_solution "
    "f_revenue f_project_cost f_profit f_man_cost_idle f_best_month "
    "strip_html slugify render_account_doc refresh_corpus chunk_document sliding_window embed_batch "
    "knn_cosine knn_approx keyword_score hybrid_search build_context "
    "audit_plausible tag_state_over_time audit_query_log stream_hourly_counts stream_latest"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load_all()
    names = HEADLINE
    if os.environ.get("BENCH_ALL") == "1":
        names = list(queries)
    if os.environ.get("BENCH_ONLY"):
        names = os.environ["BENCH_ONLY"].split(",")
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    for name in ("m_total_plan", "star_join", "strip_html"):  # start the JVM's and Python's workers
        run(name)
    times = {}
    for name in names:
        times[name] = run(name)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
