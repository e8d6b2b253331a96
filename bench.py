"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lorekeep import plans  # noqa: E402
from lorekeep.session import local_session  # noqa: E402

HEADLINE = (
    "t3_phrase_search",  # ranked search by scan
    "t1_postings",  # inverted index build
    "j10_candidates",  # interval and similarity join
    "m1_entry_upsert",  # snapshot upsert
    "a8_spend_by_period",  # spend per week and month
    "m4_summary_decisions",  # body hashes and decisions
    "m19_hash_upgrade",  # the one operation with a published time
    "c15_conversation_text",  # conversation rendering
    "j9_effective_status",  # status from links
    "w6_budget_gate",  # distributed running sum
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    fns = plans.queries()
    # Start the Python workers and the code caches before the clock runs.
    fns["c1_match_norm"](spark, sf_dir).limit(1).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        fns[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
