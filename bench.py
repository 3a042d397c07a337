"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is built and run to completion into the ``noop`` sink (every row
computed, nothing collected) twice in one session: the first (cold) run pays
for JIT, code generation and plan construction on first use, the second is
the steady state a long job sees. ``value`` sums the second runs; the cold
times are printed too. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text",
    "tokenize_cascade",
    "text_analysis",
    "token_vault",
    "pii_census",
    "roundtrip",
    "roundtrip_dense",
    "detokenize_json",
    "tokenize_spans",
    "resolve_overlaps",
    "parse_answer",
    "flatten_sections",
    "assign_ids",
    "page_with_total",
    "list_view",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from pallium.plans import all_queries
    from pallium.session import local_session

    event_log = os.environ.get("BENCH_EVENT_LOG")  # opt-in: a scratch folder for stage times
    conf = (
        {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log, "spark.eventLog.compress": "false"}
        if event_log else None
    )
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="pallium-bench",
                          conf=conf)
    queries = all_queries()
    # Warm-up: JVM, parquet readers and the regex classes, on a tiny input.
    warmup_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warmup_dir):
        queries["tokenize_cascade"](spark, warmup_dir).write.format("noop").mode("overwrite").save()

    def run(name: str) -> float:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 3)

    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            cold[name] = run(name)
            warm[name] = run(name)
        except Exception as exc:  # keep going; the JSON line must still be printed
            errors[name] = str(exc)[:300]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_warm_total_sec", "value": round(sum(warm.values()), 3), "unit": "sec",
           "queries": warm, "cold_total_sec": round(sum(cold.values()), 3), "cold": cold,
           "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
