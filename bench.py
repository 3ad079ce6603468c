"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "a1_buckets_1h", "a2_top_rules", "a9_rate", "b1_high_rate", "b2_port_scan", "b4_brute_force", "b6_ewma", "b7_session",
    "c1_scoring", "j1_candidates", "m1_occurrences", "m2_chain", "m3_pcre", "m17_match", "p14_http_requests", "p25_sanitize",
    "r10_rows", "t1_handshake", "t2_reassembly", "t8_alert_dedupe", "x1_sliding_distinct",
]


def main() -> None:
    from packetloom.plans import catalog
    from packetloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # JVM, Python workers and file footers warm before the clock starts
    for warm in ("a2_top_rules", "x2_silence_seconds"):
        catalog.QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spent = {}
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - began, 3)
    total = round(sum(spent.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": spent, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
