"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query builds its own pipeline from the parquet tables (no reuse between queries), and every row and column
of its result goes to a ``noop`` sink. Each is run once on the smallest tables before its clock starts, so JIT
and code generation are not counted.
"""
from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from codemap.plans import catalog  # noqa: E402
from codemap.session import get_session  # noqa: E402

HEADLINE = [
    "ingestion_report",    # ingest -> imports -> resolve -> PageRank -> central files
    "repo_report",         # end to end: context, retrieval, evidence, replies, report
    "select_top_k",        # retrieval composite
    "py_imports",          # distributed regex extraction
    "evidence_routes",     # evidence extraction over every candidate
    "bm25_rank",           # lexical scoring of every candidate
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warm_up = os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir)
    times = {}
    for name in HEADLINE:
        if warm_up:
            catalog.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
