"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Every query is executed in full through the ``noop`` sink (all stages run, nothing
is collected to the driver). After one warm-up pass each query is timed
``BENCH_REPEAT`` times (default 3), each time with the readers' and bounds' caches
cleared, and the median is kept. The training-data queries, if they are there, are
timed once each and reported beside the total. Prints ONE JSON line.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "recon_full_keyed",
    "mismatch_rows",
    "mismatch_columns",
    "recon_hash",
    "except_all",
    "recon_run",
    "validate_table",
    "compare_database",
    "feed_counts",
    "interaction_counts",
    "w2_alert_by_slot",
    "w3_type_detail",
    "w6_kpi_summary",
    "schema_drift_3way",
    "profile_columns",
    "eda_quartiles",
    "dedup_rows",
    "dq_quarantine",
    "dq_trace",
    "doc_chunks",
    "doc_changes",
    "vector_topk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE

    from tidemark.plans.registry import QUERIES, load_all
    from tidemark.session import local_session

    load_all()
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * int(cpus)))))

    caches = [x for x in gc.get_objects() if isinstance(x, functools._lru_cache_wrapper) and getattr(x, "__module__", "").startswith("tidemark.")]

    def run(query) -> float:
        for c in caches:
            c.cache_clear()
        t0 = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    known = dict(QUERIES)
    try:
        from tidemark.llm.registry import QUERIES as llm
    except ModuleNotFoundError:
        llm = {}
    known |= llm
    run(known[names[0]])  # warm-up: JVM, parquet footers, codegen caches
    times = {}
    for n in names:
        times[n] = round(statistics.median(run(known[n]) for _ in range(max(1, repeat))), 3)
    more = {n: round(run(q), 3) for n, q in llm.items()} if not sys.argv[1:] else {}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "training_data_queries": more, "sf": sf}))


if __name__ == "__main__":
    main()
