"""Wall-clock seconds of the headline queries; prints one JSON line.

The session and the tables that several queries share are warmed up first, as a step of its own; every query runs
twice and its second time counts. ``rows`` has the result's rows, so that two scale factors can be compared.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidekb import catalog  # noqa: E402
from tidekb.catalog import dedup_queries  # noqa: E402
from tidekb.operators import dedup  # noqa: E402
from tidekb.operators.neighbours import vector_blocks  # noqa: E402
from tidekb.session import local_session  # noqa: E402

HEADLINE = [
    "d02_similar_rows", "d03_greedy_groups", "e13_full_enrichment", "f01_vector_topk", "f02_probe_search", "f06_hybrid_search",
    "f08_diversity_rerank", "f12_naive_search", "f10_full_text", "g09_all_detectors", "g14_prior_report", "e10_document_frequency",
    "b03_clean_pages", "b05_extract_qa", "b09_backfill", "b19_similar_candidates", "d04_merge_groups", "j10_composites",
    "j12_grounding", "l03_by_client", "v13_slices", "a12_upsert", "s01_hit_counts", "s04_weekly_deviation",
]
#: Queries whose first run writes the stored tables that others read.
SHARED = ["f06_hybrid_search", "d04_merge_groups"]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"))
    start = time.perf_counter()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    only = sys.argv[1:]
    names = [n for n in HEADLINE if not only or n in only]
    for name in SHARED:
        if name in names:
            timed(spark, name, sf_dir)
    prepared = round(time.perf_counter() - start, 3)
    first, times, rows = {}, {}, {}
    for name in names:
        first[name], times[name] = timed(spark, name, sf_dir), timed(spark, name, sf_dir)
        rows[name] = catalog.QUERIES[name](spark, sf_dir).count()
        print(name, first[name], times[name], rows[name], file=sys.stderr, flush=True)
    extra = {}
    if "d02_similar_rows" in names:  # block pairs that the cosine join compares, of all
        _, vec = dedup.document_vectors(dedup_queries.docs(spark, sf_dir), "seq", "source_collection", "text")
        extra["block_pairs"] = dict(zip(("compared", "all"), vector_blocks(vec, dedup.THRESHOLD).compared()))
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(out | {"first_run": first, "prepare": prepared, "rows": rows} | extra))


if __name__ == "__main__":
    main()
