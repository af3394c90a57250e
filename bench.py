"""Times the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the input, BENCH_CPUS (default 8) the cores. The value is
the sum over the archive queries; those on training text, if they are there, are beside it.
"""

from __future__ import annotations

import json
import os
import time

from foliary import catalog, session

HEADLINES = [
    "w1_gap_clusters", "e2_status", "w2_prev_next", "d1j_lookup", "d2j_manifest_diff", "d6j_duplicates", "d7j_rename_vote", "d10j_orphans", "w5_first_seen", "w6_read_budget",
    "f13_tokens", "f41_source_tier", "d14j_routing", "a10_structure", "k1_violations", "k5_upgrade", "r3_gantt", "t1_sessions", "f63_fingerprint", "e12_folder_fingerprint",
]
TRAINING_TEXT = ["op2_license_scan", "op8_packing", "op10_jaccard", "op11_hard_negatives", "op12_near_vectors", "op13_centroids"]


def seconds(query, spark, sf_dir: str) -> float:  # noqa: ANN001
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", cpus)
    seconds(catalog.QUERIES[HEADLINES[0]], spark, sf_dir)  # start-up isn't timed
    times = {name: seconds(catalog.QUERIES[name], spark, sf_dir) for name in HEADLINES}
    more = {}
    try:
        from foliary.llm import catalog as llm_catalog
    except ImportError:
        llm_catalog = None
    if llm_catalog:
        more = {name: seconds(llm_catalog.QUERIES[name], spark, sf_dir) for name in TRAINING_TEXT}
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "training_text": more, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
