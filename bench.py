"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: cores of the local session.
Each query runs whole and its rows go to the noop sink. `build_store` extracts every script
and writes the table the graph queries read.
"""

from __future__ import annotations

import json
import os
import time

from headwater.plans import queries as Q
from headwater.session import local_session

HEADLINE = [
    "build_store", "lineage_records", "source_tables", "complexity_reasons", "route_methods", "responses_parse", "waterfall",
    "ddl_columns", "edges", "edge_merge", "nodes_enriched", "column_edges", "graph_stats", "graph_degrees", "upstream",
    "downstream", "upstream_flow", "lineage_both", "trace_inbound_scripts", "trace_outbound", "tracker_upsert", "merge_results",
]


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = {**Q.queries(), "build_store": Q._extracted}
    warm = f"{os.path.dirname(sf_dir.rstrip('/'))}/sf0.001"
    if os.path.isdir(warm) and warm != sf_dir.rstrip("/"):
        registered["lineage_records"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
