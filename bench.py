"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from rulelake.plans import queries as core
    from rulelake.runtime import session, ship

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = ship(session(cpus, int(cpus) if cpus.isdigit() else 8))
    names = (
        "type_usage", "dep_edges", "edge_matches", "fact_type_usage", "source_rules", "node_reachability", "reachability", "shortest_call_paths", "fact_ids",
        "fact_used_by", "layer_union", "match_bindings", "callsite_ids", "callsite_merge", "span_containment", "stable_keys", "rule_not", "rule_accumulate",
        "resolved_edges", "source_usages", "assembled_usages", "node_elements", "point_lookup",
    )
    found = {"flagship": core.flagship} | {k: core.queries()[k] for k in names}
    took = {}
    for name, f in found.items():
        began = time.time()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


main()
