"""Print plan-shape facts for registered queries (exchanges, joins, pushdown).

usage: python tools/plans.py [sf_dir] name ...
Broadcasts are disabled so the plan shows the shape it takes when every
side is large (as at 100 TB); AQE is on, the final adaptive plan is read
after execution.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from grantrisk.plans.queries import QUERIES  # noqa: E402
from grantrisk.session import local_session  # noqa: E402


def facts(plan: str) -> dict:
    return {
        "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range_exchanges": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "nested_loop_joins": plan.count("NestedLoopJoin"),
        "cartesian": plan.count("CartesianProduct"),
        "python_udfs": plan.count("BatchEvalPython") + plan.count("ArrowEvalPython"),
        "pushed_filters": sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)))[:3],
    }


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    for name in args:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(name, facts(plan))


if __name__ == "__main__":
    main()
