"""Print, per registered query, the exchanges of its executed plan with
automatic broadcasting off (so only the explicit, size-bounded broadcasts
remain): hash/range exchanges, SinglePartition exchanges, sort-merge and
broadcast joins. A SinglePartition exchange must only ever sit on a global
aggregate's partial results or on a window over a bounded grouped result.

Usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from shoplens.plans.catalog import QUERIES  # noqa: E402
from shoplens.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        exch = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan))
        single = plan.count("Exchange SinglePartition")
        smj = plan.count("SortMergeJoin")
        bcast = plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")
        print(f"{name:34s} exchanges={exch:2d} single={single:2d} smj={smj:2d} broadcast={bcast:2d}")


if __name__ == "__main__":
    main()
