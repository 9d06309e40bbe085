"""Write explain("formatted") of the headline plans to docs/plans/.

Usage: python tools/explain_plans.py [sf_dir]
The distributed orderings are forced to 8 buckets so the bucketed shape
(one hash exchange on _bkt, per-bucket side aggregates) is visible even at
small scale factors.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from shoplens.operators import lorenz, master, sequence, trend  # noqa: E402
from shoplens.plans.catalog import REPORTS, Context  # noqa: E402
from shoplens.session import get_spark  # noqa: E402
from shoplens.sources.star_schema import from_star_schema  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    t = from_star_schema(spark, sf_dir)
    ctx = Context(t, buckets=8, tag="explain")
    plans = {
        "monthly_sales": trend.monthly_sales(t.orders, t.payments, t.delivered),
        "person_order_facts": master.person_order_facts(t.customers, t.orders, t.payments, t.delivered),
        "lorenz_curve_8_buckets": lorenz.lorenz_curve(ctx.master, buckets=8),
        "order_sequence_8_buckets": sequence.order_sequence(ctx.master, t.customers, t.orders, ctx.paid,
                                                            buckets=8),
        "segment_category_mix": REPORTS["segment_category_mix"](ctx),
        "cohort_lift": REPORTS["cohort_lift"](ctx),
    }
    out_dir = os.path.join(ROOT, "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    for name, df in plans.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write(f"# {name} at {os.path.basename(sf_dir)}\n\n" + buf.getvalue())
        print(name)


if __name__ == "__main__":
    main()
