"""Report catalogue: every analysis as a function of the shared views
(``REPORTS``), bound to the driver data as ``(spark, sf_dir) -> DataFrame``
(``QUERIES``) or run over any tables with :func:`run_reports`.

Shared intermediates (customer master, delivered-order view, RFM base and
scores, Lorenz curve, segments) are built once per state of a data folder
and written, as the reference reuses its views; later sessions find them. Outputs carry money as
DOUBLE and keep plain lower-case column names; the SQL twin of each query is
in :mod:`shoplens.plans.oracle`.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.common import money
from shoplens.operators import (category, cohort, first_purchase, funnel, lorenz, master,
                                quality, rfm, segments, sequence, stats, trend)
from shoplens.plans.cache import Views, materialize
from shoplens.session import checkpoint_dir
from shoplens.sources import raw_export
from shoplens.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS
from shoplens.sources.star_schema import Tables, from_star_schema

PERSON = master.PERSON


class Context:
    """Lazily built, persisted intermediates over one set of tables."""

    def __init__(self, tables: Tables, buckets: int | None = None, tag: str = "ctx", views: Views | None = None):
        self.t = tables
        self.buckets = buckets
        self.tag = tag
        self.views = views
        self._memo: dict[str, DataFrame] = {}

    def _get(self, name: str, build: Callable[[], DataFrame], persist: bool = True, bucket_by: str | None = None) -> DataFrame:
        """Build a view once; shared views are written once and read back
        (lineage cut, see :mod:`shoplens.plans.cache`), by this session or, if
        there is a store of views, by an earlier one over the same files."""
        if name not in self._memo:
            if not persist:
                self._memo[name] = build()
            elif self.views is not None:
                self._memo[name] = self.views.get(name, build, bucket_by)
            else:
                self._memo[name] = materialize(build(), f"{self.tag}_{name}", bucket_by)
        return self._memo[name]

    # -- views of the reference, in build order --------------------------------
    @property
    def dictionary(self) -> DataFrame:
        return self._get("dictionary", lambda: self.t.dictionary, persist=False)

    @property
    def orders(self) -> DataFrame:          # orders as they lie for joins on their key
        return self._get("orders", lambda: self.t.orders.select("order_id", "customer_id", "status", "purchase_timestamp"),
                         bucket_by="order_id")

    @property
    def paid_types(self) -> DataFrame:      # payments summed per order and payment type
        return self._get("paid_types", lambda: master.order_type_totals(self.t.payments), bucket_by="order_id")

    @property
    def paid(self) -> DataFrame:            # payments summed per order (1 row per order)
        return self._get("paid", lambda: master.order_payment_totals(self.paid_types), bucket_by="order_id")

    @property
    def facts(self) -> DataFrame:           # per-person order facts (one pass over orders)
        t = self.t
        return self._get("facts", lambda: master.person_order_facts(
            t.customers, self.orders, self.paid, t.delivered))

    @property
    def master(self) -> DataFrame:          # customer_master_table
        t = self.t
        return self._get("master", lambda: master.customer_master(
            t.customers, t.orders, self.paid, t.delivered, self.facts))

    @property
    def delivered(self) -> DataFrame:       # v_customer_delivered_orders
        t = self.t
        return self._get("delivered", lambda: master.customer_delivered_orders(
            t.customers, t.orders, self.paid, t.as_of, t.delivered, self.facts))

    @property
    def base(self) -> DataFrame:            # v_rfm_base
        return self._get("base", lambda: rfm.rfm_base(self.delivered))

    @property
    def scored(self) -> DataFrame:          # v_rfm_scored
        return self._get("scored", lambda: rfm.rfm_scored(self.base))

    @property
    def exploration_scored(self) -> DataFrame:   # scoring on the exploratory repeat rule
        t = self.t
        return self._get("exploration_scored", lambda: rfm.rfm_scored(
            rfm.rfm_exploration_base(self.delivered, t.customers, t.orders, t.delivered, 2, self.facts)))

    @property
    def curve(self) -> DataFrame:           # customer_lorenz
        return self._get("curve", lambda: lorenz.lorenz_curve(self.master, self.buckets))

    @property
    def segments(self) -> DataFrame:
        return self._get("segments", lambda: lorenz.value_segments(self.curve))

    @property
    def sequence(self) -> DataFrame:
        t = self.t
        return self._get("sequence", lambda: sequence.order_sequence(
            self.master, t.customers, self.orders, self.paid, None, self.buckets))

    @property
    def order_product(self) -> DataFrame:   # cl_order_product
        t = self.t
        return self._get("order_product", lambda: category.order_product(
            t.items, t.products, self.dictionary), persist=False)

    @property
    def order_groups(self) -> DataFrame:    # items and sales per (order, category group)
        t = self.t
        return self._get("order_groups", lambda: category.order_group_summary(
            t.items, t.products, self.dictionary), bucket_by="order_id")

    @property
    def first_items(self) -> DataFrame:
        t = self.t
        return self._get("first_items", lambda: first_purchase.first_order_items(
            t.customers, t.orders, t.items, t.products, self.dictionary, t.delivered, self.facts))

    @property
    def first_cats(self) -> DataFrame:
        t = self.t
        return self._get("first_cats", lambda: cohort.first_categories(
            t.customers, t.orders, t.items, t.products, self.dictionary, t.delivered,
            self.order_groups, self.facts))

    @property
    def stars(self) -> DataFrame:           # star_customer
        return self._get("stars", lambda: cohort.star_customers(self.scored), persist=False)

    @property
    def lift(self) -> DataFrame:
        return self._get("lift", lambda: cohort.cohort_lift(self.first_cats, self.stars, self.delivered))


_CONTEXTS: dict[tuple, Context] = {}
_STATES: dict[tuple, tuple] = {}
_SERIAL = itertools.count()


def context(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> Context:
    """The shared views over one data folder as it is now: a folder whose files
    changed gets new views. ``buckets`` forces the bucket count of the
    distributed orderings (None: chosen from the row count)."""
    key, state = (id(spark), sf_dir, buckets), folder_state(spark, sf_dir)
    if key not in _CONTEXTS or _STATES.get(key) != state:
        _STATES[key] = state
        tag = f"{next(_SERIAL)}_" + "".join(ch if ch.isalnum() else "_" for ch in sf_dir.strip("/"))[-40:]
        _CONTEXTS[key] = Context(from_star_schema(spark, sf_dir), buckets=buckets, tag=tag,
                                 views=Views(spark, sf_dir, (state, buckets)))
    return _CONTEXTS[key]


def folder_state(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of the files of a folder's tables."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)

    def listed(path) -> list:
        return [(s.getPath().getName(), s.getLen(), s.getModificationTime()) if s.isFile()
                else (s.getPath().getName(), *listed(s.getPath())) for s in fs.listStatus(path)]
    return tuple(sorted(listed(jvm.org.apache.hadoop.fs.Path(folder)), key=lambda x: x[0]))


def reset_contexts() -> None:
    _CONTEXTS.clear()
    _STATES.clear()


# ---------------------------------------------------------------------------
# output shaping
# ---------------------------------------------------------------------------

def _master_out(m: DataFrame) -> DataFrame:
    return m.withColumn("sales", money("sales"))


def _delivered_out(v: DataFrame) -> DataFrame:
    return v.withColumn("total_sales", money("total_sales"))


# ---------------------------------------------------------------------------
# reports: one function of the shared views per analysis
# ---------------------------------------------------------------------------

def r_category_dictionary(c: Context) -> DataFrame:
    """Category dictionary with cleaned names and groups."""
    return c.dictionary.select(
        "product_category", "product_category_eng", "clean_category", "category_group")


def r_clean_city(c: Context) -> DataFrame:
    """Customers' cleaned city names."""
    return c.t.customers.select("customer_id", "city", "clean_city")


def r_variant_report(c: Context) -> DataFrame:
    """Spelling variants of the city per zip."""
    return quality.variant_report(c.t.customers, "zip_code_prefix", "city", "clean_city", "state", 10)


def r_collated_cities(c: Context) -> DataFrame:
    """Cities under a collation that folds case and accents: spellings, rows, states."""
    return quality.collated_groups(c.t.customers, "city", other="state")


def r_collated_city_count(c: Context) -> DataFrame:
    """Per state, distinct cities as written and under that collation."""
    return quality.collated_count(c.t.customers, "state", "city")


def r_distinct_values(c: Context) -> DataFrame:
    """City and state values of one zip (``extra['probe_zip']``), or of every
    zip that has more than one city spelling."""
    cust = c.t.customers
    probe = c.t.extra.get("probe_zip")
    if probe is not None:
        return quality.distinct_values(cust, ["city", "state"], F.col("zip_code_prefix") == probe)
    varied = (cust.groupBy("zip_code_prefix").agg(F.count_distinct("city").alias("_n"))
              .where(F.col("_n") > 1).select("zip_code_prefix"))
    return quality.distinct_values(cust.join(varied, "zip_code_prefix", "left_semi"),
                                   ["zip_code_prefix", "city", "state"])


def r_attribute_drift(c: Context) -> DataFrame:
    """Persons whose customer rows disagree on state, city or zip."""
    return quality.attribute_drift(c.t.customers, PERSON, ["state", "clean_city", "zip_code_prefix"],
                                   names={"clean_city": "city_cnt", "zip_code_prefix": "zip_cnt"})


def r_latest_row_per_key(c: Context) -> DataFrame:
    """Latest customer row (address) per person by purchase time, then
    customer id."""
    t = c.t
    # One row a customer id before the join, however many orders it has.
    latest = t.orders.groupBy("customer_id").agg(F.max("purchase_timestamp").alias("purchase_timestamp"))
    joined = latest.join(t.customers.select("customer_id", PERSON, "state", "clean_city", "zip_code_prefix"), "customer_id")
    return master.latest_row_per_key(joined, PERSON, ["purchase_timestamp", "customer_id"],
                                     ["customer_id", "state", "clean_city", "zip_code_prefix"])


def r_one_customer(c: Context) -> DataFrame:
    """One row per person: latest address, order count, first and last order."""
    return master.one_customer(c.t.customers, c.t.orders, c.facts)


def r_key_uniqueness(c: Context) -> DataFrame:
    """Rows versus distinct persons of the customer master."""
    return quality.key_uniqueness(c.master, PERSON, "unique_customer_cnt")


def r_delivered_summary(c: Context) -> DataFrame:
    """Paid delivered orders and sales per person."""
    t = c.t
    out = master.delivered_summary(t.customers, t.orders, c.paid, t.delivered, c.facts)
    return out.withColumn("sales", money("sales"))


def r_customer_master(c: Context) -> DataFrame:
    """Customer master with active / repeat / interest flags."""
    return _master_out(c.master)


def r_flag_domain(c: Context) -> DataFrame:
    """Values taken by the interest flag."""
    return quality.distinct_values(c.master, ["interest_customer"])


def r_integrity_report(c: Context) -> DataFrame:
    """Declared primary and foreign keys: violating rows per constraint."""
    t = c.t
    tables = {"customers": t.customers, "orders": t.orders, "order_payments": t.payments,
              "order_items": t.items, "products": t.products,
              "category_names_english": c.dictionary}
    tables.update(t.extra.get("raw_tables", {}))     # sellers, reviews when loaded
    return quality.integrity_report(tables, FOREIGN_KEYS, PRIMARY_KEYS, t.extra.get("rejects"))


def r_funnel_rates(c: Context) -> DataFrame:
    """Funnel counts and conversion rates."""
    return funnel.funnel_rates(c.master)


def r_funnel_stages(c: Context) -> DataFrame:
    """Funnel as four stage rows."""
    return funnel.funnel_stages(c.master)


def r_order_sequence(c: Context) -> DataFrame:
    """Every order of a repeat customer, numbered, with the previous order."""
    return sequence.sequence_output(c.sequence)


def r_sequence_stats(c: Context) -> DataFrame:
    """Per order number: count, gap to the previous order, mean sales."""
    return sequence.sequence_stats(c.sequence)


def r_sequence_category_mix(c: Context) -> DataFrame:
    """Category share per order number 1-4 (known categories)."""
    return sequence.sequence_category_mix(c.sequence, c.t.items, c.t.products, c.dictionary,
                                          summary=c.order_groups)


def r_sequence_category_pivot(c: Context) -> DataFrame:
    """Category x order number 1-4 of unrounded shares, unknown kept."""
    return sequence.sequence_category_pivot(c.sequence, c.t.items, c.t.products, c.dictionary,
                                            summary=c.order_groups)


def r_lorenz_curve(c: Context) -> DataFrame:
    """Lorenz curve of customer sales."""
    return lorenz.curve_output(c.curve)


def r_lorenz_peak(c: Context) -> DataFrame:
    """Point of the Lorenz curve farthest from the diagonal."""
    return lorenz.lorenz_peak(c.curve)


def r_value_segments(c: Context) -> DataFrame:
    """Structure, average and Pareto segments per customer."""
    return c.segments


def r_segment_category_mix(c: Context) -> DataFrame:
    """Category share per Pareto segment."""
    return segments.segment_category_mix(c.segments, c.t.customers, c.orders, c.t.items,
                                         c.t.products, c.dictionary, "pareto_segment",
                                         summary=c.order_groups)


def r_segment_order_counts(c: Context) -> DataFrame:
    """Order-count distribution per Pareto segment."""
    return segments.segment_order_counts(c.segments, c.t.customers, c.t.orders, "pareto_segment",
                                         facts=c.facts)


def r_structure_order_counts(c: Context) -> DataFrame:
    """Order-count distribution per structure segment."""
    return segments.segment_order_counts(c.segments, c.t.customers, c.t.orders, "structure_segment",
                                         facts=c.facts)


def r_order_count_distribution(c: Context) -> DataFrame:
    """Delivered-order-count distribution over all delivered customers."""
    return segments.order_count_distribution(c.master, c.t.customers, c.t.orders, c.t.delivered,
                                             facts=c.facts)


def r_order_product(c: Context) -> DataFrame:
    """Item rows with their category."""
    return c.order_product.withColumn("price", money("price"))


def r_category_orders(c: Context) -> DataFrame:
    """Distinct orders per category group."""
    return category.category_orders(c.order_groups)


def r_mapping_cardinality(c: Context) -> DataFrame:
    """Distinct cleaned categories versus groups among sold items."""
    return quality.mapping_cardinality(c.order_product, ["clean_category", "category_group"])


def r_category_rank_orders(c: Context) -> DataFrame:
    """Category groups dense-ranked by orders."""
    return category.category_rank(c.order_groups, "order_cnt")


def r_category_rank_sales(c: Context) -> DataFrame:
    """Category groups dense-ranked by sales."""
    return category.category_rank(c.order_groups, "sales")


def r_category_order_value(c: Context) -> DataFrame:
    """Sales per order by category group, with ranks."""
    return category.category_order_value(c.order_groups)


def r_category_item_price(c: Context) -> DataFrame:
    """Price per item row by category group, with ranks."""
    return category.category_item_price(c.order_groups)


def r_region_core_share(c: Context) -> DataFrame:
    """Core and above-average customer share per state and city."""
    return segments.region_core_share(c.segments, c.master)


def r_first_order_items(c: Context) -> DataFrame:
    """Items of each person's first delivered order."""
    return c.first_items


def r_single_item_first_mix(c: Context) -> DataFrame:
    """Category share of single-item first orders."""
    return first_purchase.single_item_first_mix(c.first_items)


def r_total_sales(c: Context) -> DataFrame:
    """Total delivered sales."""
    return trend.total_sales(c.orders, c.paid, c.t.delivered)


def r_monthly_sales(c: Context) -> DataFrame:
    """Delivered sales per month."""
    return trend.monthly_sales(c.orders, c.paid, c.t.delivered)


def r_monthly_sales_by_type(c: Context) -> DataFrame:
    """Delivered sales per month and payment type."""
    t = c.t
    return trend.monthly_sales_by_type(c.orders, c.paid_types, t.delivered)


def r_order_status_totals(c: Context) -> DataFrame:
    """All orders and delivered orders."""
    t = c.t
    return trend.order_status_totals(t.orders, t.delivered)


def r_customer_delivered_orders(c: Context) -> DataFrame:
    """Per person: paid delivered orders, last order, recency, sales."""
    return _delivered_out(c.delivered)


def r_one_time_count(c: Context) -> DataFrame:
    """Customers with exactly one paid delivered order."""
    return rfm.one_time_count(c.delivered)


def r_one_time_delivered_orders(c: Context) -> DataFrame:
    """Delivered orders of persons with fewer than two of them."""
    return rfm.one_time_delivered_orders(c.t.customers, c.t.orders, c.t.delivered, c.facts)


def r_customer_type_profile(c: Context) -> DataFrame:
    """One-time versus repeat customers: size, sales, frequency, recency."""
    return rfm.customer_type_profile(c.delivered)


def r_rfm_base(c: Context) -> DataFrame:
    """Repeat customers (two or more paid delivered orders)."""
    return _delivered_out(c.base)


def r_rfm_exploration_base(c: Context) -> DataFrame:
    """Repeat customers by the exploratory rule (before the payment join)."""
    return _delivered_out(rfm.rfm_exploration_base(c.delivered, c.t.customers, c.t.orders, c.t.delivered,
                                                   2, c.facts))


def r_recency_bins_exploration(c: Context) -> DataFrame:
    """Equal-width recency bins, exploratory base, unrounded shares."""
    return rfm.recency_bins(rfm.delivered_recency(c.t.customers, c.t.orders, c.t.as_of, c.t.delivered,
                                                  2, c.facts), digits=None)


def r_rfm_exploration_scored(c: Context) -> DataFrame:
    """R/F/M labels and personas on the exploratory base."""
    return rfm.scored_output(c.exploration_scored)


def r_persona_distribution_exploration(c: Context) -> DataFrame:
    """Persona counts on the exploratory base."""
    return rfm.persona_distribution(c.exploration_scored)


def r_bcg_quadrants_exploration(c: Context) -> DataFrame:
    """BCG quadrants on the exploratory base."""
    return rfm.bcg_quadrants(c.exploration_scored)


def r_frequency_distribution(c: Context) -> DataFrame:
    """Repeat customers per order frequency."""
    return rfm.frequency_distribution(c.base)


def r_recency_bins(c: Context) -> DataFrame:
    """Repeat customers per equal-width recency bin."""
    return rfm.recency_bins(c.base)


def r_frequency_distribution_exploration(c: Context) -> DataFrame:
    """Order frequency on the exploratory base (repeat decided before the payment join)."""
    return rfm.frequency_distribution(c.exploration_scored)


def r_mean_median_exploration(c: Context) -> DataFrame:
    """Mean and exact median of sales on the exploratory base."""
    return rfm.mean_median(c.exploration_scored)


def r_ntile_summary_exploration(c: Context) -> DataFrame:
    """Sales quartiles of the exploratory base."""
    return rfm.ntile_summary(c.exploration_scored)


def r_mean_median(c: Context) -> DataFrame:
    """Mean and exact median of repeat customers' sales."""
    return rfm.mean_median(c.base)


def r_ntile_summary(c: Context) -> DataFrame:
    """Size and sales range of each sales quartile."""
    return rfm.ntile_summary(c.scored)


def r_rfm_scored(c: Context) -> DataFrame:
    """R/F/M labels and persona per repeat customer."""
    return rfm.scored_output(c.scored)


def r_persona_distribution(c: Context) -> DataFrame:
    """Repeat customers per persona."""
    return rfm.persona_distribution(c.scored)


def r_bcg_quadrants(c: Context) -> DataFrame:
    """Repeat customers per BCG quadrant, with mean frequency."""
    return rfm.bcg_quadrants(c.scored)


def r_first_order(c: Context) -> DataFrame:
    """Delivered orders numbered per person."""
    return cohort.first_order(c.t.customers, c.t.orders, c.t.delivered, c.buckets)


def r_star_customers(c: Context) -> DataFrame:
    """The STAR cohort (recent and high value)."""
    return rfm.scored_output(c.stars)


def r_cohort_match_report(c: Context) -> DataFrame:
    """How the STAR cohort maps onto first-purchase categories."""
    return cohort.cohort_match_report(c.first_cats, c.stars)


def r_cohort_lift(c: Context) -> DataFrame:
    """First-purchase category lift of STAR versus one-time customers."""
    return c.lift


def r_repeat_baseline(c: Context) -> DataFrame:
    """Repeat customers over all delivered customers."""
    return cohort.repeat_baseline(c.base, c.t.customers, c.t.orders, c.t.delivered, c.facts)


def r_chi_square_statistic(c: Context) -> DataFrame:
    """Chi-square statistic and degrees of freedom of the lift table."""
    return stats.chi_square_statistic(c.lift, ["star_cnt", "one_time_cnt"])


def r_chi_square_expected(c: Context) -> DataFrame:
    """Expected frequencies of the lift table under independence."""
    return stats.expected_counts(c.lift, ["star_cnt", "one_time_cnt"])


def r_chi_square_independence(c: Context) -> DataFrame:
    """Chi-square statistic, degrees of freedom and p-value."""
    return stats.chi_square_independence(c.lift, ["star_cnt", "one_time_cnt"])


def r_residual_report(c: Context) -> DataFrame:
    """Residuals per category and the Bonferroni flag."""
    return stats.residual_report(c.lift)


def r_ab_sample_size(c: Context) -> DataFrame:
    """A/B sample sizes per relative lift of the repeat baseline."""
    base = r_repeat_baseline(c).select(F.col("baseline_pct").alias("p1"))
    return stats.ab_sample_size(base)


# Presentation order of the original reports (ORDER BY), with a full
# tie-break. Only reports whose size is bounded by a small domain (stages,
# months, categories, segments, buckets) are sorted; row-level views at
# customer or order grain stay unsorted, a global sort of them would only
# cost a shuffle.
REPORT_ORDER = {
    "funnel_stages": lambda: [F.asc("stage_order")],
    "sequence_stats": lambda: [F.asc("order_times")],
    "sequence_category_mix": lambda: [F.asc("order_times"), F.desc("ratio"), F.asc("category_group")],
    "sequence_category_pivot": lambda: [F.desc_nulls_last("order_1"), F.asc("category_group")],
    "segment_category_mix": lambda: [F.asc("pareto_segment"), F.desc("ratio"), F.asc("category_group")],
    "segment_order_counts": lambda: [F.asc("pareto_segment"), F.asc("order_count")],
    "structure_order_counts": lambda: [F.asc("structure_segment"), F.asc("order_count")],
    "order_count_distribution": lambda: [F.asc("order_count")],
    "category_orders": lambda: [F.desc("order_cnt"), F.asc("category_group")],
    "category_rank_orders": lambda: [F.desc("order_cnt"), F.asc("category_group")],
    "category_rank_sales": lambda: [F.desc("sales"), F.asc("category_group")],
    "category_order_value": lambda: [F.desc("avg_sales_per_order"), F.asc("category_group")],
    "category_item_price": lambda: [F.desc("avg_price_per_item_row"), F.asc("category_group")],
    "region_core_share": lambda: [F.desc("sales"), F.asc("state"), F.asc("clean_city")],
    "single_item_first_mix": lambda: [F.desc("cnt"), F.asc("category_group")],
    "monthly_sales": lambda: [F.asc("year_m")],
    "monthly_sales_by_type": lambda: [F.asc("year_m"), F.desc("sales"), F.asc("payment_type")],
    "frequency_distribution": lambda: [F.asc("order_freq")],
    "frequency_distribution_exploration": lambda: [F.asc("order_freq")],
    "recency_bins": lambda: [F.asc("recency_bucket")],
    "recency_bins_exploration": lambda: [F.asc("recency_bucket")],
    "ntile_summary": lambda: [F.asc("m_bucket")],
    "ntile_summary_exploration": lambda: [F.asc("m_bucket")],
    "persona_distribution": lambda: [F.desc("cnt"), F.asc("persona")],
    "persona_distribution_exploration": lambda: [F.desc("cnt"), F.asc("persona")],
    "bcg_quadrants": lambda: [F.desc("cnt"), F.asc("bcg_quadrant")],
    "bcg_quadrants_exploration": lambda: [F.desc("cnt"), F.asc("bcg_quadrant")],
    "cohort_lift": lambda: [F.desc_nulls_last("lift"), F.asc("category_group")],
    "residual_report": lambda: [F.desc("star_resid"), F.asc("category_group")],
    "customer_type_profile": lambda: [F.asc("customer_type")],
}


def _ordered(name: str, fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    if name not in REPORT_ORDER:
        return fn

    def report(c: Context) -> DataFrame:
        return fn(c).orderBy(*REPORT_ORDER[name]())
    report.__name__, report.__doc__ = fn.__name__, fn.__doc__
    return report


REPORTS: dict[str, Callable[[Context], DataFrame]] = {
    name[2:]: _ordered(name[2:], fn) for name, fn in list(globals().items())
    if name.startswith("r_") and callable(fn)
}


def _bind(report: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(context(spark, sf_dir))
    query.__name__ = report.__name__.replace("r_", "q_", 1)
    query.__doc__ = report.__doc__
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _bind(fn) for name, fn in REPORTS.items()}
q_bcg_quadrants = QUERIES["bcg_quadrants"]


def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the nine raw tables after they were written as CSV and loaded again."""
    folder = os.path.join(checkpoint_dir(spark), "shoplens", f"csv-{uuid.uuid4().hex[:12]}")
    return raw_export.profile(raw_export.round_trip(raw_export.raw_tables(spark, sf_dir), folder))


QUERIES["csv_round_trip"] = q_csv_round_trip


def run_reports(tables: Tables, names: list[str] | None = None,
                buckets: int | None = None) -> dict[str, DataFrame]:
    """Every report (or the named ones) over any :class:`Tables`, e.g. from
    :func:`shoplens.sources.csv_tables.from_csv_folder`. Shared views are
    built once and written under the session's checkpoint folder."""
    ctx = Context(tables, buckets=buckets, tag=f"{next(_SERIAL)}_run")
    return {n: REPORTS[n](ctx) for n in (names or REPORTS)}
