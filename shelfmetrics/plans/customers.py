"""Customer value, repeat behaviour, RFM and cohorts (Q32-Q46)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import band, one_row, part_of_total, pct, ratio, rnd, title_name, top
from ..operators import gap_days, not_in, percentiles, quantile_buckets
from ..sources import Retail
from .datasets import (NO_SEGMENT, asof_day, buyers, completed, rfm_label, segment_names, sold_lines)
from .registry import query


def customer_orders(m: Retail) -> DataFrame:
    return completed(m).groupBy("customer_id").agg(F.count("*").alias("orders"), F.sum("net_amount").alias("net"),
                                                   F.sum("total_amount").alias("gross"))


def with_segment(m: Retail, df: DataFrame, missing: str = NO_SEGMENT) -> DataFrame:
    people = m.customers.select("customer_id", "segment_id").join(segment_names(m), "segment_id", "left")
    return df.join(people, "customer_id").withColumn("segment", F.coalesce("segment_name", F.lit(missing)))


@query("Top twenty customers by lifetime net revenue")
def q32_top_customers(m: Retail, n: int = 20) -> DataFrame:
    best = top(buyers(m), n, F.col("net_revenue").desc(), F.col("customer_id"))
    named = with_segment(m, best, "(none)").join(m.customers.select("customer_id", "first_name", "last_name"), "customer_id")
    return named.orderBy(F.col("net_revenue").desc(), "customer_id").select(
        "customer_id", title_name("first_name", "last_name").alias("customer_name"), "segment", "orders",
        rnd("net_revenue", 0).alias("lifetime_net_revenue"), rnd("avg_order_value", 0).alias("avg_order_value"),
        F.col("first_order_date").alias("first_purchase"), F.col("last_order_date").alias("last_purchase"))


@query("Repeat customer rate")
def q33_repeat_rate(m: Retail) -> DataFrame:
    n = F.col("orders")
    return customer_orders(m).agg(
        F.count("*").alias("buying_customers"), F.count_if(n >= 2).alias("repeat_customers"),
        F.count_if(n == 1).alias("one_time_customers"), pct(F.count_if(n >= 2), F.count("*"), 2).alias("repeat_customer_rate_pct"))


@query("Customers who never purchased, by three spellings of the anti join")
def q34_never_purchased(m: Retail) -> DataFrame:
    people, bought = m.customers.select("customer_id"), completed(m).select("customer_id", "order_id")
    by_left = people.join(bought, "customer_id", "left").filter(F.col("order_id").isNull())
    by_anti = people.join(bought, "customer_id", "left_anti")
    return one_row(by_left.agg(F.count("*").alias("via_left_join")), by_anti.agg(F.count("*").alias("via_not_exists")),
                   not_in(people, bought, "customer_id").agg(F.count("*").alias("via_not_in")))


@query("Never-purchased customers by registration year")
def q35_never_purchased_by_year(m: Retail) -> DataFrame:
    idle = m.customers.join(completed(m).select("customer_id"), "customer_id", "left_anti")
    by = idle.groupBy(F.year("registration_date").alias("registration_year")).agg(F.count("*").alias("never_purchased"))
    return part_of_total(by, "never_purchased", "share_of_non_buyers_pct").orderBy("registration_year")


@query("Purchase frequency bands")
def q36_frequency_bands(m: Retail) -> DataFrame:
    label = band("orders", [(1, "a) 1 order"), (3, "b) 2-3 orders"), (6, "c) 4-6 orders"), (12, "d) 7-12 orders")],
                 "e) 13+ orders", closed=True)
    by = customer_orders(m).groupBy(label.alias("frequency_band")).agg(F.count("*").alias("customers"), F.sum("net").alias("net"))
    shared = part_of_total(part_of_total(by, "customers", "customer_share_pct"), "net", "revenue_share_pct")
    return shared.drop("net").orderBy("frequency_band")


@query("Revenue by customer segment")
def q37_segments(m: Retail) -> DataFrame:
    by = with_segment(m, customer_orders(m)).groupBy("segment").agg(
        F.count("*").alias("buying_customers"), F.sum("orders").alias("orders"), F.sum("net").alias("net"), F.sum("gross").alias("gross"))
    return part_of_total(by, "net", "revenue_share_pct").select(
        "segment", "buying_customers", "orders", rnd("net", 0).alias("net_revenue"), "revenue_share_pct",
        rnd(ratio("net", "buying_customers"), 0).alias("revenue_per_customer"),
        rnd(ratio("gross", "orders"), 0).alias("avg_order_value")).orderBy(F.col("net_revenue").desc())


def active_months(m: Retail) -> DataFrame:
    """Distinct (customer, month) with the customer's first month; a customer holds one row per month at most."""
    seen = completed(m).select("customer_id", F.col("order_month").alias("month")).distinct()
    return seen.withColumn("first_month", F.min("month").over(Window.partitionBy("customer_id")))


@query("New and returning customers per month")
def q38_new_and_returning(m: Retail) -> DataFrame:
    old = F.col("month") > F.col("first_month")
    return active_months(m).groupBy("month").agg(
        F.count_if(~old).alias("new_customers"), F.count_if(old).alias("returning_customers"),
        F.count("*").alias("active_customers"), pct(F.count_if(old), F.count("*"), 1).alias("returning_share_pct")).orderBy("month")


@query("RFM scores, top fifteen by monetary value")
def q39_rfm_scores(m: Retail, n: int = 15) -> DataFrame:
    scored = quantile_buckets(buyers(m), 5, [F.col("net_revenue").asc(), F.col("customer_id").asc()], "m_score")
    return top(scored, n, F.col("net_revenue").desc(), F.col("customer_id")).select(
        "customer_id", "recency_days", F.col("orders").alias("frequency"), rnd("net_revenue", 0).alias("monetary"),
        "r_score", "f_score", "m_score")


@query("RFM segment summary")
def q40_rfm_segments(m: Retail) -> DataFrame:
    by = buyers(m).groupBy(rfm_label(F.col("r_score"), F.col("f_score")).alias("rfm_segment")).agg(
        F.count("*").alias("customers"), F.sum("net_revenue").alias("net"), rnd(F.avg("recency_days"), 0).alias("avg_recency_days"),
        rnd(F.avg("orders"), 1).alias("avg_orders"))
    shared = part_of_total(part_of_total(by, "customers", "customer_share_pct"), "net", "revenue_share_pct")
    return shared.select("rfm_segment", "customers", "customer_share_pct", rnd("net", 0).alias("net_revenue"), "revenue_share_pct",
                         "avg_recency_days", "avg_orders").orderBy(F.col("net_revenue").desc())


def month_index(month: Column, cohort: Column) -> Column:
    return (F.year(month) - F.year(cohort)) * 12 + F.month(month) - F.month(cohort)


def cohort_activity(m: Retail) -> DataFrame:
    """Customers by (cohort, months since the first purchase)."""
    seen = active_months(m)
    return seen.groupBy(F.col("first_month").alias("cohort"), month_index(F.col("month"), F.col("first_month")).alias("k")).agg(
        F.count("*").alias("customers"))


def last_full_cohort(m: Retail, follow_up: int) -> Column:
    newest = completed(m).agg(F.max("order_day")).scalar()
    return F.add_months(F.trunc(newest, "month"), -follow_up)


@query("Cohort retention after one, two, three and six months")
def q41_cohort_retention(m: Retail, steps: tuple[int, ...] = (1, 2, 3, 6), follow_up: int = 6) -> DataFrame:
    size = F.sum(F.when(F.col("k") == 0, F.col("customers")))
    known = cohort_activity(m).filter(F.col("cohort") <= last_full_cohort(m, follow_up))
    return known.groupBy("cohort").agg(size.alias("cohort_size"), *[
        pct(F.coalesce(F.sum(F.when(F.col("k") == s, F.col("customers"))), F.lit(0)), size, 1).alias(f"m{s}_pct") for s in steps]).orderBy("cohort")


@query("Lifetime value to date by segment")
def q42_lifetime_value(m: Retail) -> DataFrame:
    """Only orders with lines count, as the value is taken from the lines."""
    per_order = sold_lines(m).groupBy("customer_id", "order_id").agg(
        F.sum("net_revenue").alias("net"), F.sum("gross_profit").alias("profit"), F.min("order_day").alias("day"))
    per = per_order.groupBy("customer_id").agg(
        F.count("*").alias("orders"), F.sum("net").alias("net"), F.sum("profit").alias("profit"),
        F.datediff(F.max("day"), F.min("day")).alias("span"))
    return with_segment(m, per).groupBy("segment").agg(
        F.count("*").alias("customers"), rnd(F.avg("orders"), 1).alias("avg_orders"), rnd(F.avg("net"), 0).alias("avg_lifetime_revenue"),
        rnd(F.avg("profit"), 0).alias("avg_lifetime_gross_profit"), rnd(F.avg("span"), 0).alias("avg_active_span_days")
    ).orderBy(F.col("avg_lifetime_revenue").desc())


@query("Customer activity status at the as-of day")
def q43_activity_status(m: Retail) -> DataFrame:
    last = completed(m).groupBy("customer_id").agg(F.max("order_day").alias("last_order"))
    days = F.datediff(asof_day(m), F.col("last_order"))
    label = (F.when(days.isNull(), "4) Never purchased").when(days <= 90, "1) Active (bought in last 90 days)")
             .when(days <= 365, "2) Inactive (91-365 days)").otherwise("3) Lost (over 365 days)"))
    by = m.customers.select("customer_id").join(last, "customer_id", "left").groupBy(label.alias("customer_status")).agg(
        F.count("*").alias("customers"))
    return part_of_total(by, "customers", "share_pct").orderBy("customer_status")


@query("Top customer of every store")
def q44_store_favourites(m: Retail) -> DataFrame:
    per = completed(m).groupBy("store_id", "customer_id").agg(F.count("*").alias("orders"), F.sum("net_amount").alias("net"))
    best = per.groupBy("store_id").agg(F.max(F.struct("net", (-F.col("customer_id")).alias("k"), "customer_id", "orders")).alias("b"))
    return (best.select("store_id", "b.*").join(m.stores.select("store_id", "store_name"), "store_id")
            .join(m.customers.select("customer_id", "first_name", "last_name"), "customer_id").orderBy(F.col("net").desc())
            .select("store_name", "customer_id", title_name("first_name", "last_name", missing_last=False).alias("customer_name"),
                    "orders", rnd("net", 0).alias("net_revenue")))


@query("Days between purchases")
def q45_days_between_orders(m: Retail) -> DataFrame:
    gaps = gap_days(completed(m), "customer_id", "order_day").groupBy("gap_days").agg(F.sum("events").alias("n"))
    spread = percentiles(gaps, "gap_days", {"median_gap_days": 0.5, "p90_gap_days": 0.9}, weight="n")
    mean = gaps.agg(F.sum("n").alias("repeat_orders_measured"),
                    rnd(ratio(F.sum(F.col("gap_days") * F.col("n")), F.sum("n")), 1).alias("avg_gap_days"))
    return one_row(mean, spread)


@query("Customer revenue concentration by decile")
def q46_revenue_deciles(m: Retail) -> DataFrame:
    per = customer_orders(m).select("customer_id", "net")
    by = quantile_buckets(per, 10, [F.col("net").asc(), F.col("customer_id").asc()], "decile").groupBy("decile").agg(
        F.count("*").alias("customers"), F.sum("net").alias("net"))
    upto = F.sum("net").over(Window.orderBy(F.col("decile").desc()))
    return part_of_total(by, "net", "revenue_share_pct").select(
        "decile", "customers", rnd("net", 0).alias("net_revenue"), "revenue_share_pct",
        pct(upto, F.sum("net").over(Window.partitionBy()), 2).alias("cumulative_share_from_top_pct")).orderBy(F.col("decile").desc())
