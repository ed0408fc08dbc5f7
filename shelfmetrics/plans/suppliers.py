"""Procurement spend, delivery reliability and dependency (Q81-Q88)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import part_of_total, pct, rnd, stacked, top
from ..operators import percent_ranks
from ..sources import Retail
from .datasets import asof_day, supplier_fill, supplier_orders
from .registry import query
from .sales import product_totals


def supplier_names(m: Retail) -> DataFrame:
    return m.suppliers.select("supplier_id", "supplier_name", "lead_time_days")


@query("Supplier spend, top fifteen")
def q81_supplier_spend(m: Retail, n: int = 15) -> DataFrame:
    spend = F.col("quantity_ordered") * F.col("unit_cost")
    per_po = m.purchase_items.groupBy("purchase_id").agg(F.sum("quantity_ordered").alias("u"), F.sum(spend).alias("s"))
    by = per_po.join(m.purchases.select("purchase_id", "supplier_id"), "purchase_id").groupBy("supplier_id").agg(
        F.count("*").alias("purchase_orders"), F.sum("u").alias("units_ordered"), F.sum("s").alias("spend"))
    whole = m.purchase_items.agg(F.sum(spend)).scalar()
    best = top(by, n, F.col("spend").desc(), F.col("supplier_id"))
    return best.join(supplier_names(m), "supplier_id").orderBy(F.col("spend").desc()).select(
        "supplier_name", "purchase_orders", "units_ordered", rnd("spend", 0).alias("spend"), pct("spend", whole, 2).alias("share_of_spend_pct"))


@query("Supplier on-time delivery and delay")
def q82_on_time(m: Retail, min_pos: int = 30, n: int = 15) -> DataFrame:
    by = supplier_orders(m).filter(F.col("received_pos") >= min_pos).withColumn("on_time", pct("on_time_pos", "received_pos", 1))
    return top(by, n, F.col("on_time"), F.col("supplier_id")).join(supplier_names(m), "supplier_id").orderBy("on_time", "supplier_id").select(
        "supplier_name", F.col("lead_time_days").alias("promised_lead_days"), "received_pos", F.col("on_time").alias("on_time_pct"),
        rnd("avg_delay", 1).alias("avg_days_vs_expected"), F.col("worst_delay").alias("worst_delay_days"))


@query("Supplier fill rate")
def q83_fill_rate(m: Retail, min_units: int = 200, n: int = 15) -> DataFrame:
    by = supplier_fill(m).filter(F.col("ordered") >= min_units).withColumn("fill", pct("received", "ordered", 2))
    return top(by, n, F.col("fill"), F.col("supplier_id")).join(supplier_names(m), "supplier_id").orderBy("fill", "supplier_id").select(
        "supplier_name", "ordered", "received", F.col("fill").alias("fill_rate_pct"), F.col("short_lines").alias("short_shipped_lines"))


@query("Actual against promised lead time")
def q84_lead_time(m: Retail, min_pos: int = 30, n: int = 15) -> DataFrame:
    by = supplier_orders(m).filter(F.col("received_pos") >= min_pos).join(supplier_names(m), "supplier_id").withColumn(
        "gap", F.col("lead_days") - F.col("lead_time_days"))
    verdict = F.when(F.col("gap") > 2, "Slower than promised").when(F.col("gap") < -2, "Faster than promised").otherwise("In line")
    return top(by, n, rnd("gap", 1).desc(), F.col("supplier_id")).select(
        "supplier_name", F.col("lead_time_days").alias("promised_days"), rnd("lead_days", 1).alias("actual_avg_days"),
        rnd("gap", 1).alias("gap_days"), verdict.alias("assessment"))


@query("Revenue dependency on suppliers")
def q85_supplier_dependency(m: Retail, n: int = 12) -> DataFrame:
    totals = product_totals(m)
    by = totals.join(m.products.select("product_id", "supplier_id"), "product_id").groupBy("supplier_id").agg(
        F.count("*").alias("products_sold"), F.sum("net").alias("net"))
    best = top(part_of_total(by, "net", "revenue_share_pct", bounded=False), n, F.col("net").desc(), F.col("supplier_id"))
    return best.join(supplier_names(m), "supplier_id", "left").orderBy(F.col("net").desc()).select(
        F.coalesce("supplier_name", F.lit("(supplier missing on product)")).alias("supplier"), "products_sold",
        rnd("net", 0).alias("net_revenue"), "revenue_share_pct")


@query("Suppliers without products, and inactive suppliers with purchase orders")
def q86_supplier_findings(m: Retail) -> DataFrame:
    idle = m.suppliers.join(m.products.select("supplier_id"), "supplier_id", "left_anti")
    odd = m.suppliers.filter(~F.col("is_active")).join(m.purchases.select("supplier_id"), "supplier_id", "left_semi")
    return stacked(idle.select(F.lit("No products linked").alias("finding"), "supplier_name"),
                   odd.select(F.lit("Inactive but has purchase orders").alias("finding"), "supplier_name")).orderBy("finding", "supplier_name")


@query("Open and overdue purchase orders per supplier")
def q87_open_orders(m: Retail, n: int = 15) -> DataFrame:
    last = asof_day(m)
    by = m.purchases.filter(F.col("status") == "ORDERED").groupBy("supplier_id").agg(
        F.count("*").alias("open_pos"), F.count_if(F.col("expected_date") < last).alias("overdue_pos"),
        F.max(F.datediff(last, F.col("expected_date"))).alias("max_days_overdue"), F.sum("total_amount").alias("v"))
    most = [F.col("overdue_pos").desc(), F.col("v").desc()]
    return top(by, n, *most).join(supplier_names(m), "supplier_id").orderBy(*most).select(
        "supplier_name", "open_pos", "overdue_pos", "max_days_overdue", rnd("v", 0).alias("open_value"))


@query("Composite supplier score")
def q88_supplier_score(m: Retail, min_pos: int = 30, n: int = 10) -> DataFrame:
    """Each percent rank counts equal values first, so no rank gathers all suppliers in one task."""
    po = supplier_orders(m).filter(F.col("received_pos") >= min_pos)
    base = po.join(supplier_fill(m), "supplier_id").join(supplier_names(m), "supplier_id").select(
        "supplier_id", "supplier_name", "received_pos", pct("on_time_pos", "received_pos").alias("on_time"),
        pct("received", "ordered").alias("fill"), (F.col("lead_days") - F.col("lead_time_days")).alias("gap"))
    for measure, place, down in (("on_time", "p1", False), ("fill", "p2", False), ("gap", "p3", True)):
        base = percent_ranks(base, measure, place, descending=down)
    scored = base.withColumn("score", (F.col("p1") + F.col("p2") + F.col("p3")) / 3)
    best = top(scored, n, F.col("score").desc(), F.col("supplier_id"))
    return best.withColumn("overall_rank", F.rank().over(Window.orderBy(F.col("score").desc()))).select(
        "supplier_name", "received_pos", rnd("on_time", 1).alias("on_time_pct"), rnd("fill", 1).alias("fill_rate_pct"),
        rnd("gap", 1).alias("lead_time_gap_days"), rnd("score").alias("composite_score"), "overall_rank").orderBy("overall_rank")
