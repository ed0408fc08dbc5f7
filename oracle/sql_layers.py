"""Analysis functions, measure layer, validation, integrity and load layer."""
from .compose import oracle

# ---- analysis functions
oracle("headline_kpis",
       "net_revenue:f gross_profit:f gross_margin_pct:f completed_orders:i cancelled_orders:i buying_customers:i avg_order_value:f repeat_customer_rate_pct:f order_return_rate_pct:f"
       " inventory_value_at_cost:f inventory_turnover_12m:f avg_customer_lifetime_revenue:f",
       """SELECT round(net, 0) AS net_revenue, round(p, 0) AS gross_profit, round(100e0 * p / net, 2) AS gross_margin_pct, n AS completed_orders, x AS cancelled_orders, k AS buying_customers,
       round(g / n, 0) AS avg_order_value, round(100e0 * r / k, 1) AS repeat_customer_rate_pct, round(100e0 * b / n, 2) AS order_return_rate_pct, round(v, 0) AS inventory_value_at_cost,
       round(cg / v, 2) AS inventory_turnover_12m, round(lt, 0) AS avg_customer_lifetime_revenue
       FROM (SELECT sum(net_revenue) AS net, sum(gross_profit) AS p, sum(orders) AS n, sum(cancelled_orders) AS x, CAST(sum(gross_sales_incl_gst) AS DOUBLE) AS g FROM d_month),
       (SELECT count(*) FILTER (orders > 0) AS k, count(*) FILTER (orders > 1) AS r, avg(net_revenue) FILTER (orders > 0) AS lt FROM d_customer),
       (SELECT count(*) AS b FROM x_flag WHERE back AND status = 'COMPLETED'), (SELECT CAST(sum(inventory_value) AS DOUBLE) AS v FROM d_stock),
       (SELECT CAST(sum(cogs) AS DOUBLE) AS cg FROM (SELECT cogs FROM d_month ORDER BY month DESC LIMIT 12))""")
oracle("growth_table",
       "month:d net_revenue:f orders:i gross_profit:f mom_growth_pct:f yoy_growth_pct:f moving_avg_3m:f running_total:f",
       """SELECT month, net_revenue, orders, gross_profit, round(100e0 * (net_revenue / lag(net_revenue) OVER w - 1), 4) AS mom_growth_pct,
       round(100e0 * (net_revenue / lag(net_revenue, 12) OVER w - 1), 4) AS yoy_growth_pct,
       CASE WHEN row_number() OVER w > 2 THEN round(avg(net_revenue) OVER (ORDER BY month ROWS 2 PRECEDING), 2) END AS moving_avg_3m, round(sum(net_revenue) OVER w, 2) AS running_total
       FROM d_month WINDOW w AS (ORDER BY month)""")
YEARLY = "(SELECT year, sum(orders) AS o, round(sum(net_revenue), 2) AS n, round(sum(gross_profit), 2) AS p, sum(online_orders) AS w FROM d_month GROUP BY 1)"
oracle("yearly_summary", "year:i orders:i net_revenue:f gross_profit:f margin_pct:f yoy_growth_pct:f",
       f"""SELECT year, o AS orders, n AS net_revenue, p AS gross_profit, round(100e0 * p / n, 4) AS margin_pct, round(100e0 * (n / lag(n) OVER (ORDER BY year) - 1), 4) AS yoy_growth_pct FROM {YEARLY}""")
oracle("pareto_of_products", "product_id:i value:f share_pct:f cumulative_pct:f abc_class:s",
       """SELECT product_id, v AS value, round(100e0 * v / w, 4) AS share_pct, round(100e0 * r / w, 4) AS cumulative_pct,
       CASE WHEN 100e0 * (r - v) / w < 70 THEN 'A' WHEN 100e0 * (r - v) / w < 90 THEN 'B' ELSE 'C' END AS abc_class
       FROM (SELECT product_id, CAST(value AS DOUBLE) AS v, CAST(sum(value) OVER () AS DOUBLE) AS w, CAST(sum(value) OVER (ORDER BY value DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS r
        FROM x_prodstock WHERE value > 0)""")
oracle("seasonality_index", "month_number:i month:s seasonality_index:f",
       """SELECT month_number, strftime(make_date(2000, CAST(month_number AS INTEGER), 1), '%b') AS month, round(100 * avg(v), 1) AS seasonality_index
       FROM (SELECT month_number, net_revenue / avg(net_revenue) OVER (PARTITION BY year) AS v FROM d_month) GROUP BY month_number""")
oracle("channel_mix", "year:i orders:i online_orders:i online_share_pct:f", f"SELECT year, o AS orders, w AS online_orders, round(100e0 * w / o, 4) AS online_share_pct FROM {YEARLY}")
oracle("category_table", "category_name:s net_revenue:f share_of_year_revenue_pct:f margin_pct:f yoy_growth_pct:f",
       "SELECT * FROM d_cat WHERE year = (SELECT max(year) FROM d_cat)")
oracle("order_value_distribution", "mean:f median:f p25:f p75:f p90:f p99:f max:f iqr_fence:f",
       """SELECT round(m, 2) AS mean, round(q[2], 3) AS median, round(q[1], 3) AS p25, round(q[3], 3) AS p75, round(q[4], 3) AS p90, round(q[5], 3) AS p99, x AS max,
       round(q[3] + 1.5 * (q[3] - q[1]), 3) AS iqr_fence FROM (SELECT avg(total) AS m, max(total) AS x, quantile_cont(CAST(total AS DOUBLE), [0.25, 0.5, 0.75, 0.9, 0.99]) AS q FROM m_done)""")
oracle("weekday_pattern", "weekday:s orders:i avg_order_value:f",
       "SELECT dayname(day) AS weekday, count(*) AS orders, round(CAST(sum(total) AS DOUBLE) / count(*) + 1e-7, 2) AS avg_order_value FROM m_done GROUP BY 1")
BUY = "d_customer WHERE orders > 0"
oracle("segment_summary",
       "segment:s customers:i orders:i net_revenue:f avg_lifetime_revenue:f avg_lifetime_profit:f revenue_share_pct:f",
       f"""SELECT segment, count(*) AS customers, sum(orders) AS orders, sum(net_revenue) AS net_revenue, round(avg(net_revenue), 2) AS avg_lifetime_revenue,
       round(avg(gross_profit), 2) AS avg_lifetime_profit, round(100e0 * sum(net_revenue) / sum(sum(net_revenue)) OVER (), 4) AS revenue_share_pct FROM {BUY} GROUP BY 1""")
oracle("rfm_summary",
       "rfm_segment:s customers:i net_revenue:f avg_recency_days:f avg_orders:f customer_share_pct:f revenue_share_pct:f",
       f"""SELECT t.l AS rfm_segment, x.* EXCLUDE rfm_segment FROM (SELECT unnest(['Champions','Loyal Customers','Potential Loyalists','At Risk','Lost Customers']) AS l) t
       LEFT JOIN (SELECT rfm_segment, count(*) AS customers, sum(net_revenue) AS net_revenue, round(avg(recency_days), 4) AS avg_recency_days, round(avg(orders), 4) AS avg_orders,
       round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS customer_share_pct, round(100e0 * sum(net_revenue) / sum(sum(net_revenue)) OVER (), 4) AS revenue_share_pct FROM {BUY} GROUP BY 1) x
       ON x.rfm_segment = t.l""")
oracle("activity_status", "activity_status:s customers:i share_pct:f",
       """SELECT t.l AS activity_status, x.n AS customers, x.s AS share_pct FROM (SELECT unnest(['Active (last 90 days)','Inactive (91-365 days)','Lost (over 365 days)','Never purchased']) AS l) t
       LEFT JOIN (SELECT activity_status, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS s FROM d_customer GROUP BY 1) x ON x.activity_status = t.l""")
oracle("repeat_rate", "buying_customers:i repeat_customers:i repeat_customer_rate_pct:f",
       f"""SELECT count(*) AS buying_customers, count(*) FILTER (orders > 1) AS repeat_customers, round(100e0 * count(*) FILTER (orders > 1) / count(*), 4) AS repeat_customer_rate_pct FROM {BUY}""")
oracle("frequency_bands", "frequency_band:s customers:i net_revenue:f customer_share_pct:f revenue_share_pct:f",
       f"""SELECT CASE WHEN orders = 1 THEN '1 order' WHEN orders < 4 THEN '2-3 orders' WHEN orders < 7 THEN '4-6 orders' WHEN orders < 13 THEN '7-12 orders' ELSE '13+ orders' END AS frequency_band,
       count(*) AS customers, sum(net_revenue) AS net_revenue, round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS customer_share_pct,
       round(100e0 * sum(net_revenue) / sum(sum(net_revenue)) OVER (), 4) AS revenue_share_pct FROM {BUY} GROUP BY 1""")
oracle("customer_concentration", "decile:i net_revenue:f revenue_share_pct:f",
       f"""SELECT k AS decile, sum(net_revenue) AS net_revenue, round(100e0 * sum(net_revenue) / sum(sum(net_revenue)) OVER (), 4) AS revenue_share_pct
       FROM (SELECT net_revenue, ntile(10) OVER (ORDER BY net_revenue, customer_id) AS k FROM {BUY}) GROUP BY 1""")
COHORT = """SELECT f.m AS cohort, datediff('month', f.m, a.month) AS k, count(*) AS n FROM (SELECT DISTINCT customer_id, month FROM m_done) a
 JOIN (SELECT customer_id, min(month) AS m FROM m_done GROUP BY 1) f ON f.customer_id = a.customer_id
 WHERE f.m <= (SELECT max(month) - INTERVAL 6 MONTH FROM m_done) GROUP BY ALL"""
oracle("cohort_retention", "cohort:d cohort_size:i " + " ".join(f"m{k}:f" for k in range(7)),
       f"""SELECT cohort, sum(n) FILTER (k = 0) AS cohort_size, {', '.join(f'round(100e0 * sum(n) FILTER (k = {k}) / sum(n) FILTER (k = 0), 4) AS m{k}' for k in range(7))}
       FROM ({COHORT}) GROUP BY cohort""")
oracle("top_customers",
       "customer_id:i customer_name:s segment:s orders:i net_revenue:f avg_order_value:f last_order_date:d rfm_segment:s",
       "SELECT * FROM d_customer ORDER BY net_revenue DESC, customer_id LIMIT 10")
oracle("health_summary", "health_status:s positions:i units:i value_at_cost:f position_share_pct:f value_share_pct:f",
       """SELECT t.l AS health_status, x.* EXCLUDE health_status FROM (SELECT unnest(['OUT_OF_STOCK','LOW_STOCK','HEALTHY','OVERSTOCKED','DEAD_STOCK']) AS l) t LEFT JOIN (
       SELECT health_status, count(*) AS positions, sum(quantity_on_hand) AS units, sum(inventory_value) AS value_at_cost, round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS position_share_pct,
       round(100e0 * sum(inventory_value) / sum(sum(inventory_value)) OVER (), 4) AS value_share_pct FROM d_stock GROUP BY 1) x ON x.health_status = t.l""")
oracle("store_risk",
       "store_name:s positions:i at_risk_positions:i inventory_value:f surplus_value:f stock_out_risk_pct:f surplus_share_pct:f",
       """SELECT *, round(100e0 * at_risk_positions / positions, 4) AS stock_out_risk_pct, round(100e0 * surplus_value / inventory_value, 4) AS surplus_share_pct FROM (
       SELECT store_name, count(*) AS positions, count(*) FILTER (health_status IN ('OUT_OF_STOCK', 'LOW_STOCK')) AS at_risk_positions, sum(inventory_value) AS inventory_value,
       coalesce(sum(inventory_value) FILTER (health_status IN ('OVERSTOCKED', 'DEAD_STOCK')), 0) AS surplus_value FROM d_stock GROUP BY 1)""")
oracle("replenishment_list",
       "store_name:s product_name:s quantity_on_hand:i reorder_level:i avg_daily_demand:f inbound_quantity:i suggested_order_qty:i",
       "SELECT * FROM d_stock WHERE quantity_on_hand <= reorder_level AND units_sold_90d > 0 ORDER BY avg_daily_demand DESC, store_id, product_id LIMIT 25")
oracle("stock_aging", "stock_age:s positions:i value_at_cost:f value_share_pct:f",
       """SELECT CASE WHEN a <= 30 THEN '0-30 days' WHEN a <= 90 THEN '31-90 days' WHEN a <= 180 THEN '91-180 days' WHEN a <= 365 THEN '181-365 days' ELSE 'over 365 days' END AS stock_age,
       count(*) AS positions, sum(v) AS value_at_cost, round(100e0 * sum(v) / sum(sum(v)) OVER (), 4) AS value_share_pct
       FROM (SELECT days_since_restock AS a, inventory_value AS v FROM d_stock WHERE quantity_on_hand > 0 AND days_since_restock IS NOT NULL) GROUP BY 1""")
oracle("coverage_bands", "cover:s positions:i value_at_cost:f position_share_pct:f",
       """SELECT CASE WHEN c <= 7 THEN 'under 7 days' WHEN c <= 30 THEN '7-29 days' WHEN c <= 90 THEN '30-89 days' WHEN c <= 180 THEN '90-179 days' ELSE '180+ days' END AS cover,
       count(*) AS positions, sum(v) AS value_at_cost, round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS position_share_pct
       FROM (SELECT days_of_cover AS c, inventory_value AS v FROM d_stock WHERE days_of_cover IS NOT NULL) GROUP BY 1""")
oracle("turnover_by_category", "category:s cogs_12m:f inventory_value:f inventory_turnover:f days_of_inventory:f",
       """SELECT category, c AS cogs_12m, v AS inventory_value, round(c / nullif(v, 0), 4) AS inventory_turnover, round(365 / nullif(c / nullif(v, 0), 0), 1) AS days_of_inventory FROM (
       SELECT category, round(sum(coalesce(inventory_turnover_12m, 0) * CAST(inventory_value AS DOUBLE)), 2) AS c, CAST(sum(inventory_value) AS DOUBLE) AS v FROM d_product GROUP BY 1)""")
oracle("product_classes", "product_class:s products:i inventory_value:f",
       "SELECT product_class, count(*) AS products, sum(inventory_value) AS inventory_value FROM d_product WHERE product_class IS NOT NULL GROUP BY 1")
oracle("top_products",
       "product_name:s category:s units_sold:i net_revenue:f gross_profit:f margin_pct:f return_rate_pct:f abc_class:s", "SELECT * FROM d_product ORDER BY net_revenue DESC, product_id LIMIT 10")
oracle("abc_summary", "abc_class:s products:i net_revenue:f product_share_pct:f revenue_share_pct:f",
       """SELECT abc_class, count(*) AS products, round(sum(net_revenue), 2) AS net_revenue, round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS product_share_pct,
       round(100e0 * round(sum(net_revenue), 2) / sum(round(sum(net_revenue), 2)) OVER (), 4) AS revenue_share_pct FROM d_product WHERE units_sold > 0 GROUP BY 1""")
oracle("product_concentration",
       "products_sold:i top_10_products_share_pct:f top_50_products_share_pct:f top_20pct_products_share_pct:f herfindahl_index:f",
       """SELECT count(*) AS products_sold, round(100e0 * sum(s) FILTER (k <= 10), 1) AS top_10_products_share_pct, round(100e0 * sum(s) FILTER (k <= 50), 1) AS top_50_products_share_pct,
       round(100e0 * sum(s) FILTER (k <= 0.2 * c), 1) AS top_20pct_products_share_pct, round(sum(s * s), 4) AS herfindahl_index FROM (SELECT net_revenue / sum(net_revenue) OVER () AS s,
       row_number() OVER (ORDER BY net_revenue DESC, product_id) AS k, count(*) OVER () AS c FROM d_product WHERE net_revenue > 0)""")
oracle("category_trends", "category_name:s rev_1998:f rev_1999:f rev_2000:f growth_1999_pct:f growth_2000_pct:f trend:s",
       """SELECT category_name, a AS rev_1998, b AS rev_1999, c AS rev_2000, round(100e0 * (b / a - 1), 4) AS growth_1999_pct, round(100e0 * (c / b - 1), 4) AS growth_2000_pct,
       CASE WHEN c < b AND b < a THEN 'Declining two years in a row' WHEN c < b THEN 'Declined in 2000' ELSE 'Growing / stable' END AS trend FROM (
       SELECT category_name, sum(net_revenue) FILTER (year = 1998) AS a, sum(net_revenue) FILTER (year = 1999) AS b, sum(net_revenue) FILTER (year = 2000) AS c FROM d_cat GROUP BY 1)""")
oracle("high_return_products",
       "product_name:s category:s units_sold:i units_returned:i return_rate_pct:f category_rate_pct:f times_category_rate:f",
       """SELECT product_name, category, units_sold, units_returned, return_rate_pct, round(c, 4) AS category_rate_pct, round(return_rate_pct / c, 4) AS times_category_rate FROM (
       SELECT *, 100e0 * sum(units_returned) OVER (PARTITION BY category) / sum(units_sold) OVER (PARTITION BY category) AS c FROM d_product WHERE units_sold > 0)
       WHERE units_sold >= 40 AND units_returned >= 8 AND return_rate_pct / c >= 1.5""")
oracle("return_reasons", "return_reason:s return_lines:i units:i refund_net:f share_pct:f",
       """SELECT return_reason, count(*) AS return_lines, sum(units_returned) AS units, round(sum(refund_net_of_gst), 2) AS refund_net,
       round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct FROM d_ret GROUP BY 1""")
oracle("revenue_trend_frame", "month:d net_revenue:f moving_avg_3m:f is_peak:b",
       """SELECT month, net_revenue, CASE WHEN count(*) OVER w = 3 THEN round(avg(net_revenue) OVER w, 2) END AS moving_avg_3m, net_revenue = max(net_revenue) OVER () AS is_peak
       FROM d_month WINDOW w AS (ORDER BY month ROWS 2 PRECEDING)""")
oracle("top_products_frame", "product_name:s net_revenue:f revenue_share_pct:f",
       """SELECT product_name, net_revenue, round(100e0 * net_revenue / (SELECT sum(net_revenue) FROM d_product), 4) AS revenue_share_pct FROM d_product
       ORDER BY net_revenue DESC, product_id LIMIT 10""")
oracle("store_revenue_frame", "store_name:s net_revenue:f", "SELECT store_name, net_revenue FROM d_store")
oracle("return_rate_frame", "category_name:s units_sold:i units_returned:i unit_return_rate_pct:f",
       """SELECT coalesce(category_name, '(overall)') AS category_name, sum(units_sold) AS units_sold, sum(units_returned) AS units_returned,
       round(100e0 * sum(units_returned) / sum(units_sold), 4) AS unit_return_rate_pct FROM d_cat GROUP BY ROLLUP (category_name)""")
oracle("order_value_histogram", "bin:i orders:i smallest:f largest:f",
       """SELECT k AS bin, count(*) AS orders, round(min(v), 2) AS smallest, round(max(v), 2) AS largest FROM (
       SELECT v, least(floor((log10(v) - log10(min(v) OVER ())) / (log10(max(v) OVER ()) - log10(min(v) OVER ())) * 60) + 1, 60) AS k
       FROM (SELECT CAST(total AS DOUBLE) AS v FROM m_done WHERE total > 0)) GROUP BY k""")
oracle("product_change_frame", "product_id:i product_name:s rev_1999:f rev_2000:f change:f",
       """SELECT product_id, product_name, round(a, 2) AS rev_1999, round(b, 2) AS rev_2000, round(b - a, 2) AS change FROM (
       SELECT product_id, product_name, coalesce(sum(net) FILTER (yr = 1999), 0) AS a, coalesce(sum(net) FILTER (yr = 2000), 0) AS b FROM d_line
       WHERE category_name = 'LARGE' GROUP BY 1, 2) ORDER BY round(b - a, 2), product_id LIMIT 10""")
COLUMNS = ("customer_id customer_name email city state segment registration_date is_active orders net_revenue gross_profit avg_order_value first_order_date last_order_date cohort_month"
           " recency_days r_score f_score m_score is_repeat_customer active_span_days activity_status rfm_segment").split()
oracle("customer_null_profile", "column_name:s null_count:i null_pct:f", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, round(100e0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct FROM d_customer" for c in COLUMNS))

# ---- measure layer
L = "sum(net) AS net_revenue, sum(profit) AS gross_profit, sum(cogs) AS cogs, sum(qty) AS units_sold, sum(disc) AS discount_given, count(DISTINCT order_id) AS orders_line_basis"
O = """count(*) FILTER (status = 'COMPLETED') AS completed_orders, count(*) FILTER (status = 'CANCELLED') AS cancelled_orders, count(*) AS all_orders,
 sum(total) FILTER (status = 'COMPLETED') AS order_sales_incl_gst, count(DISTINCT customer_id) FILTER (status = 'COMPLETED') AS total_customers,
 count(*) FILTER (status = 'COMPLETED' AND channel = 'ONLINE') AS online_orders, count(*) FILTER (status = 'COMPLETED' AND back) AS orders_with_returns"""
R = "sum(units_returned) AS units_returned, sum(refund_net_of_gst) AS refunded_net_of_gst, sum(cost_value) FILTER (NOT restocked) AS write_off_cost"
S = """sum(inventory_value) AS inventory_value, sum(quantity_on_hand) AS units_on_hand, count(*) AS stock_positions, count(*) FILTER (health_status = 'OUT_OF_STOCK') AS out_of_stock_positions,
 count(*) FILTER (health_status = 'LOW_STOCK') AS low_stock_positions, count(*) FILTER (health_status = 'HEALTHY') AS healthy_positions,
 count(*) FILTER (health_status = 'OVERSTOCKED') AS overstocked_positions, count(*) FILTER (health_status = 'DEAD_STOCK') AS dead_stock_positions,
 sum(inventory_value) FILTER (health_status = 'OVERSTOCKED') AS overstock_value, sum(inventory_value) FILTER (health_status = 'DEAD_STOCK') AS dead_stock_value,
 sum(suggested_order_qty) FILTER (health_status IN ('OUT_OF_STOCK', 'LOW_STOCK')) AS suggested_order_qty"""
C = """count(*) FILTER (orders > 0) AS buying_customers, count(*) FILTER (orders > 1) AS repeat_customers, sum(net_revenue) AS lifetime_revenue,
 count(*) FILTER (activity_status = 'Active (last 90 days)') AS active_customers_90d"""
P = "count(*) FILTER (abc_class = 'A') AS class_a_products, sum(net_revenue) FILTER (abc_class = 'A') / sum(net_revenue) AS class_a_revenue_share"
MONEY = "net_revenue gross_profit cogs discount_given average_order_value avg_customer_lifetime_revenue refunded_net_of_gst refunded_net_of_gst_by_return_date write_off_cost inventory_value days_of_inventory".split()
RATIOS = "gross_margin_pct cancellation_rate purchase_frequency online_order_share repeat_customer_rate order_return_rate"\
         " unit_return_rate refund_pct_of_net_revenue surplus_share_of_value stock_out_risk_pct inventory_turnover class_a_revenue_share"
ROUNDED = ", ".join([f"round(CAST({c} AS DOUBLE), 2) AS {c}" for c in MONEY] + [f"round({c}, 6) AS {c}" for c in RATIOS.split()])
oracle("measures_total",
       "net_revenue:f gross_profit:f cogs:f gross_margin_pct:f units_sold:i discount_given:f orders_line_basis:i completed_orders:i cancelled_orders:i cancellation_rate:f"
       " order_sales_incl_gst:f average_order_value:f total_customers:i purchase_frequency:f online_order_share:f buying_customers:i repeat_customers:i repeat_customer_rate:f"
       " avg_customer_lifetime_revenue:f active_customers_90d:i new_customers:i returning_customers:i orders_with_returns:i order_return_rate:f units_returned:i unit_return_rate:f"
       " refunded_net_of_gst:f refund_pct_of_net_revenue:f refunded_net_of_gst_by_return_date:f write_off_cost:f inventory_value:f units_on_hand:i stock_positions:i"
       " out_of_stock_positions:i low_stock_positions:i healthy_positions:i overstocked_positions:i dead_stock_positions:i overstock_value:f dead_stock_value:f surplus_share_of_value:f"
       " stock_out_risk_pct:f suggested_order_qty:i cogs_last_12m:f inventory_turnover:f days_of_inventory:f class_a_products:i class_a_revenue_share:f period_label:s",
       f"""SELECT * REPLACE ({ROUNDED}) FROM (SELECT *, gross_profit / net_revenue AS gross_margin_pct, CAST(cancelled_orders AS DOUBLE) / all_orders AS cancellation_rate,
       CAST(order_sales_incl_gst AS DOUBLE) / completed_orders AS average_order_value, CAST(completed_orders AS DOUBLE) / total_customers AS purchase_frequency,
       CAST(online_orders AS DOUBLE) / completed_orders AS online_order_share, CAST(repeat_customers AS DOUBLE) / buying_customers AS repeat_customer_rate,
       CAST(lifetime_revenue AS DOUBLE) / buying_customers AS avg_customer_lifetime_revenue, greatest(total_customers - new_customers, 0) AS returning_customers,
       CAST(orders_with_returns AS DOUBLE) / completed_orders AS order_return_rate, CAST(units_returned AS DOUBLE) / units_sold AS unit_return_rate,
       refunded_net_of_gst / net_revenue AS refund_pct_of_net_revenue, refunded_net_of_gst AS refunded_net_of_gst_by_return_date,
       CAST(coalesce(overstock_value, 0) + coalesce(dead_stock_value, 0) AS DOUBLE) / CAST(inventory_value AS DOUBLE) AS surplus_share_of_value,
       CAST(out_of_stock_positions + low_stock_positions AS DOUBLE) / stock_positions AS stock_out_risk_pct, CAST(cogs_last_12m AS DOUBLE) / CAST(inventory_value AS DOUBLE) AS inventory_turnover,
       365 / (CAST(cogs_last_12m AS DOUBLE) / CAST(inventory_value AS DOUBLE)) AS days_of_inventory, strftime(f, '%-d %b %Y') || ' to ' || strftime(d, '%-d %b %Y') AS period_label
       FROM (SELECT {L} FROM m_sl), (SELECT {O} FROM d_ord), (SELECT {R} FROM d_ret), (SELECT {S} FROM d_stock), (SELECT {C} FROM d_customer), (SELECT {P} FROM d_product),
       (SELECT count(*) AS new_customers FROM d_customer WHERE cohort_month IS NOT NULL), (SELECT sum(cogs) AS cogs_last_12m FROM m_sl, m_asof WHERE day > d - INTERVAL 12 MONTH), m_asof)""")
oracle("measures_by_month",
       "month:d net_revenue:f net_revenue_py:f net_revenue_yoy_pct:f net_revenue_pm:f net_revenue_mom_pct:f net_revenue_3m_avg:f net_revenue_running_total:f new_customers:i"
       " returning_customers:i refunded_net_of_gst:f refunded_net_of_gst_by_return_date:f",
       """SELECT k0.month, round(t.n, 2) AS net_revenue, round(p, 2) AS net_revenue_py, round(t.n / p - 1, 6) AS net_revenue_yoy_pct, round(q, 2) AS net_revenue_pm,
       round(t.n / q - 1, 6) AS net_revenue_mom_pct, round(a, 2) AS net_revenue_3m_avg, round(r, 2) AS net_revenue_running_total, c.k AS new_customers,
       greatest(coalesce(o.k, 0) - coalesce(c.k, 0), 0) AS returning_customers, round(b.v, 2) AS refunded_net_of_gst, round(e.v, 2) AS refunded_net_of_gst_by_return_date
       FROM (SELECT month FROM m_so UNION SELECT return_month FROM d_ret) k0
       LEFT JOIN (SELECT month, n, lag(n, 12) OVER w AS p, lag(n) OVER w AS q, sum(n) OVER (ORDER BY month ROWS 2 PRECEDING) / 3 AS a, sum(n) OVER w AS r
        FROM (SELECT c.month, sum(l.net) AS n FROM (SELECT DISTINCT CAST(date_trunc('month', m_cal.d) AS DATE) AS month FROM m_cal, m_asof WHERE m_cal.d <= m_asof.d) c
         LEFT JOIN m_sl l ON l.month = c.month GROUP BY 1) WINDOW w AS (ORDER BY month)) t ON t.month = k0.month
       LEFT JOIN (SELECT month, count(DISTINCT customer_id) AS k FROM m_done GROUP BY 1) o ON o.month = k0.month
       LEFT JOIN (SELECT cohort_month AS month, count(*) AS k FROM d_customer GROUP BY 1) c ON c.month = k0.month
       LEFT JOIN (SELECT date_trunc('month', order_day) AS month, sum(refund_net_of_gst) AS v FROM d_ret GROUP BY 1) b ON b.month = k0.month
       LEFT JOIN (SELECT return_month AS month, sum(refund_net_of_gst) AS v FROM d_ret GROUP BY 1) e ON e.month = k0.month""")
oracle("measures_by_category",
       "category:s net_revenue:f gross_margin_pct:f units_sold:i orders_line_basis:i completed_orders:i units_returned:i unit_return_rate:f inventory_value:f inventory_turnover:f"
       " class_a_products:i",
       """SELECT l.category, round(l.n, 2) AS net_revenue, round(l.p / l.n, 6) AS gross_margin_pct, l.u AS units_sold, l.o AS orders_line_basis, (SELECT count(*) FROM m_done) AS completed_orders,
       r.u AS units_returned, round(CAST(r.u AS DOUBLE) / l.u, 6) AS unit_return_rate, round(s.v, 2) AS inventory_value, round(CAST(l.c AS DOUBLE) / CAST(s.v AS DOUBLE), 6) AS inventory_turnover,
       k.a AS class_a_products FROM (SELECT category_name AS category, sum(net) AS n, sum(profit) AS p, sum(qty) AS u, count(DISTINCT order_id) AS o,
        sum(cogs) FILTER (day > d - INTERVAL 12 MONTH) AS c FROM d_line, m_asof GROUP BY 1) l
       LEFT JOIN (SELECT category, sum(units_returned) AS u FROM d_ret GROUP BY 1) r ON r.category = l.category
       LEFT JOIN (SELECT category, sum(inventory_value) AS v FROM d_stock GROUP BY 1) s ON s.category = l.category
       LEFT JOIN (SELECT category, count(*) FILTER (abc_class = 'A') AS a FROM d_product GROUP BY 1) k ON k.category = l.category""")
oracle("measures_sliced",
       "region:s channel:s net_revenue:f completed_orders:i average_order_value:f order_return_rate:f unit_return_rate:f stock_positions:i",
       """SELECT o.region, o.channel, round(l.n, 2) AS net_revenue, o.c AS completed_orders, round(o.a, 2) AS average_order_value, round(o.b, 6) AS order_return_rate,
       round(CAST(r.u AS DOUBLE) / l.u, 6) AS unit_return_rate, s.n AS stock_positions
       FROM (SELECT region, channel, count(*) AS c, CAST(sum(total) AS DOUBLE) / count(*) AS a, CAST(count(*) FILTER (back) AS DOUBLE) / count(*) AS b FROM d_ord
        WHERE status = 'COMPLETED' AND yr IN (1999, 2000) GROUP BY 1, 2) o
       LEFT JOIN (SELECT s.region, l.channel, sum(l.net) AS n, sum(l.qty) AS u FROM m_sl l JOIN m_st s ON s.store_id = l.store_id WHERE l.yr IN (1999, 2000) GROUP BY 1, 2) l
        ON l.region = o.region AND l.channel = o.channel
       LEFT JOIN (SELECT region, channel, sum(units_returned) AS u FROM d_ret WHERE yr IN (1999, 2000) GROUP BY 1, 2) r ON r.region = o.region AND r.channel = o.channel
       LEFT JOIN (SELECT t.region, count(*) AS n FROM d_stock d JOIN m_st t ON t.store_id = d.store_id GROUP BY 1) s ON s.region = o.region""")
YEARROW = [("Net Revenue", "n"), ("Gross Profit", "p"), ("Gross Margin %", "100 * p / n"), ("Units Sold", "u"), ("Discount Given", "d"), ("Completed Orders", "c"),
           ("Cancelled Orders", "x"), ("Total Customers", "k"), ("Average Order Value", "CAST(t AS DOUBLE) / c"), ("Order Return Rate %", "100e0 * b / c"),
           ("Net Revenue YoY %", "100 * (n / q - 1)")]
PER_YEAR = """(SELECT l.*, o.*, lag(n) OVER (ORDER BY l.year) AS q FROM (SELECT yr AS year, sum(net) AS n, sum(profit) AS p, sum(qty) AS u, sum(disc) AS d FROM m_sl GROUP BY 1) l
 JOIN (SELECT yr, count(*) FILTER (status = 'COMPLETED') AS c, count(*) FILTER (status = 'CANCELLED') AS x, count(DISTINCT customer_id) FILTER (status = 'COMPLETED') AS k,
  sum(total) FILTER (status = 'COMPLETED') AS t, count(*) FILTER (status = 'COMPLETED' AND back) AS b FROM x_flag GROUP BY 1) o ON o.yr = l.year)"""
oracle("expected_kpis_by_year", "year:i measure:s value:f", " UNION ALL ".join(
    f"SELECT year, '{m}' AS measure, round(CAST({e} AS DOUBLE) + 1e-9, 2) AS value FROM {PER_YEAR}" for m, e in YEARROW))
ALL = [("Net Revenue", "net_revenue"), ("Gross Profit", "gross_profit"), ("COGS", "cogs"), ("Gross Margin %", "100 * gross_profit / net_revenue"), ("Units Sold", "units_sold"),
       ("Discount Given", "discount_given"), ("Orders (line basis)", "orders_line_basis"), ("Completed Orders", "completed_orders"), ("Cancelled Orders", "cancelled_orders"),
       ("Cancellation Rate %", "100e0 * cancelled_orders / all_orders"), ("Order Sales incl GST", "order_sales_incl_gst"),
       ("Average Order Value", "CAST(order_sales_incl_gst AS DOUBLE) / completed_orders"), ("Total Customers", "total_customers"),
       ("Purchase Frequency", "CAST(completed_orders AS DOUBLE) / total_customers"), ("Online Order Share %", "100e0 * online_orders / completed_orders"),
       ("Buying Customers (lifetime)", "buying_customers"), ("Repeat Customers", "repeat_customers"), ("Repeat Customer Rate %", "100e0 * repeat_customers / buying_customers"),
       ("Avg Customer Lifetime Revenue", "CAST(lifetime_revenue AS DOUBLE) / buying_customers"), ("Active Customers (90d)", "active_customers_90d"),
       ("Orders With Returns", "orders_with_returns"), ("Order Return Rate %", "100e0 * orders_with_returns / completed_orders"), ("Units Returned", "units_returned"),
       ("Unit Return Rate %", "100e0 * units_returned / units_sold"), ("Refunded Net of GST", "refunded_net_of_gst"), ("Refund % of Net Revenue", "100 * refunded_net_of_gst / net_revenue"),
       ("Write-off Cost", "write_off_cost"), ("Inventory Value", "inventory_value"), ("Units On Hand", "units_on_hand"), ("Stock Positions", "stock_positions"),
       ("Out of Stock Positions", "out_of_stock_positions"), ("Low Stock Positions", "low_stock_positions"), ("Healthy Positions", "healthy_positions"),
       ("Overstocked Positions", "overstocked_positions"), ("Dead Stock Positions", "dead_stock_positions"), ("Overstock Value", "overstock_value"),
       ("Dead Stock Value", "dead_stock_value"), ("Surplus Share of Value %", "100 * CAST(overstock_value + dead_stock_value AS DOUBLE) / CAST(inventory_value AS DOUBLE)"),
       ("Stock-out Risk %", "100e0 * (out_of_stock_positions + low_stock_positions) / stock_positions"), ("Suggested Order Qty", "suggested_order_qty"), ("COGS Last 12M", "c365"),
       ("Inventory Turnover", "CAST(c365 AS DOUBLE) / CAST(inventory_value AS DOUBLE)"), ("Days of Inventory", "365 * CAST(inventory_value AS DOUBLE) / CAST(c365 AS DOUBLE)"),
       ("Class A Products", "class_a_products"), ("Class A Revenue Share %", "100 * class_a_revenue_share")]
ONE = f"""(SELECT * FROM (SELECT {L} FROM m_sl), (SELECT {O} FROM d_ord), (SELECT {R} FROM d_ret), (SELECT {S} FROM d_stock), (SELECT {C} FROM d_customer), (SELECT {P} FROM d_product),
 (SELECT sum(cogs) AS c365 FROM m_sl, m_asof WHERE day > d - 365))"""
oracle("expected_kpis_all_data", "measure:s value:f",
       f"""SELECT unnest([{', '.join(f"'{m}'" for m, _ in ALL)}]) AS measure, unnest([{', '.join(f'round(CAST({e} AS DOUBLE) + 1e-9, 2)' for _, e in ALL)}]) AS value FROM {ONE}""")

# ---- integrity rules that can be counted without a line key
RULES = {
    "line total = quantity x price - discount": "SELECT count(*) FROM m_it WHERE abs(CAST(line_total - (qty * price - disc) AS DOUBLE)) > 0.01",
    "order has a line": "SELECT count(*) FROM m_so ANTI JOIN m_it USING (order_id)",
    "gst within total": "SELECT count(*) FROM m_so WHERE gst > total",
    "order after registration": "SELECT count(*) FROM m_so JOIN m_cu USING (customer_id) WHERE day < registration_date",
    "order after store opening": "SELECT count(*) FROM m_so JOIN m_st USING (store_id) WHERE day < opened_date",
    "employee works in the store": "SELECT count(*) FROM m_so o JOIN m_em e USING (employee_id) WHERE e.store_id <> o.store_id",
    "online orders use the hub": "SELECT count(*) FROM m_so JOIN m_st USING (store_id) WHERE (channel = 'ONLINE') <> (store_type = 'ONLINE_WAREHOUSE')",
    "promotion on an eligible product": "SELECT count(*) FROM m_it WHERE promotion_id IS NOT NULL AND product_id % 11 <> promotion_id - 5",
    "promotion inside its window": "SELECT count(*) FROM m_it i JOIN m_so o USING (order_id) JOIN m_promo p USING (promotion_id) WHERE o.day NOT BETWEEN p.a AND p.z",
    "payments = order total": "SELECT count(*) FROM m_so o JOIN m_pay p USING (order_id) WHERE p.status = 'SUCCESS' AND abs(o.total - p.amount) > 0.01",
    "cancelled orders are refunded": "SELECT count(*) FROM m_so o JOIN m_pay p USING (order_id) WHERE o.status = 'CANCELLED' AND p.status <> 'REFUNDED'",
    "completed orders are not refunded": "SELECT count(*) FROM m_so o JOIN m_pay p USING (order_id) WHERE o.status = 'COMPLETED' AND p.status = 'REFUNDED'",
    "cash only in store": "SELECT count(*) FROM m_so o JOIN m_pay p USING (order_id) WHERE p.method = 'CASH' AND o.channel = 'ONLINE'",
    "returns on completed orders, after the order": "SELECT count(*) FROM m_rl r JOIN m_so o USING (order_id) WHERE o.status <> 'COMPLETED' OR r.ship <= o.ts",
    "ledger = stock on hand": """SELECT count(*) FROM m_inv v LEFT JOIN (SELECT store_id, product_id, sum(change) AS b FROM m_ledger GROUP BY 1, 2) l USING (store_id, product_id)
      WHERE v.on_hand <> coalesce(l.b, 0)""",
    "ledger row has a position": "SELECT count(*) FROM m_ledger ANTI JOIN m_inv USING (store_id, product_id)",
    "reserved <= on hand": "SELECT count(*) FROM m_inv WHERE reserved > on_hand",
    "purchase total = sum of items": """SELECT count(*) FROM m_po p JOIN (SELECT purchase_id, sum(ordered * cost) AS s FROM m_poi GROUP BY 1) i USING (purchase_id)
      WHERE abs(CAST(p.total - i.s AS DOUBLE)) > 0.05""",
    "received status has a received date": "SELECT count(*) FROM m_po WHERE (status = 'RECEIVED') <> (got IS NOT NULL)",
    "ordered lines received nothing": "SELECT count(*) FROM m_poi i JOIN m_po p USING (purchase_id) WHERE p.status = 'ORDERED' AND i.received <> 0",
    "order header = sum of lines": """SELECT count(*) FROM (SELECT *, total - gst + disc AS sub FROM m_so) o
      JOIN (SELECT order_id, sum(qty * price) AS g, sum(disc) AS d, sum(line_total) AS n FROM m_it GROUP BY 1) i USING (order_id)
      WHERE abs(CAST(o.sub - i.g AS DOUBLE)) > 0.05 OR abs(CAST(o.disc - i.d AS DOUBLE)) > 0.05 OR abs(CAST(o.total - i.n AS DOUBLE)) > 0.05
       OR abs(CAST(o.total - (o.sub - o.disc) AS DOUBLE)) > 0.05""",
    "online orders have no employee": "SELECT count(*) FROM m_so WHERE channel = 'ONLINE' AND employee_id IS NOT NULL",
    "price without tax above cost": "SELECT count(*) FROM m_it SEMI JOIN m_pr USING (product_id) WHERE CAST(price AS DOUBLE) / (1 + CAST(tax AS DOUBLE) / 100) <= CAST(cost AS DOUBLE)",
    "sale movement refers to an order": "SELECT count(*) FROM (SELECT ref AS order_id FROM m_ledger WHERE kind = 'SALE') ANTI JOIN m_so USING (order_id)",
    "cancelled orders move no stock": "SELECT count(*) FROM m_ledger l JOIN m_so o ON o.order_id = l.ref WHERE l.kind = 'SALE' AND o.status = 'CANCELLED'",
    "calendar covers all order days": "SELECT count(DISTINCT day) FROM m_so WHERE day NOT IN (SELECT d FROM m_cal)",
    "line refers to a product": "SELECT count(*) FROM m_it ANTI JOIN m_pr USING (product_id)",
    "order refers to a customer": "SELECT count(*) FROM m_so ANTI JOIN m_cu USING (customer_id)",
    "received units = purchase movements": """SELECT abs((SELECT sum(received) FROM m_poi) - (SELECT sum(change) FROM m_ledger WHERE kind = 'PURCHASE'))""",
    "sold units = sale movements": """SELECT abs((SELECT sum(qty) FROM m_sl) + (SELECT sum(change) FROM m_ledger WHERE kind = 'SALE'))""",
}
oracle("integrity_counts", "rule:s violations:i", " UNION ALL ".join(f"SELECT '{r}' AS rule, ({q}) AS violations" for r, q in RULES.items()))

# ---- validation of the datasets and of the load
def close(a: str, b: str, limit: int = 5) -> str:
    return f"abs(CAST(({a}) AS DOUBLE) - CAST(({b}) AS DOUBLE)) <= {limit}"


def total(c: str, t: str) -> str:
    return f"SELECT sum({c}) FROM {t}"


def none(t: str, p: str) -> str:
    return f"(SELECT count(*) FROM {t} WHERE {p}) = 0"


VIEWS = {"vw_monthly_sales": "d_month", "vw_product_performance": "d_product", "vw_customer_summary": "d_customer", "vw_inventory_health": "d_stock",
         "vw_store_performance": "d_store", "vw_category_performance": "d_cat", "vw_supplier_performance": "d_sup", "vw_return_analysis": "d_ret"}
FIVE = "('OUT_OF_STOCK', 'LOW_STOCK', 'HEALTHY', 'OVERSTOCKED', 'DEAD_STOCK')"
DATASET_CHECKS = [(f"{v}: non-empty with expected columns", f"(SELECT count(*) FROM {t}) > 0") for v, t in VIEWS.items()] + [
    ("customer_id is unique in vw_customer_summary", "(SELECT count(*) = count(DISTINCT customer_id) FROM d_customer)"),
    ("product_id is unique in vw_product_performance", "(SELECT count(*) = count(DISTINCT product_id) FROM d_product)"),
    ("(store_id, product_id) is unique in vw_inventory_health", "(SELECT count(*) = count(DISTINCT (store_id, product_id)) FROM d_stock)"),
    ("80 distinct months in vw_monthly_sales", "(SELECT count(DISTINCT month) = 80 FROM d_month)"),
    ("no negative revenue, units or stock", f"{none('d_month', 'net_revenue < 0')} AND {none('d_product', 'units_sold < 0')} AND {none('d_stock', 'quantity_on_hand < 0')}"),
    ("percentages are within 0-100 where they must be",
     f"{none('d_product', 'return_rate_pct NOT BETWEEN 0 AND 100')} AND {none('d_store', 'return_rate_pct NOT BETWEEN 0 AND 100 OR repeat_customer_rate_pct NOT BETWEEN 0 AND 100')}"),
    ("gross margin is below 100 % everywhere", none("d_product", "margin_pct >= 100")),
    ("reserved stock never exceeds stock on hand", none("d_stock", "reserved_quantity > quantity_on_hand")),
    ("inventory health statuses are the five defined classes", none("d_stock", f"health_status NOT IN {FIVE}")),
    ("RFM segments are the five defined labels", "(SELECT count(DISTINCT rfm_segment) = 5 FROM d_customer)"),
    ("category names are canonical (no case-variant duplicates)", "(SELECT count(DISTINCT category_name) = count(DISTINCT lower(category_name)) FROM d_cat)"),
    ("net revenue: monthly view = product view", close(total("net_revenue", "d_month"), total("net_revenue", "d_product"))),
    ("net revenue: monthly view = store view", close(total("net_revenue", "d_month"), total("net_revenue", "d_store"))),
    ("net revenue: monthly view = category view", close(total("net_revenue", "d_month"), total("net_revenue", "d_cat"))),
    ("net revenue: monthly view = customer view", close(total("net_revenue", "d_month"), total("net_revenue", "d_customer"))),
    ("gross profit: monthly view = product view", close(total("gross_profit", "d_month"), total("gross_profit", "d_product"))),
    ("inventory value: health view = product view = store view",
     f"{close(total('inventory_value', 'd_stock'), total('inventory_value', 'd_product'))} AND {close(total('inventory_value', 'd_stock'), total('inventory_value', 'd_store'))}"),
    ("units sold: monthly view = product view", f"({total('units_sold', 'd_month')}) = ({total('units_sold', 'd_product')})"),
    ("completed orders: monthly view = store view = customer view",
     f"({total('orders', 'd_month')}) = ({total('orders', 'd_store')}) AND ({total('orders', 'd_store')}) = ({total('orders', 'd_customer')})"),
    ("net revenue: views = base table sales_orders", close(total("net_revenue", "d_month"), total("net", "m_done"))),
    ("orders: views = base table sales_orders", f"({total('orders', 'd_month')}) = (SELECT count(*) FROM m_done)"),
    ("refund value: return view = returns table", close(total("refund_amount", "d_ret"), total("refund", "m_rl"), 1)),
]
oracle("validation_checks", "check_name:s passed:b", " UNION ALL ".join(f"SELECT '{n}' AS check_name, {e} AS passed" for n, e in DATASET_CHECKS))
LOADED = {"customers": ("m_cu", 5000), "products": ("m_pr", 500), "categories": ("m_cat", 15), "suppliers": ("m_su", 50), "stores": ("m_st", 10), "employees": ("m_em", 50),
          "sales_orders": ("m_so", 50000), "sales_order_items": ("m_it", 100000), "payments": ("m_pay", 50000), "inventory": ("m_inv", 5000),
          "inventory_transactions": ("m_ledger", 50000), "purchases": ("m_po", 5000), "returns": ("m_rl", 2000), "promotions": ("m_promo", 20)}
oracle("load_report", "rule:s passed:b detail:f", " UNION ALL ".join(
    [f"SELECT '{n} has at least {k} rows' AS rule, count(*) >= {k} AS passed, count(*) AS detail FROM {t}" for n, (t, k) in LOADED.items()]
    + ["SELECT 'window of 6 to 7 years', (d - f) / 365.25 BETWEEN 6 AND 7, round((d - f) / 365.25, 2) FROM m_asof"]))

# ---- sources
oracle("calendar_window",
       "date_key:d year:i quarter:i month:i month_name:s year_month:s week_of_year:i day_of_month:i day_of_week:i day_name:s is_weekend:b",
       """SELECT c.d AS date_key, year(c.d) AS year, quarter(c.d) AS quarter, month(c.d) AS month, monthname(c.d) AS month_name, strftime(c.d, '%Y-%m') AS year_month, weekofyear(c.d) AS week_of_year,
       day(c.d) AS day_of_month, isodow(c.d) AS day_of_week, dayname(c.d) AS day_name, isodow(c.d) > 5 AS is_weekend FROM m_cal c, m_asof a WHERE c.d BETWEEN a.f AND a.d""")
oracle("row_rule_violations", "table_name:s rule:s rows:i",
       """SELECT * FROM (SELECT 'stores' AS table_name, 'region in (''North'', ''South'', ''East'', ''West'', ''Central'')' AS rule,
        (SELECT count(*) FROM m_st WHERE region NOT IN ('North', 'South', 'East', 'West', 'Central')) AS rows
       UNION ALL SELECT 'sales_order_items', 'duplicate order_id product_id', (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM m_it GROUP BY order_id, product_id) WHERE n > 1)
       UNION ALL SELECT 'purchase_items', 'duplicate purchase_id product_id', (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM m_it GROUP BY order_id, product_id) WHERE n > 1)
       UNION ALL SELECT 'sales_orders', 'employee_id has no parent in employees', (SELECT count(*) FROM m_so WHERE employee_id NOT IN (SELECT employee_id FROM m_em))
       UNION ALL SELECT 'sales_order_items', 'promotion_id has no parent in promotions', (SELECT count(*) FROM m_it WHERE promotion_id NOT BETWEEN 5 AND 10)
       UNION ALL SELECT 'inventory_transactions', 'quantity_change <> 0', (SELECT count(*) FROM m_ledger WHERE change = 0)) WHERE rows > 0""")
