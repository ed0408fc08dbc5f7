from . import model_sql  # noqa: F401
from .compose import oracle

oracle("q01_table_sizes", "table_name:s row_count:i", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, t in [
        ("customers", "m_cu"), ("products", "m_pr"), ("sales_orders", "m_so"), ("sales_order_items", "m_it"), ("payments", "m_pay"),
        ("returns", "m_rl"), ("inventory", "m_inv"), ("inventory_transactions", "m_ledger"), ("purchases", "m_po")]))
oracle("q02_order_totals", "total_orders:i completed_orders:i cancelled_orders:i cancellation_rate_pct:f",
       """SELECT n AS total_orders, n - c AS completed_orders, c AS cancelled_orders, round(100e0 * c / n, 2) AS cancellation_rate_pct
       FROM (SELECT count(*) AS n, sum((status = 'CANCELLED')::INT) AS c FROM m_so)""")
oracle("q03_sales_totals", "gross_sales_incl_gst:f gst_collected:f net_revenue:f discounts_given:f",
       "SELECT sum(total) AS gross_sales_incl_gst, sum(gst) AS gst_collected, sum(net) AS net_revenue, sum(disc) AS discounts_given FROM m_done")
oracle("q04_gross_profit", "net_revenue:f cost_of_goods_sold:f gross_profit:f gross_margin_pct:f",
       """SELECT round(sum(net), 2) AS net_revenue, round(sum(cogs), 2) AS cost_of_goods_sold, round(sum(profit), 2) AS gross_profit,
       round(100e0 * sum(profit) / sum(net), 2) AS gross_margin_pct FROM m_sl""")
oracle("q05_order_value", "avg_order_value:f median_order_value:f largest_order:f",
       """SELECT round(CAST(sum(total) AS DOUBLE) / count(*) + 1e-7, 2) AS avg_order_value, round(quantile_cont(CAST(total AS DOUBLE), 0.5), 2) AS median_order_value,
       max(total) AS largest_order FROM m_done""")
oracle("q06_customer_counts", "total_customers:i customers_who_purchased:i customers_never_purchased:i flagged_active:i",
       """SELECT count(*) AS total_customers, count(*) FILTER (b) AS customers_who_purchased, count(*) FILTER (NOT b) AS customers_never_purchased,
       count(*) FILTER (is_active) AS flagged_active FROM (SELECT is_active, customer_id IN (SELECT customer_id FROM m_done) AS b FROM m_cu)""")
oracle("q07_channels", "channel:s orders:i net_revenue:f revenue_share_pct:f",
       """SELECT channel, count(*) AS orders, sum(net) AS net_revenue, round(100e0 * sum(net) / (SELECT sum(net) FROM m_done), 2) AS revenue_share_pct
       FROM m_done GROUP BY channel""")
oracle("q08_products_per_category", "category:s products:i active_products:i",
       """SELECT coalesce(c.category_name, '(no category)') AS category, count(*) AS products, count(*) FILTER (p.is_active) AS active_products
       FROM m_pr p LEFT JOIN m_cat c ON c.category_id = p.category_id GROUP BY ALL""")
oracle("q09_store_directory", "store_code:s store_name:s city:s state:s region:s store_type:s opened_date:d years_open:f",
       "SELECT *, round((d - opened_date) / 365.25e0, 1) AS years_open FROM m_st, m_asof")
oracle("q10_price_bands", "price_band:s products:i avg_list_margin_pct:f",
       """SELECT band AS price_band, count(*) AS products, round(avg(100e0 * (np - unit_cost) / np), 1) AS avg_list_margin_pct FROM (
       SELECT CASE WHEN unit_price < 500 THEN 'a) Under 500' WHEN unit_price < 2000 THEN 'b) 500 - 1,999' WHEN unit_price < 10000 THEN 'c) 2,000 - 9,999'
       ELSE 'd) 10,000 and above' END AS band, CAST(unit_price AS DOUBLE) / (1 + gst_rate / 100e0) AS np, CAST(unit_cost AS DOUBLE) AS unit_cost FROM m_pr) GROUP BY band""")
oracle("q11_weekdays", "iso_day:i day_name:s orders:i avg_order_value:f",
       """SELECT isodow(day) AS iso_day, dayname(day) AS day_name, count(*) AS orders, round(CAST(sum(total) AS DOUBLE) / count(*) + 1e-7, 2) AS avg_order_value
       FROM m_done GROUP BY isodow(day), dayname(day)""")
oracle("q12_data_window", "first_order:d last_order:d days_covered:i span:s",
       """SELECT f AS first_order, d AS last_order, d - f AS days_covered, (k // 12) || ' years ' || (k % 12) || ' mons ' ||
       (d - CAST(f + to_months(CAST(k AS INTEGER)) AS DATE)) || ' days' AS span FROM (SELECT *, datesub('month', f, d) AS k FROM m_asof)""")

# ---- sales
oracle("q13_monthly_trend", "month:d orders:i net_revenue:f avg_order_value:f",
       """SELECT month, count(*) AS orders, sum(net) AS net_revenue, round(CAST(sum(total) AS DOUBLE) / count(*) + 1e-7, 2) AS avg_order_value FROM m_done GROUP BY month""")
oracle("q14_yearly_growth", "yr:i orders:i net_revenue:f previous_year_revenue:f yoy_growth_pct:f",
       """SELECT y.yr, y.n AS orders, round(y.net, 0) AS net_revenue, round(b.net, 0) AS previous_year_revenue,
       round(100e0 * (CAST(y.net AS DOUBLE) / CAST(b.net AS DOUBLE) - 1), 2) AS yoy_growth_pct
       FROM (SELECT yr, count(*) AS n, sum(net) AS net FROM m_done GROUP BY yr) y
       LEFT JOIN (SELECT yr + 1 AS yr, sum(net) AS net FROM m_done GROUP BY 1) b ON b.yr = y.yr""")
oracle("q15_month_growth", "month:d revenue:f mom_growth_pct:f",
       """SELECT month, round(net, 0) AS revenue, round(100e0 * (CAST(net AS DOUBLE) / CAST(lag(net) OVER (ORDER BY month) AS DOUBLE) - 1), 2) AS mom_growth_pct FROM x_month""")
oracle("q16_top_products_by_revenue", "product_id:i product_name:s units_sold:i net_revenue:f",
       """SELECT x.product_id, p.product_name, x.units AS units_sold, round(x.net, 0) AS net_revenue FROM x_prod x JOIN m_pr p ON p.product_id = x.product_id
       ORDER BY x.net DESC, x.product_id LIMIT 10""")
oracle("q17_top_products_by_units", "product_id:i product_name:s units_sold:i net_revenue_per_unit:f",
       """SELECT x.product_id, p.product_name, x.units AS units_sold, round(x.net / x.units, 2) AS net_revenue_per_unit FROM x_prod x
       JOIN m_pr p ON p.product_id = x.product_id ORDER BY x.units DESC, x.product_id LIMIT 10""")
oracle("q18_category_contribution", "category:s units_sold:i net_revenue:f revenue_share_pct:f cumulative_share_pct:f",
       """SELECT category, u AS units_sold, round(n, 0) AS net_revenue, round(100e0 * n / sum(n) OVER (), 2) AS revenue_share_pct,
       round(100e0 * sum(n) OVER (ORDER BY n DESC) / sum(n) OVER (), 2) AS cumulative_share_pct
       FROM (SELECT g.category, sum(x.units) AS u, sum(x.net) AS n FROM x_prod x JOIN x_goods g ON g.product_id = x.product_id GROUP BY g.category)""")
oracle("q19_city_ranking", "city:s region:s store_type:s orders:i net_revenue:f revenue_rank:i",
       """SELECT city, region, store_type, n AS orders, round(net, 0) AS net_revenue, rank() OVER (ORDER BY net DESC) AS revenue_rank FROM
       (SELECT s.city, s.region, s.store_type, sum(x.n) AS n, sum(x.net) AS net FROM x_store x JOIN m_st s ON s.store_id = x.store_id GROUP BY ALL)""")
oracle("q20_customer_cities", "customer_city:s buying_customers:i orders:i net_revenue:f",
       """SELECT coalesce(c.city, '(unknown)') AS customer_city, count(*) AS buying_customers, sum(x.n) AS orders, round(sum(x.net), 0) AS net_revenue
       FROM x_cust x JOIN m_cu c ON c.customer_id = x.customer_id GROUP BY 1 ORDER BY sum(x.net) DESC, 1 LIMIT 10""")
oracle("q21_time_slots", "time_slot:s orders:i net_revenue:f",
       """SELECT CASE WHEN h < 12 THEN '1) Morning (10-12)' WHEN h < 16 THEN '2) Afternoon (12-16)' WHEN h < 19 THEN '3) Evening (16-19)' ELSE '4) Night (19-22)' END
       AS time_slot, count(*) AS orders, round(sum(net), 0) AS net_revenue FROM (SELECT hour(ts) AS h, net FROM m_ev) GROUP BY 1""")
oracle("q22_running_total", "month:d revenue:f running_total:f",
       "SELECT month, round(net, 0) AS revenue, round(sum(net) OVER (ORDER BY month), 0) AS running_total FROM x_month")
oracle("q23_moving_average", "month:d revenue:f moving_avg_3m:f",
       """SELECT month, round(net, 0) AS revenue, CASE WHEN count(*) OVER w = 3 THEN round(CAST(sum(net) OVER w AS DOUBLE) / 3, 0) END AS moving_avg_3m
       FROM x_month WINDOW w AS (ORDER BY month ROWS 2 PRECEDING)""")
oracle("q24_best_months", "yr:i month:d revenue:f rank_in_year:i",
       """SELECT year(month) AS yr, month, round(net, 0) AS revenue, rank() OVER (PARTITION BY year(month) ORDER BY net DESC) AS rank_in_year
       FROM x_month QUALIFY rank_in_year <= 3""")
oracle("q25_channel_pivot", "yr:i in_store_revenue:f online_revenue:f online_share_pct:f",
       """SELECT yr, round(sum(net) FILTER (channel = 'IN_STORE'), 0) AS in_store_revenue, round(sum(net) FILTER (channel = 'ONLINE'), 0) AS online_revenue,
       round(100e0 * sum(net) FILTER (channel = 'ONLINE') / sum(net), 2) AS online_share_pct FROM m_done GROUP BY yr""")
oracle("q26_quarterly_growth", "quarter:s revenue:f yoy_growth_pct:f",
       """SELECT year(q) || '-Q' || quarter(q) AS quarter, round(net, 0) AS revenue,
       round(100e0 * (CAST(net AS DOUBLE) / CAST(lag(net, 4) OVER (ORDER BY q) AS DOUBLE) - 1), 2) AS yoy_growth_pct
       FROM (SELECT date_trunc('quarter', day) AS q, sum(net) AS net FROM m_done GROUP BY 1)""")
oracle("q27_discount_impact", "line_type:s order_lines:i units:i discount_depth_pct:f gross_margin_pct:f total_discount:f",
       """SELECT CASE WHEN promotion_id IS NULL THEN 'No promotion' ELSE 'Promotion applied' END AS line_type, count(*) AS order_lines, sum(qty) AS units,
       round(100e0 * sum(disc) / sum(gross), 2) AS discount_depth_pct, round(100e0 * sum(profit) / sum(net), 2) AS gross_margin_pct, round(sum(disc), 0) AS total_discount
       FROM m_sl GROUP BY 1""")
oracle("q28_promotion_uplift",
       "promo_code:s discount_type:s discount_value:f promo_days:i units_during:i units_28d_before:i discount_given:f daily_unit_uplift_pct:f",
       """SELECT promo_code, discount_type, discount_value, 30 AS promo_days, u AS units_during, b AS units_28d_before, round(g, 0) AS discount_given,
       round(100e0 * ((CAST(u AS DOUBLE) / 30) / (CAST(b AS DOUBLE) / 28) - 1), 1) AS daily_unit_uplift_pct FROM (
        SELECT p.promo_code, p.discount_type, p.discount_value, sum(l.qty) FILTER (l.day >= p.a) AS u, sum(l.qty) FILTER (l.day < p.a) AS b,
         sum(l.disc) FILTER (l.day >= p.a) AS g FROM m_promo p, m_asof t, m_sl l
        WHERE p.a - 28 >= t.f AND p.z <= t.d AND l.product_id % 11 = p.promotion_id - 5 AND l.day BETWEEN p.a - 28 AND p.z GROUP BY ALL)
       WHERE u IS NOT NULL AND b IS NOT NULL""")
oracle("q29_basket_size", "basket_size:s orders:i avg_order_value:f share_of_orders_pct:f",
       """SELECT CASE WHEN k = 1 THEN '1 item' WHEN k = 2 THEN '2 items' WHEN k <= 4 THEN '3-4 items' ELSE '5+ items' END AS basket_size, count(*) AS orders,
       round(CAST(sum(total) AS DOUBLE) / count(*) + 1e-7, 2) AS avg_order_value, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS share_of_orders_pct
       FROM (SELECT o.order_id, o.total, count(*) AS k FROM m_done o JOIN m_it i ON i.order_id = o.order_id GROUP BY ALL) GROUP BY 1""")
oracle("q30_payment_mix", "payment_method:s successful_payments:i amount_collected:f share_of_successful_pct:f failure_rate_pct:f",
       """SELECT method AS payment_method, ok AS successful_payments, round(a, 0) AS amount_collected, round(100e0 * ok / sum(ok) OVER (), 2) AS share_of_successful_pct,
       round(100e0 * bad / live, 2) AS failure_rate_pct FROM (SELECT method, count(*) FILTER (status = 'SUCCESS') AS ok, sum(amount) FILTER (status = 'SUCCESS') AS a,
       count(*) FILTER (status = 'FAILED') AS bad, count(*) FILTER (status <> 'REFUNDED') AS live FROM m_pay GROUP BY method)""")
oracle("q31_best_month", "best_month:s revenue:f",
       "SELECT strftime(arg_max(month, net), '%Y-%m') AS best_month, round(max(net), 0) AS revenue FROM x_month GROUP BY year(month)")
