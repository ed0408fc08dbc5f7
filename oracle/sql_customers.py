from .compose import oracle

NAME = "CASE WHEN trim(c.first_name) = 'AMIT' THEN 'Amit' WHEN trim(c.first_name) = 'neha' THEN 'Neha' ELSE c.first_name END || ' '"
oracle("q32_top_customers",
       "customer_id:i customer_name:s segment:s orders:i lifetime_net_revenue:f avg_order_value:f first_purchase:d last_purchase:d",
       f"""SELECT x.customer_id, {NAME} || coalesce(c.last_name, '') AS customer_name, coalesce(c.segment_name, '(none)') AS segment, x.n AS orders,
       round(x.net, 0) AS lifetime_net_revenue, round(CAST(x.gross AS DOUBLE) / x.n + 1e-7, 0) AS avg_order_value, x.first_day AS first_purchase, x.last_day AS last_purchase
       FROM x_cust x JOIN m_cu c ON c.customer_id = x.customer_id ORDER BY x.net DESC, x.customer_id LIMIT 20""")
oracle("q33_repeat_rate", "buying_customers:i repeat_customers:i one_time_customers:i repeat_customer_rate_pct:f",
       """SELECT count(*) AS buying_customers, sum((n > 1)::INT) AS repeat_customers, sum((n = 1)::INT) AS one_time_customers,
       round(100e0 * sum((n > 1)::INT) / count(*), 2) AS repeat_customer_rate_pct FROM x_cust""")
oracle("q34_never_purchased", "via_left_join:i via_not_exists:i via_not_in:i",
       "SELECT n AS via_left_join, n AS via_not_exists, n AS via_not_in FROM (SELECT count(*) AS n FROM m_cu ANTI JOIN m_done USING (customer_id))")
oracle("q35_never_purchased_by_year", "registration_year:i never_purchased:i share_of_non_buyers_pct:f",
       """SELECT year(registration_date) AS registration_year, count(*) AS never_purchased, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS share_of_non_buyers_pct
       FROM m_cu ANTI JOIN m_done USING (customer_id) GROUP BY 1""")
oracle("q36_frequency_bands", "frequency_band:s customers:i customer_share_pct:f revenue_share_pct:f",
       """SELECT CASE WHEN n = 1 THEN 'a) 1 order' WHEN n < 4 THEN 'b) 2-3 orders' WHEN n < 7 THEN 'c) 4-6 orders' WHEN n < 13 THEN 'd) 7-12 orders' ELSE 'e) 13+ orders' END
       AS frequency_band, count(*) AS customers, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS customer_share_pct,
       round(100e0 * sum(net) / sum(sum(net)) OVER (), 2) AS revenue_share_pct FROM x_cust GROUP BY 1""")
oracle("q37_segments", "segment:s buying_customers:i orders:i net_revenue:f revenue_share_pct:f revenue_per_customer:f avg_order_value:f",
       """SELECT coalesce(c.segment_name, '(no segment)') AS segment, count(*) AS buying_customers, sum(x.n) AS orders, round(sum(x.net), 0) AS net_revenue,
       round(100e0 * sum(x.net) / sum(sum(x.net)) OVER (), 2) AS revenue_share_pct, round(CAST(sum(x.net) AS DOUBLE) / count(*) + 1e-7, 0) AS revenue_per_customer,
       round(CAST(sum(x.gross) AS DOUBLE) / sum(x.n), 0) AS avg_order_value FROM x_cust x JOIN m_cu c ON c.customer_id = x.customer_id GROUP BY 1""")
oracle("q38_new_and_returning", "month:d new_customers:i returning_customers:i active_customers:i returning_share_pct:f",
       """SELECT a.month, count(*) FILTER (a.month = f.m) AS new_customers, count(*) FILTER (a.month > f.m) AS returning_customers, count(*) AS active_customers,
       round(100e0 * count(*) FILTER (a.month > f.m) / count(*), 1) AS returning_share_pct FROM (SELECT DISTINCT customer_id, month FROM m_done) a
       JOIN (SELECT customer_id, min(month) AS m FROM m_done GROUP BY 1) f ON f.customer_id = a.customer_id GROUP BY a.month""")
oracle("q39_rfm_scores", "customer_id:i recency_days:i frequency:i monetary:f r_score:i f_score:i m_score:i",
       """SELECT customer_id, recency AS recency_days, n AS frequency, round(net, 0) AS monetary, r AS r_score, f AS f_score, m AS m_score FROM x_rfm
       ORDER BY net DESC, customer_id LIMIT 15""")
oracle("q40_rfm_segments", "rfm_segment:s customers:i customer_share_pct:f net_revenue:f revenue_share_pct:f avg_recency_days:f avg_orders:f",
       """SELECT label AS rfm_segment, count(*) AS customers, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS customer_share_pct, round(sum(net), 0) AS net_revenue,
       round(100e0 * sum(net) / sum(sum(net)) OVER (), 2) AS revenue_share_pct, round(avg(recency), 0) AS avg_recency_days, round(avg(n), 1) AS avg_orders
       FROM x_label GROUP BY label""")
COHORT = """SELECT f.m AS cohort, datediff('month', f.m, a.month) AS k, count(*) AS n FROM (SELECT DISTINCT customer_id, month FROM m_done) a
 JOIN (SELECT customer_id, min(month) AS m FROM m_done GROUP BY 1) f ON f.customer_id = a.customer_id
 WHERE f.m <= (SELECT max(month) - INTERVAL 6 MONTH FROM m_done) GROUP BY ALL"""


def retained(k: int) -> str:
    return f"round(100e0 * coalesce(sum(n) FILTER (k = {k}), 0) / sum(n) FILTER (k = 0), 1) AS m{k}_pct"


oracle("q41_cohort_retention", "cohort:d cohort_size:i m1_pct:f m2_pct:f m3_pct:f m6_pct:f",
       f"SELECT cohort, sum(n) FILTER (k = 0) AS cohort_size, {', '.join(retained(k) for k in (1, 2, 3, 6))} FROM ({COHORT}) GROUP BY cohort")
oracle("q42_lifetime_value", "segment:s customers:i avg_orders:f avg_lifetime_revenue:f avg_lifetime_gross_profit:f avg_active_span_days:f",
       """SELECT coalesce(c.segment_name, '(no segment)') AS segment, count(*) AS customers, round(avg(o), 1) AS avg_orders, round(avg(net), 0) AS avg_lifetime_revenue,
       round(avg(profit), 0) AS avg_lifetime_gross_profit, round(avg(span), 0) AS avg_active_span_days FROM (SELECT customer_id, count(DISTINCT order_id) AS o,
       sum(net) AS net, sum(profit) AS profit, max(day) - min(day) AS span FROM m_sl GROUP BY customer_id) x JOIN m_cu c ON c.customer_id = x.customer_id GROUP BY 1""")
oracle("q43_activity_status", "customer_status:s customers:i share_pct:f",
       """SELECT CASE WHEN x.recency IS NULL THEN '4) Never purchased' WHEN x.recency <= 90 THEN '1) Active (bought in last 90 days)'
       WHEN x.recency <= 365 THEN '2) Inactive (91-365 days)' ELSE '3) Lost (over 365 days)' END AS customer_status, count(*) AS customers,
       round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS share_pct FROM m_cu c LEFT JOIN x_cust x ON x.customer_id = c.customer_id GROUP BY 1""")
oracle("q44_store_favourites", "store_name:s customer_id:i customer_name:s orders:i net_revenue:f",
       f"""SELECT s.store_name, b.customer_id, {NAME} || c.last_name AS customer_name, b.n AS orders, round(b.net, 0) AS net_revenue FROM (
       SELECT store_id, customer_id, count(*) AS n, sum(net) AS net FROM m_done GROUP BY 1, 2
       QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY sum(net) DESC, customer_id) = 1) b
       JOIN m_st s ON s.store_id = b.store_id JOIN m_cu c ON c.customer_id = b.customer_id""")
oracle("q45_days_between_orders", "repeat_orders_measured:i avg_gap_days:f median_gap_days:f p90_gap_days:f",
       """SELECT count(gap) AS repeat_orders_measured, round(avg(gap), 1) AS avg_gap_days, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS median_gap_days,
       quantile_cont(CAST(gap AS DOUBLE), 0.9) AS p90_gap_days FROM x_gap""")
oracle("q46_revenue_deciles", "decile:i customers:i net_revenue:f revenue_share_pct:f cumulative_share_from_top_pct:f",
       """SELECT k AS decile, count(*) AS customers, round(sum(net), 0) AS net_revenue, round(100e0 * sum(net) / sum(sum(net)) OVER (), 2) AS revenue_share_pct,
       round(100e0 * sum(sum(net)) OVER (ORDER BY k DESC) / sum(sum(net)) OVER (), 2) AS cumulative_share_from_top_pct
       FROM (SELECT net, ntile(10) OVER (ORDER BY net, customer_id) AS k FROM x_cust) GROUP BY k""")
