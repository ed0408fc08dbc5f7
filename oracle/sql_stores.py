from .compose import oracle

ST = "JOIN m_st s ON s.store_id = x.store_id"
oracle("q72_store_scorecard",
       "store_name:s orders:i units:i net_revenue:f avg_order_value:f customers:i repeat_customer_rate_pct:f return_rate_pct:f inventory_value:f",
       f"""SELECT s.store_name, x.n AS orders, u.u AS units, round(x.net, 0) AS net_revenue, round(CAST(x.gross AS DOUBLE) / x.n + 1e-7, 0) AS avg_order_value, c.c AS customers,
       round(100e0 * c.r / c.c, 1) AS repeat_customer_rate_pct, round(100e0 * coalesce(b.b, 0) / x.n, 2) AS return_rate_pct, round(v.v, 0) AS inventory_value
       FROM x_store x {ST} JOIN (SELECT store_id, sum(qty) AS u FROM m_sl GROUP BY 1) u ON u.store_id = x.store_id
       JOIN (SELECT store_id, count(*) AS c, count(*) FILTER (k > 1) AS r FROM (SELECT store_id, customer_id, count(*) AS k FROM m_done GROUP BY 1, 2) GROUP BY 1) c
        ON c.store_id = x.store_id
       LEFT JOIN (SELECT store_id, count(*) AS b FROM x_flag WHERE back GROUP BY 1) b ON b.store_id = x.store_id
       JOIN (SELECT store_id, sum(value) AS v FROM m_stock GROUP BY 1) v ON v.store_id = x.store_id""")
oracle("q73_monthly_store_rank", "month:d store_name:s revenue:f revenue_rank:i",
       f"""SELECT x.month, s.store_name, round(x.net, 0) AS revenue, x.k AS revenue_rank FROM (SELECT month, store_id, sum(net) AS net,
       rank() OVER (PARTITION BY month ORDER BY sum(net) DESC) AS k FROM m_done GROUP BY 1, 2) x {ST}
       WHERE x.month >= (SELECT max(month) FROM m_done) - INTERVAL 2 MONTH""")
oracle("q74_store_growth", "store_name:s opened_date:d revenue_1999:f revenue_2000:f growth_pct:f",
       f"""SELECT s.store_name, s.opened_date, round(x.a, 0) AS revenue_1999, round(x.b, 0) AS revenue_2000, round(100e0 * (CAST(x.b AS DOUBLE) / CAST(x.a AS DOUBLE) - 1), 1) AS growth_pct
       FROM (SELECT store_id, sum(net) FILTER (yr = 1999) AS a, sum(net) FILTER (yr = 2000) AS b FROM m_done GROUP BY 1) x {ST} WHERE s.opened_date < DATE '1999-01-01'""")
oracle("q75_region_rollup", "region:s state:s orders:i net_revenue:f",
       f"""SELECT coalesce(s.region, 'ALL REGIONS') AS region, CASE WHEN grouping(s.state) = 1 THEN 'subtotal' ELSE s.state END AS state, sum(x.n) AS orders,
       round(sum(x.net), 0) AS net_revenue FROM x_store x {ST} GROUP BY ROLLUP (s.region, s.state)""")
oracle("q76_revenue_per_month", "store_name:s opened_date:d months_open:f revenue:f revenue_per_month:f index_vs_peer_average:f",
       f"""SELECT store_name, opened_date, round(k, 1) AS months_open, round(net, 0) AS revenue, round(net / k, 0) AS revenue_per_month,
       round(100e0 * (net / k) / avg(net / k) OVER (), 0) AS index_vs_peer_average FROM (SELECT s.store_name, s.opened_date, CAST(x.net AS DOUBLE) AS net,
       greatest((d - greatest(s.opened_date, f)) / 30.44e0, 1) AS k FROM x_store x {ST}, m_asof WHERE s.store_type = 'STORE')""")
oracle("q77_best_salesperson", "store_name:s top_employee:s job_title:s reports_to:s orders:i net_revenue:f",
       f"""SELECT s.store_name, e.who AS top_employee, e.job_title, b.who AS reports_to, x.n AS orders, round(x.net, 0) AS net_revenue FROM (
       SELECT store_id, employee_id, count(*) AS n, sum(net) AS net FROM m_done WHERE employee_id IS NOT NULL GROUP BY 1, 2
       QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY sum(net) DESC, employee_id) = 1) x {ST}
       JOIN m_em e ON e.employee_id = x.employee_id LEFT JOIN m_em b ON b.employee_id = e.manager_id""")
oracle("q78_leading_category", "store_name:s leading_category:s revenue:f share_of_store_pct:f",
       f"""SELECT s.store_name, arg_max(x.category, x.net) AS leading_category, round(max(x.net), 0) AS revenue, round(100e0 * max(x.net) / sum(x.net), 1) AS share_of_store_pct
       FROM (SELECT l.store_id, coalesce(c.category_name, '(no category)') AS category, sum(l.net) AS net FROM m_sl l JOIN m_pr p ON p.product_id = l.product_id
       LEFT JOIN m_cat c ON c.category_id = p.category_id GROUP BY 1, 2) x {ST} GROUP BY 1""")
oracle("q79_order_value_gap", "store_name:s orders:i store_aov:f company_aov:f difference_pct:f",
       f"""SELECT s.store_name, x.n AS orders, round(CAST(x.gross AS DOUBLE) / x.n + 1e-7, 0) AS store_aov, round(a.v, 0) AS company_aov,
       round(100e0 * (CAST(x.gross AS DOUBLE) / x.n / a.v - 1), 1) AS difference_pct FROM x_store x {ST}, (SELECT CAST(sum(total) AS DOUBLE) / count(*) AS v FROM m_done) a
       WHERE x.n > 100""")
oracle("q80_revenue_per_employee", "store_name:s active_employees:i net_revenue:f revenue_per_active_employee:f",
       f"""SELECT s.store_name, e.k AS active_employees, round(x.net, 0) AS net_revenue, round(CAST(x.net AS DOUBLE) / nullif(e.k, 0), 0) AS revenue_per_active_employee
       FROM x_store x {ST} JOIN (SELECT store_id, count(*) FILTER (is_active) AS k FROM m_em GROUP BY 1) e ON e.store_id = x.store_id""")

# ---- suppliers
SU = "JOIN m_su s ON s.supplier_id = x.supplier_id"
oracle("q81_supplier_spend", "supplier_name:s purchase_orders:i units_ordered:i spend:f share_of_spend_pct:f",
       f"""SELECT s.supplier_name, x.n AS purchase_orders, x.u AS units_ordered, round(x.v, 0) AS spend, round(100e0 * x.v / (SELECT sum(ordered * cost) FROM m_poi), 2) AS share_of_spend_pct
       FROM (SELECT p.supplier_id, count(DISTINCT purchase_id) AS n, sum(i.ordered) AS u, sum(i.ordered * i.cost) AS v FROM m_poi i JOIN m_po p USING (purchase_id) GROUP BY 1) x {SU}
       ORDER BY x.v DESC LIMIT 15""")
oracle("q82_on_time",
       "supplier_name:s promised_lead_days:i received_pos:i on_time_pct:f avg_days_vs_expected:f worst_delay_days:i",
       f"""SELECT s.supplier_name, s.lead AS promised_lead_days, x.rec AS received_pos, round(100e0 * x.on_time / x.rec, 1) AS on_time_pct, round(x.delay + 1e-7 * sign(x.delay), 1) AS avg_days_vs_expected,
       x.worst AS worst_delay_days FROM x_supo x {SU} WHERE x.rec >= 30 ORDER BY round(100e0 * x.on_time / x.rec, 1), x.supplier_id LIMIT 15""")
oracle("q83_fill_rate", "supplier_name:s ordered:i received:i fill_rate_pct:f short_shipped_lines:i",
       f"""SELECT s.supplier_name, x.o AS ordered, x.g AS received, round(100e0 * x.g / x.o, 2) AS fill_rate_pct, x.short AS short_shipped_lines FROM x_fill x {SU}
       WHERE x.o >= 200 ORDER BY round(100e0 * x.g / x.o, 2), x.supplier_id LIMIT 15""")
oracle("q84_lead_time", "supplier_name:s promised_days:i actual_avg_days:f gap_days:f assessment:s",
       f"""SELECT s.supplier_name, s.lead AS promised_days, round(x.lead_days + 1e-7, 1) AS actual_avg_days, round((x.lead_days - s.lead) + 1e-7 * sign(x.lead_days - s.lead), 1) AS gap_days,
       CASE WHEN x.lead_days - s.lead > 2 THEN 'Slower than promised' WHEN x.lead_days - s.lead < -2 THEN 'Faster than promised' ELSE 'In line' END AS assessment
       FROM x_supo x {SU} WHERE x.rec >= 30 ORDER BY round((x.lead_days - s.lead) + 1e-7 * sign(x.lead_days - s.lead), 1) DESC, x.supplier_id LIMIT 15""")
oracle("q85_supplier_dependency", "supplier:s products_sold:i net_revenue:f revenue_share_pct:f",
       """SELECT coalesce(s.supplier_name, '(supplier missing on product)') AS supplier, count(*) AS products_sold, round(sum(x.net), 0) AS net_revenue,
       round(100e0 * sum(x.net) / (SELECT sum(net) FROM x_prod), 2) AS revenue_share_pct FROM x_prod x JOIN m_pr p ON p.product_id = x.product_id
       LEFT JOIN m_su s ON s.supplier_id = p.supplier_id GROUP BY 1 ORDER BY sum(x.net) DESC LIMIT 12""")
oracle("q86_supplier_findings", "finding:s supplier_name:s",
       """SELECT 'No products linked' AS finding, supplier_name FROM m_su s WHERE NOT EXISTS (SELECT 1 FROM m_pr p WHERE p.supplier_id = s.supplier_id)
       UNION ALL SELECT 'Inactive but has purchase orders', supplier_name FROM m_su SEMI JOIN m_po USING (supplier_id) WHERE NOT is_active""")
oracle("q87_open_orders", "supplier_name:s open_pos:i overdue_pos:i max_days_overdue:i open_value:f",
       f"""SELECT s.supplier_name, x.open_pos, x.overdue AS overdue_pos, x.late AS max_days_overdue, round(x.open_value, 0) AS open_value FROM x_supo x {SU}
       WHERE x.open_pos > 0 ORDER BY x.overdue DESC, x.open_value DESC LIMIT 15""")
oracle("q88_supplier_score",
       "supplier_name:s received_pos:i on_time_pct:f fill_rate_pct:f lead_time_gap_days:f composite_score:f overall_rank:i",
       f"""SELECT supplier_name, rec AS received_pos, round(p, 1) AS on_time_pct, round(g, 1) AS fill_rate_pct, round(w + 1e-7 * sign(w), 1) AS lead_time_gap_days, round(score, 2) AS composite_score,
       rank() OVER (ORDER BY score DESC) AS overall_rank FROM (SELECT *, (percent_rank() OVER (ORDER BY p) + percent_rank() OVER (ORDER BY g) + percent_rank() OVER (ORDER BY w DESC)) / 3 AS score
        FROM (SELECT x.supplier_id, s.supplier_name, x.rec, 100e0 * x.on_time / x.rec AS p, 100e0 * f.g / f.o AS g, x.lead_days - s.lead AS w
         FROM x_supo x {SU} JOIN x_fill f ON f.supplier_id = x.supplier_id WHERE x.rec >= 30)) ORDER BY score DESC, supplier_id LIMIT 10""")

# ---- returns
oracle("q89_return_rates",
       "completed_orders:i orders_with_returns:i order_return_rate_pct:f unit_return_rate_pct:f returned_value_net:f value_return_rate_pct:f",
       """SELECT n AS completed_orders, b AS orders_with_returns, round(100e0 * b / n, 2) AS order_return_rate_pct, round(100e0 * q / u, 2) AS unit_return_rate_pct,
       round(v, 0) AS returned_value_net, round(100e0 * v / net, 2) AS value_return_rate_pct FROM (SELECT count(*) AS n, sum(net) AS net FROM m_done),
       (SELECT count(DISTINCT order_id) AS b, sum(qty) AS q, sum(refund_net) AS v FROM m_rl), (SELECT sum(qty) AS u FROM m_sl)""")
oracle("q90_return_reasons", "return_reason:s returns:i refund_value:f share_of_returns_pct:f",
       """SELECT reason AS return_reason, count(*) AS returns, round(sum(refund), 0) AS refund_value, round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS share_of_returns_pct
       FROM m_rl GROUP BY reason""")
oracle("q91_returns_by_category", "category_name:s units_sold:i units_returned:i unit_return_rate_pct:f refund_value:f",
       """SELECT g.canonical_name AS category_name, sum(x.units) AS units_sold, coalesce(sum(b.back), 0) AS units_returned,
       round(100e0 * coalesce(sum(b.back), 0) / sum(x.units), 2) AS unit_return_rate_pct, round(coalesce(sum(b.refund), 0), 0) AS refund_value FROM x_goods g
       LEFT JOIN x_prod x ON x.product_id = g.product_id LEFT JOIN x_back b ON b.product_id = g.product_id WHERE g.canonical_id IS NOT NULL GROUP BY 1""")
RATE = "count(*) AS completed_orders, count(*) FILTER (x.back) AS orders_with_returns, round(100e0 * count(*) FILTER (x.back) / count(*), 2) AS order_return_rate_pct"
oracle("q92_returns_by_store", "store_name:s completed_orders:i orders_with_returns:i order_return_rate_pct:f company_rate_pct:f",
       f"""SELECT s.store_name, {RATE}, (SELECT round(100e0 * count(DISTINCT order_id) / (SELECT count(*) FROM m_done), 2) FROM m_rl) AS company_rate_pct
       FROM x_flag x {ST} WHERE x.status = 'COMPLETED' GROUP BY s.store_name""")
oracle("q93_returns_by_segment", "segment:s completed_orders:i orders_with_returns:i order_return_rate_pct:f",
       f"""SELECT coalesce(c.segment_name, '(no segment)') AS segment, {RATE} FROM x_flag x JOIN m_cu c ON c.customer_id = x.customer_id
       WHERE x.status = 'COMPLETED' GROUP BY 1""")
oracle("q94_unusual_returns",
       "product_name:s units_sold:i units_returned:i return_rate_pct:f category_rate_pct:f times_category_rate:f",
       """SELECT product_name, u AS units_sold, b AS units_returned, round(r, 1) AS return_rate_pct, round(c, 1) AS category_rate_pct, round(r / nullif(c, 0), 1) AS times_category_rate
       FROM (SELECT *, 100e0 * b / u AS r, 100e0 * sum(b) OVER (PARTITION BY k) / sum(u) OVER (PARTITION BY k) AS c FROM (
        SELECT p.product_id, p.product_name, coalesce(p.category_id, 0) AS k, sum(l.qty) AS u, coalesce(sum(l.qty) FILTER (l.flag = 'R'), 0) AS b
        FROM m_sl l JOIN m_pr p ON p.product_id = l.product_id GROUP BY ALL)) WHERE u >= 40 AND b >= 8 AND r >= 2.5e0 * c
       ORDER BY round(r / nullif(c, 0), 1) DESC, product_id LIMIT 15""")
oracle("q95_refunds_per_month", "month:d net_revenue:f refunded_net:f refund_pct_of_revenue:f",
       """SELECT x.month, round(x.net, 0) AS net_revenue, round(coalesce(r.v, 0), 0) AS refunded_net, round(100e0 * coalesce(r.v, 0) / x.net, 2) AS refund_pct_of_revenue
       FROM x_month x LEFT JOIN (SELECT month, sum(refund_net) AS v FROM m_rl GROUP BY 1) r ON r.month = x.month""")
oracle("q96_days_to_return", "return_window:s returns:i share_pct:f median_days:f",
       """SELECT CASE WHEN k < 3 THEN 'a) within 3 days' WHEN k < 7 THEN 'b) 3-6 days' WHEN k < 15 THEN 'c) 7-14 days' ELSE 'd) 15+ days' END AS return_window,
       count(*) AS returns, round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS share_pct, round(quantile_cont(k, 0.5), 1) AS median_days
       FROM (SELECT CAST(epoch(r.ship) - epoch(o.ts) AS DOUBLE) / 86400 AS k FROM m_rl r JOIN m_so o ON o.order_id = r.order_id) GROUP BY 1""")
oracle("q97_restocked", "outcome:s return_lines:i units:i cost_value:f share_of_cost_pct:f",
       """SELECT CASE WHEN restocked THEN 'Restocked (resellable)' ELSE 'Not restocked (write-off)' END AS outcome, count(*) AS return_lines, sum(qty) AS units,
       round(sum(cost_value), 0) AS cost_value, round(100e0 * sum(cost_value) / sum(sum(cost_value)) OVER (), 1) AS share_of_cost_pct FROM m_rl GROUP BY restocked""")
oracle("q98_returns_by_channel", "channel:s completed_orders:i orders_with_returns:i order_return_rate_pct:f",
       f"SELECT channel, {RATE} FROM x_flag x WHERE status = 'COMPLETED' GROUP BY channel")
oracle("q99_top_reason", "category_name:s most_common_reason:s returns:i share_of_category_returns_pct:f",
       """SELECT c AS category_name, reason AS most_common_reason, n AS returns, round(100e0 * n / w, 1) AS share_of_category_returns_pct FROM (
       SELECT g.canonical_name AS c, r.reason, count(*) AS n, sum(count(*)) OVER (PARTITION BY g.canonical_name) AS w FROM m_rl r JOIN x_goods g ON g.product_id = r.product_id
       WHERE g.canonical_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, reason DESC) = 1)""")
