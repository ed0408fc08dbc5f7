"""The canonical datasets (CTEs d_, reused by the layers above them)."""
from .compose import cte, oracle

cte("d_month", """SELECT t.month, year(t.month) AS year, month(t.month) AS month_number, strftime(t.month, '%Y-%m') AS year_month, coalesce(o.n, 0) AS orders,
  coalesce(o.c, 0) AS cancelled_orders, coalesce(o.k, 0) AS active_customers, coalesce(l.u, 0) AS units_sold, round(coalesce(o.g, 0), 2) AS gross_sales_incl_gst,
  round(coalesce(l.n, 0), 2) AS net_revenue, round(coalesce(l.c, 0), 2) AS cogs, round(coalesce(l.p, 0), 2) AS gross_profit, round(100e0 * l.p / l.n, 2) AS gross_margin_pct,
  round(CAST(o.g AS DOUBLE) / o.n + 1e-7, 2) AS avg_order_value, round(coalesce(l.d, 0), 2) AS discounts, round(coalesce(r.v, 0), 2) AS refunded_net, coalesce(o.w, 0) AS online_orders
 FROM (SELECT DISTINCT CAST(date_trunc('month', m_cal.d) AS DATE) AS month FROM m_cal, m_asof WHERE m_cal.d BETWEEN date_trunc('month', f) AND m_asof.d) t
 LEFT JOIN (SELECT month, count(*) FILTER (status = 'COMPLETED') AS n, count(*) FILTER (status = 'CANCELLED') AS c, count(DISTINCT customer_id) FILTER (status = 'COMPLETED') AS k,
   sum(total) FILTER (status = 'COMPLETED') AS g, count(*) FILTER (status = 'COMPLETED' AND channel = 'ONLINE') AS w FROM m_so GROUP BY 1) o ON o.month = t.month
 LEFT JOIN (SELECT month, sum(qty) AS u, sum(net) AS n, sum(cogs) AS c, sum(profit) AS p, sum(disc) AS d FROM m_sl GROUP BY 1) l ON l.month = t.month
 LEFT JOIN (SELECT month, sum(refund_net) AS v FROM m_rl GROUP BY 1) r ON r.month = t.month""")
cte("d_prod", """SELECT *, 100e0 * run / whole AS cum, 100e0 * net / whole AS share, CASE WHEN units_in_stock > 0 THEN ntile(5) OVER (PARTITION BY units_in_stock > 0 ORDER BY r12, product_id) END AS q,
  rank() OVER (ORDER BY net DESC) AS rk, units_in_stock / nullif(CAST(u90 AS DOUBLE) / 90, 0) AS cover
 FROM (SELECT g.product_id, g.sku, g.product_name, coalesce(g.brand, '(brand missing)') AS brand, g.category, coalesce(s.supplier_name, '(supplier missing)') AS supplier, g.is_active,
   g.unit_price, g.unit_cost, g.launch_date, coalesce(t.o, 0) AS orders, coalesce(x.units, 0) AS units_sold, coalesce(x.net, 0) AS net, coalesce(x.profit, 0) AS profit,
   coalesce(b.back, 0) AS units_returned, t.a AS first_sale_date, t.z AS last_sale_date, coalesce(y.u90, 0) AS u90, coalesce(y.r12, 0) AS r12, coalesce(y.c12, 0) AS c12,
   coalesce(k.units, 0) AS units_in_stock, coalesce(k.value, 0) AS value, sum(coalesce(x.net, 0)) OVER (ORDER BY coalesce(x.net, 0) DESC, g.product_id ROWS UNBOUNDED PRECEDING) AS run,
   sum(x.net) OVER () AS whole
  FROM x_goods g LEFT JOIN m_su s ON s.supplier_id = g.supplier_id LEFT JOIN x_prod x ON x.product_id = g.product_id
  LEFT JOIN (SELECT product_id, count(DISTINCT order_id) AS o, min(day) AS a, max(day) AS z FROM m_sl GROUP BY 1) t ON t.product_id = g.product_id
  LEFT JOIN x_year12 y ON y.product_id = g.product_id LEFT JOIN x_back b ON b.product_id = g.product_id LEFT JOIN x_prodstock k ON k.product_id = g.product_id)""")
cte("d_product", """SELECT product_id, sku, product_name, brand, category, supplier, is_active, unit_price, unit_cost, launch_date, orders, units_sold, round(net, 2) AS net_revenue,
  round(profit, 2) AS gross_profit, round(100e0 * profit / nullif(net, 0), 2) AS margin_pct, units_returned, round(100e0 * units_returned / nullif(units_sold, 0), 2) AS return_rate_pct,
  first_sale_date, last_sale_date, u90 AS units_90d, round(CAST(u90 AS DOUBLE) / 90, 3) AS sales_velocity_per_day, units_in_stock, round(value, 2) AS inventory_value,
  round(cover, 1) AS days_of_cover, round(CAST(c12 AS DOUBLE) / nullif(CAST(value AS DOUBLE), 0), 2) AS inventory_turnover_12m, rk AS revenue_rank, round(share, 3) AS revenue_share_pct,
  round(cum, 2) AS cumulative_revenue_pct, CASE WHEN net = 0 THEN 'No sales' WHEN cum - share < 80 THEN 'A' WHEN cum - share < 95 THEN 'B' ELSE 'C' END AS abc_class,
  CASE WHEN units_in_stock = 0 THEN NULL WHEN q = 5 AND u90 > 0 AND cover < 30 THEN 'High Revenue / Low Stock' WHEN q = 5 AND u90 > 0 AND cover <= 180 THEN 'High Revenue / Healthy Stock'
   WHEN q <= 2 AND (u90 = 0 OR cover > 180) THEN 'Low Revenue / High Stock' WHEN q <= 2 AND u90 > 0 AND cover < 30 THEN 'Low Revenue / Low Stock' ELSE 'Other' END AS product_class
 FROM d_prod""")
cte("d_customer", """SELECT c.customer_id, CASE trim(c.first_name) WHEN 'AMIT' THEN 'Amit' WHEN 'neha' THEN 'Neha' ELSE c.first_name END || ' ' || coalesce(c.last_name, '') AS customer_name,
  c.email, c.city, c.state, coalesce(c.segment_name, '(no segment)') AS segment, c.registration_date, c.is_active, coalesce(x.n, 0) AS orders, round(coalesce(x.net, 0), 2) AS net_revenue,
  round(coalesce(p.p, 0), 2) AS gross_profit, round(CAST(x.gross AS DOUBLE) / x.n + 1e-7, 2) AS avg_order_value, x.first_day AS first_order_date, x.last_day AS last_order_date,
  date_trunc('month', x.first_day) AS cohort_month, x.recency AS recency_days, x.r AS r_score, x.f AS f_score, x.m AS m_score, coalesce(x.n, 0) > 1 AS is_repeat_customer,
  x.last_day - x.first_day AS active_span_days, CASE WHEN x.n IS NULL THEN 'Never purchased' WHEN x.recency <= 90 THEN 'Active (last 90 days)'
   WHEN x.recency <= 365 THEN 'Inactive (91-365 days)' ELSE 'Lost (over 365 days)' END AS activity_status, x.label AS rfm_segment
 FROM m_cu c LEFT JOIN x_label x ON x.customer_id = c.customer_id LEFT JOIN (SELECT customer_id, sum(profit) AS p FROM m_sl GROUP BY 1) p ON p.customer_id = c.customer_id""")
cte("d_stock", """SELECT v.inventory_id, v.store_id, s.store_name, v.product_id, g.product_name, g.category, coalesce(u.supplier_name, '(supplier missing)') AS supplier, v.on_hand AS quantity_on_hand,
  v.reserved AS reserved_quantity, v.on_hand - v.reserved AS available_quantity, v.reorder AS reorder_level, v.ceiling AS max_stock_level, v.unit_cost, round(v.value, 2) AS inventory_value,
  v.u90 AS units_sold_90d, v.u365 AS units_sold_365d, round(CAST(v.u90 AS DOUBLE) / 90, 3) AS avg_daily_demand, round(v.on_hand / nullif(CAST(v.u90 AS DOUBLE) / 90, 0), 1) AS days_of_cover,
  v.restocked_on AS last_restocked_date, d - v.restocked_on AS days_since_restock, coalesce(b.q, 0) AS inbound_quantity, greatest(v.ceiling - v.on_hand - coalesce(b.q, 0), 0) AS suggested_order_qty,
  v.status AS health_status FROM x_pos v JOIN m_st s ON s.store_id = v.store_id JOIN x_goods g ON g.product_id = v.product_id LEFT JOIN m_su u ON u.supplier_id = g.supplier_id
 LEFT JOIN (SELECT o.store_id, i.product_id, sum(i.ordered) AS q FROM m_poi i JOIN m_po o USING (purchase_id) WHERE o.status = 'ORDERED' GROUP BY 1, 2) b
  ON b.store_id = v.store_id AND b.product_id = v.product_id, m_asof""")
cte("d_store", """SELECT store_id, store_code, store_name, store_type, city, state, region, opened_date, n AS orders, u AS units, c AS customers, round(exact, 2) AS net_revenue,
  round(p, 2) AS gross_profit, round(CAST(g AS DOUBLE) / n + 1e-7, 2) AS avg_order_value, round(100e0 * rp / c, 2) AS repeat_customer_rate_pct, round(100e0 * b / n, 2) AS return_rate_pct,
  round(v, 2) AS inventory_value, round(mo, 1) AS months_open, round(net / mo, 2) AS revenue_per_month,
  round(100e0 * (net / mo) / avg(net / mo) FILTER (store_type = 'STORE') OVER (), 1) AS revenue_per_month_index_vs_stores,
  CASE WHEN opened_date < DATE '1999-01-01' THEN round(100e0 * (CAST(r2 AS DOUBLE) / CAST(r1 AS DOUBLE) - 1), 2) END AS growth_2000_vs_1999_pct,
  rank() OVER (ORDER BY net DESC) AS revenue_rank, round(100e0 * net / sum(net) OVER (), 2) AS revenue_share_pct
 FROM (SELECT s.*, CAST(x.net AS DOUBLE) AS net, x.net AS exact, x.n, x.gross AS g, x.b, x.r1, x.r2, l.u, l.p, k.c, k.rp, w.v, greatest((d - greatest(s.opened_date, f)) / 30.44e0, 1) AS mo FROM m_st s
  JOIN (SELECT store_id, count(*) AS n, sum(net) AS net, sum(total) AS gross, count(*) FILTER (back) AS b, sum(net) FILTER (yr = 1999) AS r1, sum(net) FILTER (yr = 2000) AS r2
   FROM x_flag WHERE status = 'COMPLETED' GROUP BY 1) x ON x.store_id = s.store_id
  JOIN (SELECT store_id, sum(qty) AS u, sum(profit) AS p FROM m_sl GROUP BY 1) l ON l.store_id = s.store_id
  JOIN (SELECT store_id, count(*) AS c, count(*) FILTER (k > 1) AS rp FROM (SELECT store_id, customer_id, count(*) AS k FROM m_done GROUP BY 1, 2) GROUP BY 1) k ON k.store_id = s.store_id
  JOIN (SELECT store_id, sum(value) AS v FROM m_stock GROUP BY 1) w ON w.store_id = s.store_id, m_asof)""")
cte("d_line", "SELECT l.*, coalesce(g.canonical_id, 0) AS category_id, g.category AS category_name, g.product_name FROM m_sl l JOIN x_goods g ON g.product_id = l.product_id")
cte("d_cat", """SELECT category_id, category_name, yr AS year, o AS orders, u AS units_sold, round(n, 2) AS net_revenue, round(p, 2) AS gross_profit, round(100e0 * p / n, 2) AS margin_pct,
  b AS units_returned, round(100e0 * b / u, 2) AS unit_return_rate_pct, round(100e0 * (n / lag(n) OVER (PARTITION BY category_id ORDER BY yr) - 1), 2) AS yoy_growth_pct,
  round(100e0 * n / sum(n) OVER (PARTITION BY yr), 2) AS share_of_year_revenue_pct
 FROM (SELECT category_id, category_name, yr, count(DISTINCT order_id) AS o, sum(qty) AS u, sum(net) AS n, sum(profit) AS p, coalesce(sum(qty) FILTER (flag = 'R'), 0) AS b
  FROM d_line GROUP BY 1, 2, 3)""")
cte("d_sup", """SELECT s.supplier_id, s.supplier_name, s.city, s.state, s.is_active, s.lead AS promised_lead_days, coalesce(p.k, 0) AS products, round(coalesce(p.v, 0), 2) AS net_revenue_of_products,
  coalesce(x.pos, 0) AS total_pos, coalesce(x.rec, 0) AS received_pos, round(coalesce(x.spend, 0), 2) AS purchase_spend, round(100e0 * x.on_time / x.rec, 2) AS on_time_pct,
  round(x.delay + 1e-7 * sign(x.delay), 2) AS avg_days_vs_expected, round(x.lead_days + 1e-7, 2) AS actual_lead_days, round((x.lead_days - s.lead) + 1e-7 * sign(x.lead_days - s.lead), 2) AS lead_time_gap_days, round(100e0 * f.g / f.o, 2) AS fill_rate_pct,
  coalesce(x.open_pos, 0) AS open_pos, coalesce(x.overdue, 0) AS overdue_pos, s.contact_email IS NULL OR s.contact_phone IS NULL OR s.gstin IS NULL AS missing_contact_info
 FROM m_su s LEFT JOIN x_supo x ON x.supplier_id = s.supplier_id LEFT JOIN x_fill f ON f.supplier_id = s.supplier_id
 LEFT JOIN (SELECT p.supplier_id, count(*) AS k, sum(round(x.net, 2)) AS v FROM m_pr p LEFT JOIN x_prod x ON x.product_id = p.product_id WHERE p.supplier_id IS NOT NULL GROUP BY 1) p
  ON p.supplier_id = s.supplier_id""")
cte("d_ret", """SELECT r.ship AS return_date, CAST(r.ship AS DATE) AS return_day, r.month AS return_month, r.order_id, o.ts AS order_date, o.day AS order_day,
  round(CAST(epoch(r.ship) - epoch(o.ts) AS DOUBLE) / 86400, 1) AS days_to_return, r.reason AS return_reason, o.store_id, s.store_name, s.region, o.channel, o.yr,
  coalesce(c.segment_name, '(no segment)') AS customer_segment, r.product_id, g.product_name, g.category, r.qty AS units_returned, r.qty AS units_in_line, r.refund AS refund_amount,
  round(r.refund_net + 1e-7, 2) AS refund_net_of_gst, round(r.cost_value, 2) AS cost_value, r.restocked
 FROM m_rl r JOIN m_so o ON o.order_id = r.order_id JOIN x_goods g ON g.product_id = r.product_id JOIN m_st s ON s.store_id = o.store_id JOIN m_cu c ON c.customer_id = o.customer_id""")
cte("d_ord", """SELECT o.*, s.store_name, s.region, coalesce(c.segment_name, '(no segment)') AS segment FROM x_flag o JOIN m_st s ON s.store_id = o.store_id
 JOIN m_cu c ON c.customer_id = o.customer_id""")

cte("d_known", "SELECT * FROM m_cat WHERE category_id > 6 OR category_name IN (SELECT p_type FROM part)")
oracle("vw_asof", "first_order_date:d asof_date:d", "SELECT f AS first_order_date, d AS asof_date FROM m_asof")
oracle("vw_category_canonical", "category_id:i canonical_id:i canonical_name:s parent_category:s",
       """SELECT c.category_id, min(k.category_id) AS canonical_id, arg_min(k.category_name, k.category_id) AS canonical_name, any_value(p.category_name) AS parent_category
       FROM d_known c JOIN d_known k ON lower(k.category_name) = lower(c.category_name) LEFT JOIN d_known p ON p.category_id = c.parent_id GROUP BY c.category_id""")
oracle("vw_sales_lines",
       "order_id:i order_date:t order_day:d order_month:d order_year:i store_id:i customer_id:i channel:s employee_id:i product_id:i category_id:i category_name:s"
       " promotion_id:i quantity:i unit_price:f unit_cost:f discount_amount:f gross_amount:f line_total_incl_gst:f net_revenue:f cogs:f gross_profit:f",
       """SELECT order_id, ts AS order_date, day AS order_day, month AS order_month, yr AS order_year, store_id, customer_id, channel, employee_id, product_id, category_id, category_name,
       promotion_id, qty AS quantity, price AS unit_price, cost AS unit_cost, disc AS discount_amount, gross AS gross_amount, line_total AS line_total_incl_gst, net AS net_revenue, cogs,
       profit AS gross_profit FROM d_line""")
oracle("vw_orders",
       "order_id:i order_number:s order_date:t order_day:d order_month:d customer_id:i store_id:i store_name:s channel:s order_status:s subtotal:f discount_amount:f gst_amount:f"
       " total_amount:f net_amount:f has_return:b customer_segment:s",
       """SELECT order_id, 'SO-' || order_id AS order_number, ts AS order_date, day AS order_day, month AS order_month, customer_id, store_id, store_name, channel, status AS order_status,
       total - gst + disc AS subtotal, disc AS discount_amount, gst AS gst_amount, total AS total_amount, net AS net_amount, back AS has_return, segment AS customer_segment FROM d_ord""")
MONTHLY = ("month:d year:i month_number:i year_month:s orders:i cancelled_orders:i active_customers:i units_sold:i gross_sales_incl_gst:f net_revenue:f cogs:f gross_profit:f"
           " gross_margin_pct:f avg_order_value:f discounts:f refunded_net:f online_orders:i")
oracle("vw_monthly_sales", MONTHLY, "SELECT * FROM d_month")
oracle("vw_product_performance",
       "product_id:i sku:s product_name:s brand:s category:s supplier:s is_active:b unit_price:f unit_cost:f launch_date:d orders:i units_sold:i net_revenue:f gross_profit:f margin_pct:f"
       " units_returned:i return_rate_pct:f first_sale_date:d last_sale_date:d units_90d:i sales_velocity_per_day:f units_in_stock:i inventory_value:f days_of_cover:f"
       " inventory_turnover_12m:f revenue_rank:i revenue_share_pct:f cumulative_revenue_pct:f abc_class:s product_class:s", "SELECT * FROM d_product")
oracle("vw_customer_summary",
       "customer_id:i customer_name:s email:s city:s state:s segment:s registration_date:d is_active:b orders:i net_revenue:f gross_profit:f avg_order_value:f first_order_date:d"
       " last_order_date:d cohort_month:d recency_days:i r_score:i f_score:i m_score:i is_repeat_customer:b active_span_days:i activity_status:s rfm_segment:s",
       "SELECT * FROM d_customer")
oracle("vw_inventory_health",
       "inventory_id:i store_id:i store_name:s product_id:i product_name:s category:s supplier:s quantity_on_hand:i reserved_quantity:i available_quantity:i reorder_level:i"
       " max_stock_level:i unit_cost:f inventory_value:f units_sold_90d:i units_sold_365d:i avg_daily_demand:f days_of_cover:f last_restocked_date:d days_since_restock:i"
       " inbound_quantity:i suggested_order_qty:i health_status:s", "SELECT * FROM d_stock")
oracle("vw_store_performance",
       "store_id:i store_code:s store_name:s store_type:s city:s state:s region:s opened_date:d orders:i units:i customers:i net_revenue:f gross_profit:f avg_order_value:f"
       " repeat_customer_rate_pct:f return_rate_pct:f inventory_value:f months_open:f revenue_per_month:f revenue_per_month_index_vs_stores:f growth_2000_vs_1999_pct:f"
       " revenue_rank:i revenue_share_pct:f", "SELECT * FROM d_store")
oracle("vw_category_performance",
       "category_id:i category_name:s year:i orders:i units_sold:i net_revenue:f gross_profit:f margin_pct:f units_returned:i unit_return_rate_pct:f yoy_growth_pct:f"
       " share_of_year_revenue_pct:f", "SELECT * FROM d_cat")
oracle("vw_supplier_performance",
       "supplier_id:i supplier_name:s city:s state:s is_active:b promised_lead_days:i products:i net_revenue_of_products:f total_pos:i received_pos:i purchase_spend:f on_time_pct:f"
       " avg_days_vs_expected:f actual_lead_days:f lead_time_gap_days:f fill_rate_pct:f open_pos:i overdue_pos:i missing_contact_info:b", "SELECT * FROM d_sup")
oracle("vw_return_analysis",
       "return_date:t return_day:d return_month:d order_id:i order_date:t order_day:d days_to_return:f return_reason:s store_id:i store_name:s channel:s customer_segment:s product_id:i"
       " product_name:s category:s units_returned:i units_in_line:i refund_amount:f refund_net_of_gst:f cost_value:f restocked:b", "SELECT * FROM d_ret")
