"""The retail model over the driver's tables, as DuckDB CTEs (names start with m_), and shared aggregates (x_)."""
from .compose import cte

M = "CAST(0.01 AS DECIMAL(3,2))"
cte("m_seg", "SELECT unnest(range(1, 6)) AS segment_id, unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) AS segment_name")
cte("m_cat", """SELECT * FROM (VALUES (1,'LARGE',20),(2,'ECONOMY',21),(3,'MEDIUM',20),(4,'PROMO',21),(5,'SMALL',20),(6,'STANDARD',20),
 (11,'economy',21),(12,'Promo',4),(20,'Core range',NULL),(21,'Value range',NULL),(30,'Seasonal',21)) AS v(category_id, category_name, parent_id)""")
cte("m_canon", """SELECT a.category_id, min(b.category_id) AS canonical_id, arg_min(b.category_name, b.category_id) AS canonical_name
 FROM m_cat a JOIN m_cat b ON lower(a.category_name) = lower(b.category_name) GROUP BY a.category_id""")
cte("m_su", """SELECT s_suppkey AS supplier_id, s_name AS supplier_name, CASE WHEN s_suppkey % 10 <> 3 THEN 's' || s_suppkey || '@example.com' END AS contact_email,
 CASE WHEN s_suppkey % 10 <> 4 THEN '+91 8' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS contact_phone, 'City ' || s_nationkey AS city,
 'State ' || (s_nationkey % 5) AS state, CASE WHEN s_suppkey % 15 <> 7 THEN 'GST' || s_suppkey END AS gstin, 8 + s_suppkey % 12 AS lead,
 s_suppkey % 8 <> 5 AS is_active FROM supplier""")
cte("m_price", """SELECT *, CASE p_size % 4 WHEN 0 THEN c // 2 WHEN 1 THEN c WHEN 2 THEN c * 4 ELSE c * 12 END AS pc
 FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)""")
cte("m_pr", f"""SELECT p_partkey AS product_id, 'SKU-' || p_partkey AS sku, p_name AS product_name, CASE WHEN p_partkey % 47 <> 0 THEN p_brand END AS brand,
 CASE WHEN p_partkey % 53 = 0 THEN NULL WHEN p_type = 'ECONOMY' AND p_partkey % 7 = 0 THEN 11 WHEN p_type = 'PROMO' AND p_partkey % 5 = 0 THEN 12
  ELSE list_position(['LARGE','ECONOMY','MEDIUM','PROMO','SMALL','STANDARD'], p_type) END AS category_id,
 CASE WHEN p_partkey % 43 <> 0 AND (p_partkey % n) % 19 <> 4 THEN p_partkey % n END AS supplier_id,
 CAST(CAST(pc * (55 + p_partkey % 30) // 100 AS DECIMAL(14,0)) * {M} AS DECIMAL(12,2)) AS unit_cost,
 CAST(CAST(pc AS DECIMAL(14,0)) * {M} AS DECIMAL(12,2)) AS unit_price,
 CASE p_size % 4 WHEN 0 THEN 5 WHEN 1 THEN 12 WHEN 2 THEN 18 ELSE 28 END AS gst_rate,
 CASE WHEN p_partkey % 61 <> 0 THEN DATE '1993-06-01' + CAST(p_partkey * 7 % 2000 AS INTEGER) END AS launch_date, p_partkey % 13 <> 0 AS is_active
 FROM m_price, (SELECT count(*) AS n FROM supplier)""")
cte("m_st", """SELECT n_nationkey AS store_id, 'ST' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS store_code, n_name AS store_name,
 CASE WHEN n_nationkey = 0 THEN 'ONLINE_WAREHOUSE' ELSE 'STORE' END AS store_type, 'City ' || n_nationkey AS city,
 'State ' || n_regionkey || '-' || (n_nationkey % 2) AS state, r_name AS region, DATE '1993-01-01' + n_nationkey * 61 AS opened_date
 FROM nation JOIN region ON n_regionkey = r_regionkey""")
cte("m_em", """SELECT s_suppkey AS employee_id, 'Staff No ' || s_suppkey AS who, s_suppkey % 25 AS store_id,
 CASE WHEN s_suppkey < 25 THEN NULL WHEN s_suppkey < 50 THEN s_suppkey - 25 ELSE s_suppkey % 25 + 25 END AS manager_id,
 CASE WHEN s_suppkey < 25 THEN 'Store Manager' WHEN s_suppkey < 50 THEN 'Team Lead' ELSE 'Sales Associate' END AS job_title,
 DATE '1988-01-01' + CAST(s_suppkey * 7919 % 3000 AS INTEGER) AS hire_date, s_suppkey % 11 <> 6 AS is_active FROM supplier""")
cte("m_cu", """SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 31 = 0 THEN 'AMIT' WHEN c_custkey % 37 = 0 THEN 'neha ' ELSE 'Customer' END AS first_name,
 CASE WHEN c_custkey % 41 <> 0 THEN substr(c_name, 10) END AS last_name,
 CASE c_custkey % 50 WHEN 7 THEN NULL WHEN 8 THEN 'user..' || c_custkey || '@example.com' WHEN 9 THEN ' USER' || (c_custkey - 3) || '@Example.com '
  ELSE 'user' || c_custkey || '@example.com' END AS email,
 CASE c_custkey % 60 WHEN 11 THEN NULL WHEN 12 THEN '12345' ELSE '+91 9' || lpad(CAST(c_custkey % 1000000000 AS VARCHAR), 9, '0') END AS phone,
 CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender,
 CASE c_custkey % 70 WHEN 13 THEN DATE '1900-01-01' WHEN 14 THEN NULL ELSE DATE '1950-01-01' + CAST(c_custkey % 18000 AS INTEGER) END AS date_of_birth,
 CASE WHEN c_custkey % 45 <> 5 THEN 'City ' || c_nationkey END AS city, 'State ' || (c_nationkey % 5) AS state,
 CASE WHEN c_custkey % 40 <> 0 THEN list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) END AS segment_id,
 CASE WHEN c_custkey % 40 <> 0 THEN c_mktsegment END AS segment_name,
 DATE '1994-01-01' + CAST(c_custkey * 37 % 1200 AS INTEGER) AS registration_date, c_custkey % 9 <> 0 AS is_active FROM customer""")
cte("m_promo", """SELECT id AS promotion_id, code AS promo_code, kind AS discount_type, CAST(v AS DOUBLE) AS discount_value, CAST(s AS DATE) AS a, CAST(s AS DATE) + 29 AS z
 FROM (VALUES (5,'SPRING96','PERCENT',5,'1996-03-01'),(6,'SPRING97','PERCENT',6,'1997-03-01'),(7,'SPRING98','FLAT',70,'1998-03-01'),
 (8,'SPRING99','PERCENT',8,'1999-03-01'),(9,'SPRING00','FLAT',90,'2000-03-01'),(10,'AUTUMN00','PERCENT',10,'2000-09-01')) AS v(id, code, kind, v, s)""")
cte("m_so", """SELECT o_orderkey AS order_id, o_custkey AS customer_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_orderkey % 24 + 1 END AS store_id,
 CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey % 24 + 1 + (o_orderkey // 24) % 3 * 25 END AS employee_id, o_orderdate AS ts,
 CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, year(o_orderdate) AS yr,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'ONLINE' ELSE 'IN_STORE' END AS channel,
 CASE WHEN o_orderstatus = 'P' THEN 'CANCELLED' ELSE 'COMPLETED' END AS status, CAST(o_totalprice AS DECIMAL(12,2)) AS total,
 CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.15 AS DECIMAL(2,2)) AS gst, CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.85 AS DECIMAL(2,2)) AS net,
 CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.05 AS DECIMAL(2,2)) ELSE 0 END AS disc FROM orders""")
cte("m_done", "SELECT * FROM m_so WHERE status = 'COMPLETED'")
cte("m_it", f"""SELECT order_id, product_id, promotion_id, qty, CAST(CAST(pc AS DECIMAL(14,0)) * {M} AS DECIMAL(12,2)) AS price,
  CAST(CAST(pc * (55 + product_id % 30) // 100 AS DECIMAL(14,0)) * {M} AS DECIMAL(12,2)) AS cost, gross * rate AS disc,
  gross * (CAST(1 AS DECIMAL(1,0)) - rate) AS line_total, tax, flag, line_no, linestatus, ship
 FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id, CASE WHEN l_discount >= 0.05 THEN CAST(round(l_discount * 100) AS INTEGER) END AS promotion_id,
  CAST(l_quantity AS INTEGER) AS qty, CAST(l_extendedprice AS DECIMAL(12,2)) AS gross, CAST(l_discount AS DECIMAL(4,2)) AS rate,
  (2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS pc,
  CAST(l_tax AS DECIMAL(4,2)) * 100 AS tax, l_returnflag AS flag, l_linenumber AS line_no, l_linestatus AS linestatus, l_shipdate AS ship FROM lineitem)""")
cte("m_sl", """SELECT i.order_id, i.product_id, i.promotion_id, i.qty, i.price, i.cost, i.disc, i.line_total, i.flag, i.ship, i.line_no,
  o.customer_id, o.store_id, o.employee_id, o.channel, o.ts, o.day, o.month, o.yr, i.qty * i.price AS gross,
  CAST(i.line_total AS DOUBLE) / (1e0 + CAST(i.tax AS DOUBLE) / 100) AS net, i.qty * i.cost AS cogs,
  CAST(i.line_total AS DOUBLE) / (1e0 + CAST(i.tax AS DOUBLE) / 100) - CAST(i.qty * i.cost AS DOUBLE) AS profit
 FROM m_it i JOIN m_done o ON i.order_id = o.order_id""")
cte("m_rl", """SELECT order_id, product_id, qty, line_total AS refund, CAST(line_total AS DOUBLE) / (1e0 + CAST(tax AS DOUBLE) / 100) AS refund_net,
  qty * cost AS cost_value, linestatus = 'O' AS restocked, ship, CAST(date_trunc('month', ship) AS DATE) AS month,
  CASE line_no % 4 WHEN 0 THEN 'DEFECTIVE' WHEN 1 THEN 'WRONG_ITEM' WHEN 2 THEN 'NOT_AS_DESCRIBED' ELSE 'CHANGED_MIND' END AS reason
 FROM m_it WHERE flag = 'R'""")
cte("m_pay", """SELECT o_orderkey AS order_id, o_orderdate AS ts, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'UPI' WHEN '2' THEN 'CARD' WHEN '3' THEN 'CASH'
  WHEN '4' THEN 'NET_BANKING' ELSE 'WALLET' END AS method,
 CAST(o_totalprice AS DECIMAL(12,2)) - CASE WHEN o_orderkey % 500 = 3 THEN 1 ELSE 0 END AS amount,
 CASE WHEN o_orderkey % 20 = 0 THEN 'FAILED' WHEN o_orderkey % 33 = 5 THEN 'REFUNDED' ELSE 'SUCCESS' END AS status FROM orders WHERE o_orderkey % 20 <> 1""")
cte("m_inv", """SELECT product_id * 4 + i AS inventory_id, product_id, store_id, greatest((product_id * 7 + store_id * 13) % 120 - 8, 0) AS on_hand,
  greatest((product_id * 7 + store_id * 13) % 120 - 8, 0) // 10 AS reserved, 10 + product_id % 20 AS reorder, 60 + product_id % 40 AS ceiling,
  CASE WHEN product_id % 29 <> 0 THEN DATE '2001-08-01' - CAST((product_id * 11 + store_id * 17) % 500 AS INTEGER) END AS restocked_on
 FROM (SELECT p_partkey AS product_id, i, (p_partkey * 7 + i * 6) % 25 AS store_id FROM part, (SELECT unnest(range(4)) AS i))""")
cte("m_stock", "SELECT v.*, p.unit_cost, v.on_hand * p.unit_cost AS value FROM m_inv v JOIN m_pr p ON v.product_id = p.product_id")
cte("m_po", """SELECT *, CAST(day + CAST(lead AS INTEGER) AS DATE) AS due,
  CASE WHEN status = 'RECEIVED' THEN day + CAST(lead - 4 + ck % 9 AS INTEGER) END AS got
 FROM (SELECT o_orderkey AS purchase_id, o_orderkey % n AS supplier_id, o_orderkey % 25 AS store_id, CAST(o_orderdate AS DATE) AS day, o_custkey AS ck,
  8 + (o_orderkey % n) % 12 AS lead, CASE WHEN o_orderstatus = 'P' THEN 'ORDERED' ELSE 'RECEIVED' END AS status,
  CAST(o_totalprice AS DECIMAL(12,2)) AS total FROM orders, (SELECT count(*) AS n FROM supplier))""")
cte("m_poi", "SELECT order_id AS purchase_id, product_id, qty AS ordered, CASE WHEN line_no = 1 THEN qty - 1 ELSE qty END AS received, cost FROM m_it")
cte("m_ledger", """SELECT store_id, product_id, 'OPENING' AS kind, 500 AS change, TIMESTAMP '1995-01-01' AS ts, NULL AS ref FROM m_inv
 UNION ALL SELECT store_id, product_id, 'ADJUSTMENT', -2, TIMESTAMP '2001-06-30', NULL FROM m_inv WHERE on_hand % 10 = 3
 UNION ALL SELECT store_id, product_id, 'SALE', -qty, ts, order_id FROM m_sl
 UNION ALL SELECT o.store_id, r.product_id, 'RETURN', r.qty, r.ship, r.order_id FROM m_rl r JOIN m_so o ON o.order_id = r.order_id WHERE r.restocked
 UNION ALL SELECT p.store_id, i.product_id, 'PURCHASE', i.received, CAST(p.got AS TIMESTAMP), p.purchase_id FROM m_poi i JOIN m_po p USING (purchase_id)
  WHERE p.status = 'RECEIVED'""")
cte("m_cal", "SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d")
cte("m_asof", "SELECT CAST(max(o_orderdate) AS DATE) AS d, CAST(min(o_orderdate) AS DATE) AS f FROM orders")
cte("m_ev", """SELECT event_id AS order_id, user_id AS customer_id, ts, CAST(value AS DECIMAL(12,2)) * CAST(0.85 AS DECIMAL(2,2)) AS net
 FROM events WHERE event_type = 'purchase'""")

cte("x_prod", "SELECT product_id, sum(qty) AS units, sum(net) AS net, sum(profit) AS profit FROM m_sl GROUP BY product_id")
cte("x_month", "SELECT month, sum(net) AS net FROM m_done GROUP BY month")
cte("x_cust", """SELECT customer_id, count(*) AS n, sum(net) AS net, sum(total) AS gross, min(day) AS first_day, max(day) AS last_day,
  (SELECT d FROM m_asof) - max(day) AS recency FROM m_done GROUP BY customer_id""")
cte("x_store", "SELECT store_id, count(*) AS n, sum(net) AS net, sum(total) AS gross FROM m_done GROUP BY store_id")
cte("x_back", "SELECT product_id, sum(qty) AS back, sum(refund) AS refund FROM m_rl GROUP BY product_id")
cte("x_flag", "SELECT o.*, o.order_id IN (SELECT order_id FROM m_rl) AS back FROM m_so o")
cte("x_goods", """SELECT p.*, c.canonical_id, c.canonical_name, coalesce(c.canonical_name, '(no category)') AS category
 FROM m_pr p LEFT JOIN m_canon c ON c.category_id = p.category_id""")
cte("x_need", """SELECT store_id, product_id, sum(qty) FILTER (day > d - 90) AS u90, sum(qty) AS u365 FROM m_sl, m_asof WHERE day > d - 365
 GROUP BY store_id, product_id""")
cte("x_pos", """SELECT v.*, coalesce(n.u90, 0) AS u90, coalesce(n.u365, 0) AS u365,
  CASE WHEN on_hand = 0 THEN 'OUT_OF_STOCK' WHEN coalesce(n.u365, 0) = 0 THEN 'DEAD_STOCK' WHEN on_hand <= reorder THEN 'LOW_STOCK'
   WHEN on_hand > ceiling OR on_hand / (CAST(coalesce(n.u90, 0) AS DOUBLE) / 90 + 0.000001e0) > 180 THEN 'OVERSTOCKED' ELSE 'HEALTHY' END AS status
 FROM m_stock v LEFT JOIN x_need n ON n.store_id = v.store_id AND n.product_id = v.product_id""")
cte("x_rfm", """SELECT *, CASE WHEN recency <= 30 THEN 5 WHEN recency <= 90 THEN 4 WHEN recency <= 180 THEN 3 WHEN recency <= 365 THEN 2 ELSE 1 END AS r,
  CASE WHEN n >= 13 THEN 5 WHEN n >= 7 THEN 4 WHEN n >= 4 THEN 3 WHEN n >= 2 THEN 2 ELSE 1 END AS f, ntile(5) OVER (ORDER BY net, customer_id) AS m
 FROM x_cust""")
cte("x_label", """SELECT *, CASE WHEN r >= 4 AND f >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 3 THEN 'Loyal Customers' WHEN r >= 3 THEN 'Potential Loyalists'
  WHEN f >= 3 THEN 'At Risk' ELSE 'Lost Customers' END AS label FROM x_rfm""")
cte("x_prodstock", "SELECT product_id, sum(on_hand) AS units, sum(value) AS value FROM m_stock GROUP BY product_id")
cte("x_sold90", "SELECT product_id, sum(qty) AS u90 FROM m_sl, m_asof WHERE day > d - 90 GROUP BY product_id")
cte("x_year12", """SELECT product_id, sum(net) AS r12, sum(cogs) AS c12, sum(qty) FILTER (day > d - 90) AS u90 FROM m_sl, m_asof WHERE day > d - 365 GROUP BY product_id""")
cte("x_supo", """SELECT supplier_id, count(*) AS pos, count(*) FILTER (status = 'RECEIVED') AS rec, count(*) FILTER (status = 'RECEIVED' AND got <= due) AS on_time,
  avg(got - due) AS delay, max(got - due) AS worst, avg(got - day) AS lead_days, count(*) FILTER (status = 'ORDERED') AS open_pos,
  count(*) FILTER (status = 'ORDERED' AND due < d) AS overdue, max(d - due) FILTER (status = 'ORDERED') AS late, sum(total) AS spend,
  sum(total) FILTER (status = 'ORDERED') AS open_value FROM m_po, m_asof GROUP BY supplier_id""")
cte("x_fill", """SELECT p.supplier_id, sum(i.ordered) AS o, sum(i.received) AS g, count(*) FILTER (i.received < i.ordered) AS short FROM m_poi i
 JOIN m_po p USING (purchase_id) WHERE p.status = 'RECEIVED' GROUP BY p.supplier_id""")
cte("x_gap", "SELECT customer_id, day, day - lag(day) OVER (PARTITION BY customer_id ORDER BY day, order_id) AS gap FROM m_done")
