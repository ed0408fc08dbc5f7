from .compose import oracle

TREE = """tree AS (SELECT category_id, category_id AS root, 1 AS depth, CAST(category_name AS VARCHAR) AS path FROM m_cat WHERE parent_id IS NULL
 UNION ALL SELECT c.category_id, t.root, t.depth + 1, t.path || ' > ' || c.category_name FROM m_cat c, tree t WHERE c.parent_id = t.category_id)"""
ORG = """org AS (SELECT employee_id, store_id, 1 AS depth FROM m_em WHERE manager_id IS NULL
 UNION ALL SELECT e.employee_id, e.store_id, o.depth + 1 FROM m_em e, org o WHERE e.manager_id = o.employee_id)"""
oracle("q100_category_tree", "path:s depth:i direct_products:i",
       f"""WITH RECURSIVE {TREE} SELECT path, depth, (SELECT count(*) FROM m_pr p WHERE p.category_id = t.category_id) AS direct_products FROM tree t""")
oracle("q101_root_categories", "top_level_category:s net_revenue:f share_pct:f",
       f"""WITH RECURSIVE {TREE} SELECT c.category_name AS top_level_category, round(sum(x.net), 0) AS net_revenue, round(100e0 * sum(x.net) / sum(sum(x.net)) OVER (), 1) AS share_pct
       FROM x_prod x JOIN m_pr p ON p.product_id = x.product_id JOIN tree t ON t.category_id = p.category_id JOIN m_cat c ON c.category_id = t.root GROUP BY 1""")
oracle("q102_reporting_depth", "store_name:s managers:i direct_reports:i max_depth:i",
       f"""WITH RECURSIVE {ORG} SELECT s.store_name, count(*) FILTER (depth = 1) AS managers, count(*) FILTER (depth = 2) AS direct_reports, max(depth) AS max_depth
       FROM org JOIN m_st s ON s.store_id = org.store_id GROUP BY 1""")
oracle("q103_category_mismatch", "category:s match_type:s revenue:f",
       """SELECT category_name AS category, 'Category without sales' AS match_type, NULL AS revenue FROM m_cat c
        WHERE NOT EXISTS (SELECT 1 FROM x_prod x JOIN m_pr p ON p.product_id = x.product_id WHERE p.category_id = c.category_id)
       UNION ALL SELECT '(products with NO category)', 'Sales without a category', round(sum(x.net), 0) FROM x_prod x JOIN m_pr p ON p.product_id = x.product_id
        WHERE p.category_id IS NULL HAVING count(*) > 0""")
oracle("q104_customer_sets", "segment:s customers:i",
       """SELECT t.segment, count(k.customer_id) AS customers FROM (VALUES ('Bought in 1999 and 2000 (retained)', true, true), ('Bought in 1999 but not in 2000 (lapsed)', true, false),
        ('Bought in 2000 but not in 1999 (new or returning)', false, true)) t(segment, a, b)
       LEFT JOIN (SELECT customer_id, bool_or(yr = 1999) AS a, bool_or(yr = 2000) AS b FROM m_done GROUP BY 1) k ON k.a = t.a AND k.b = t.b GROUP BY 1""")
oracle("q105_days_without_sales", "day:d weekday:s",
       """SELECT d AS day, strftime(d, '%a') AS weekday FROM m_cal WHERE d BETWEEN DATE '2000-12-01' AND DATE '2000-12-31'
       AND d NOT IN (SELECT o.day FROM m_done o JOIN m_st s ON s.store_id = o.store_id WHERE s.store_code = 'ST03')""")
oracle("q106_trading_streaks", "store_name:s streak_start:d streak_end:d days_in_streak:i",
       """SELECT s.store_name, a AS streak_start, z AS streak_end, n AS days_in_streak FROM (SELECT store_id, min(day) AS a, max(day) AS z, count(*) AS n,
        row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, min(day)) AS k FROM (SELECT store_id, day, day - CAST(row_number() OVER (PARTITION BY store_id ORDER BY day) AS INTEGER) AS g
         FROM (SELECT DISTINCT store_id, day FROM m_done)) GROUP BY store_id, g) x JOIN m_st s ON s.store_id = x.store_id WHERE k = 1""")
oracle("q107_top_products_per_store", "store_name:s product_name:s net_revenue:f",
       """SELECT store_name, product_name, round(net, 0) AS net_revenue FROM (SELECT s.store_name, p.product_name, sum(l.net) AS net,
        row_number() OVER (PARTITION BY s.store_name ORDER BY sum(l.net) DESC, p.product_name) AS k FROM m_sl l JOIN m_pr p ON p.product_id = l.product_id
        JOIN m_st s ON s.store_id = l.store_id GROUP BY 1, 2) WHERE k <= 3""")
MEAN = "(SELECT customer_id, CAST(sum(total) AS DOUBLE) / count(*) AS v FROM m_done GROUP BY 1) a ON a.customer_id = o.customer_id"
BIG = "o.total > 100000 AND CAST(o.total AS DOUBLE) > 3 * a.v"
oracle("q108_outsized_orders", "order_id:i customer_id:i total_amount:f customer_avg_order:f",
       f"""SELECT o.order_id, o.customer_id, o.total AS total_amount, round(a.v, 0) AS customer_avg_order FROM m_done o JOIN {MEAN} WHERE {BIG}
       ORDER BY o.total DESC, o.order_id LIMIT 10""")
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
oracle("q109_category_region", "category_name:s africa:f america:f asia:f europe:f middle_east:f asia_share_pct:f",
       f"""SELECT g.canonical_name AS category_name, {', '.join(f"round(sum(l.net) FILTER (s.region = '{r}'), 0) AS {r.lower().replace(' ', '_')}" for r in REGIONS)},
       round(100e0 * sum(l.net) FILTER (s.region = 'ASIA') / sum(l.net), 1) AS asia_share_pct FROM m_sl l JOIN x_goods g ON g.product_id = l.product_id
       JOIN m_st s ON s.store_id = l.store_id WHERE g.canonical_id IS NOT NULL GROUP BY 1""")
oracle("q110_value_percentiles",
       "channel:s median:f p90:f p99:f outlier_fence:f outlier_orders:i outlier_share_pct:f",
       """SELECT s.channel, round(q[2], 0) AS median, round(q[4], 0) AS p90, round(q[5], 0) AS p99, round(q[3] + 1.5 * (q[3] - q[1]), 0) AS outlier_fence,
       count(*) FILTER (o.total > q[3] + 1.5 * (q[3] - q[1])) AS outlier_orders,
       round(100e0 * count(*) FILTER (o.total > q[3] + 1.5 * (q[3] - q[1])) / count(*), 1) AS outlier_share_pct
       FROM (SELECT channel, quantile_cont(CAST(total AS DOUBLE), [0.25, 0.5, 0.75, 0.9, 0.99]) AS q FROM m_done GROUP BY 1) s JOIN m_done o ON o.channel = s.channel GROUP BY s.channel, q""")
oracle("q111_weekly_revenue", "week_start:d revenue:f wow_change_pct:f moving_avg_4w:f",
       """SELECT w AS week_start, round(net, 0) AS revenue, round(100e0 * (net / lag(net) OVER (ORDER BY w) - 1), 1) AS wow_change_pct,
       round(avg(net) OVER (ORDER BY w ROWS 3 PRECEDING), 0) AS moving_avg_4w FROM (SELECT date_trunc('week', day) AS w, CAST(sum(net) AS DOUBLE) AS net FROM m_done GROUP BY 1)
       ORDER BY w DESC LIMIT 12""")
oracle("q112_acquisition", "month:d new_customers:i cumulative_customers:i",
       """SELECT m AS month, count(*) AS new_customers, sum(count(*)) OVER (ORDER BY m) AS cumulative_customers
       FROM (SELECT customer_id, min(month) AS m FROM m_done GROUP BY 1) GROUP BY m""")
oracle("q113_first_purchase", "first_purchase_category:s customers:i repeat_rate_pct:f",
       """SELECT coalesce(c.category_name, '(no category)') AS first_purchase_category, count(*) AS customers, round(100e0 * count(*) FILTER (x.n > 1) / count(*), 1) AS repeat_rate_pct
       FROM (SELECT f.customer_id, i.product_id FROM (SELECT customer_id, arg_min(order_id, (day, order_id)) AS order_id FROM m_done GROUP BY 1) f JOIN m_it i ON i.order_id = f.order_id
        QUALIFY row_number() OVER (PARTITION BY f.customer_id ORDER BY i.line_total DESC, i.product_id) = 1) k JOIN x_cust x ON x.customer_id = k.customer_id
       JOIN m_pr p ON p.product_id = k.product_id LEFT JOIN m_cat c ON c.category_id = p.category_id GROUP BY 1 HAVING count(*) >= 100""")
oracle("q114_reactivated", "reactivation_orders:i reactivated_customers:i avg_silence_days:f longest_silence_days:i",
       """SELECT count(*) AS reactivation_orders, count(DISTINCT customer_id) AS reactivated_customers, round(avg(gap), 0) AS avg_silence_days, max(gap) AS longest_silence_days
       FROM x_gap WHERE gap > 180""")
W = "round(100e0 * count(*) FILTER (w {0}) / count(*), 1) AS {1}"
oracle("q115_second_order",
       "customers_measured:i second_order_within_30d_pct:f second_order_within_60d_pct:f second_order_within_90d_pct:f never_came_back_pct:f",
       f"""SELECT count(*) AS customers_measured, {', '.join(W.format(f'<= {d}', f'second_order_within_{d}d_pct') for d in (30, 60, 90))}, {W.format('IS NULL', 'never_came_back_pct')}
       FROM (SELECT lead(day) OVER k - day AS w, day, row_number() OVER k AS n FROM m_done WINDOW k AS (PARTITION BY customer_id ORDER BY day, order_id)), m_asof
       WHERE n = 1 AND day <= d - 90""")

# ---- classic patterns
oracle("q201_third_value", "third_highest_distinct_value:f",
       "SELECT total AS third_highest_distinct_value FROM (SELECT DISTINCT total FROM m_done) ORDER BY total DESC LIMIT 1 OFFSET 2")
oracle("q202_duplicate_customers", "customer_id:i first_name:s email:s registration_date:d action:s",
       """SELECT customer_id, first_name, email, registration_date, 'duplicate - candidate to merge' AS action FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(email))
       ORDER BY registration_date, customer_id) AS k FROM m_cu WHERE email IS NOT NULL) WHERE k > 1 ORDER BY email, customer_id LIMIT 10""")
oracle("q203_bought_all", "customer_id:i categories_bought:i total_spend:f",
       """SELECT l.customer_id, count(DISTINCT p.category_id) AS categories_bought, round(sum(l.line_total), 0) AS total_spend FROM m_sl l JOIN m_pr p ON p.product_id = l.product_id
       WHERE p.category_id IN (SELECT category_id FROM m_cat WHERE category_name IN ('LARGE', 'MEDIUM', 'SMALL')) GROUP BY 1 HAVING count(DISTINCT p.category_id) = 3
       ORDER BY sum(l.line_total) DESC, 1 LIMIT 10""")
oracle("q204_three_months_running", "customers_with_3_consecutive_months:i",
       """SELECT count(DISTINCT a.customer_id) AS customers_with_3_consecutive_months FROM (SELECT DISTINCT customer_id, month FROM m_done) a
       JOIN (SELECT DISTINCT customer_id, month FROM m_done) b ON b.customer_id = a.customer_id AND b.month = a.month + INTERVAL 1 MONTH
       JOIN (SELECT DISTINCT customer_id, month FROM m_done) c ON c.customer_id = a.customer_id AND c.month = a.month + INTERVAL 2 MONTH""")
oracle("q205_year_to_date", "month:d revenue:f ytd_revenue:f",
       "SELECT month, round(net, 0) AS revenue, round(sum(net) OVER (ORDER BY month), 0) AS ytd_revenue FROM x_month WHERE year(month) = 2000")
oracle("q206_store_median", "store_name:s mean_order_value:f median_order_value:f",
       """SELECT s.store_name, round(CAST(sum(o.total) AS DOUBLE) / count(*) + 1e-7, 0) AS mean_order_value, round(quantile_cont(CAST(o.total AS DOUBLE), 0.5), 0) AS median_order_value
       FROM m_done o JOIN m_st s ON s.store_id = o.store_id GROUP BY 1""")
oracle("q207_top_with_ties", "category_name:s product_name:s units:i dr:i",
       """SELECT c.category_name, t.product_name, t.u AS units, t.k AS dr FROM (SELECT p.category_id, p.product_name, sum(x.units) AS u,
        dense_rank() OVER (PARTITION BY p.category_id ORDER BY sum(x.units) DESC) AS k FROM x_prod x JOIN m_pr p ON p.product_id = x.product_id
        WHERE p.category_id IN (1, 2, 3) GROUP BY 1, 2) t JOIN m_cat c ON c.category_id = t.category_id WHERE t.k <= 3""")
oracle("q208_rising_orders", "customers_rising_three_orders:i customers_with_three_orders:i",
       """SELECT count(*) FILTER (v[1] > v[2] AND v[2] > v[3]) AS customers_rising_three_orders, count(*) FILTER (len(v) >= 3) AS customers_with_three_orders
       FROM (SELECT customer_id, list(total ORDER BY day DESC, order_id DESC) AS v FROM m_done GROUP BY 1)""")
oracle("q209_hired_before_manager", "employee:s employee_hired:d manager:s manager_hired:d",
       """SELECT e.who AS employee, e.hire_date AS employee_hired, b.who AS manager, b.hire_date AS manager_hired FROM m_em e JOIN m_em b ON b.employee_id = e.manager_id
       WHERE e.hire_date < b.hire_date ORDER BY e.hire_date, e.employee_id LIMIT 10""")
oracle("q210_above_category_average", "via_window_function:i",
       """SELECT count(*) AS via_window_function FROM m_pr p JOIN (SELECT category_id, CAST(sum(unit_price) AS DOUBLE) / count(*) AS v FROM m_pr WHERE category_id IS NOT NULL GROUP BY 1) a
       ON a.category_id = p.category_id WHERE CAST(p.unit_price AS DOUBLE) > a.v""")
oracle("q211_not_in_trap", "not_in_result:i not_exists_result:i",
       """SELECT (SELECT count(*) FROM m_cat WHERE category_id NOT IN (SELECT category_id FROM m_pr)) AS not_in_result,
       (SELECT count(*) FROM m_cat ANTI JOIN m_pr USING (category_id)) AS not_exists_result""")
oracle("q212_month_movements", "movement:s months:i",
       """SELECT CASE WHEN b IS NULL THEN 'first month' WHEN n > 1.02 * b THEN 'growth (more than +2 pct)' WHEN n < 0.98 * b THEN 'decline (more than -2 pct)'
       ELSE 'flat (within 2 pct)' END AS movement, count(*) AS months FROM (SELECT CAST(net AS DOUBLE) AS n, CAST(lag(net) OVER (ORDER BY month) AS DOUBLE) AS b FROM x_month) GROUP BY 1""")
oracle("q213_sold_everywhere", "products_sold_in_every_store:i",
       """SELECT count(*) AS products_sold_in_every_store FROM (SELECT l.product_id FROM m_sl l JOIN m_st s ON s.store_id = l.store_id WHERE s.store_type = 'STORE' GROUP BY 1
       HAVING count(DISTINCT l.store_id) = (SELECT count(*) FROM m_st WHERE store_type = 'STORE'))""")
oracle("q214_share_of_region", "region:s store_name:s revenue:f share_of_region_pct:f",
       """SELECT s.region, s.store_name, round(x.net, 0) AS revenue, round(100e0 * x.net / sum(x.net) OVER (PARTITION BY s.region), 1) AS share_of_region_pct
       FROM x_store x JOIN m_st s ON s.store_id = x.store_id""")

# ---- data quality
EMAIL = r"(NOT regexp_matches(email, '^[^@\s]+@[^@\s]+[.][A-Za-z]{2,}$') OR contains(email, '..'))"
PHONE = "NOT regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^(91)?[6-9][0-9]{9}$')"
N = {t: f"(SELECT count(*) FROM {t})" for t in ("m_cu", "m_pr", "m_cat", "m_it", "m_so", "m_done", "m_inv", "m_su", "m_pay", "m_rl", "m_po")}


def dup(t: str, key: str) -> str:
    return f"(SELECT count(*) - count(DISTINCT {key}) FROM {t} WHERE {key} IS NOT NULL)"


def where(t: str, p: str) -> str:
    return f"(SELECT count(*) FROM {t} WHERE {p})"


LEDGER = "(SELECT store_id, product_id, sum(change) AS b FROM m_ledger GROUP BY 1, 2)"
MISMATCH = f"(SELECT v.*, coalesce(l.b, 0) AS b FROM m_inv v LEFT JOIN {LEDGER} l USING (store_id, product_id) WHERE v.on_hand <> coalesce(l.b, 0))"
CHECKS = [
    ("customers", "Duplicate-like customers (same e-mail ignoring case/spaces)", "Medium", dup("m_cu", "lower(trim(email))"), N["m_cu"]),
    ("customers", "NULL e-mail", "Low", where("m_cu", "email IS NULL"), N["m_cu"]),
    ("customers", "NULL phone", "Low", where("m_cu", "phone IS NULL"), N["m_cu"]),
    ("customers", "Invalid e-mail format", "Medium", where("m_cu", EMAIL), where("m_cu", "email IS NOT NULL")),
    ("customers", "Invalid phone number (not a 10-digit Indian mobile)", "Medium", where("m_cu", PHONE), where("m_cu", "phone IS NOT NULL")),
    ("customers", "Implausible date of birth (before 1920 or in the future)", "Medium",
     where("m_cu", "date_of_birth < DATE '1920-01-01' OR date_of_birth > DATE '2001-08-01'"), where("m_cu", "date_of_birth IS NOT NULL")),
    ("customers", "Inconsistent name capitalisation or trailing spaces", "Low",
     where("m_cu", "first_name IN (upper(first_name), lower(first_name)) OR first_name <> trim(first_name) OR last_name <> trim(last_name)"), N["m_cu"]),
    ("customers", "Missing city", "Low", where("m_cu", "city IS NULL"), N["m_cu"]),
    ("customers", "No customer segment assigned", "Low", where("m_cu", "segment_id IS NULL"), N["m_cu"]),
    ("products", "Duplicate-like products (same name ignoring case/spaces)", "Medium", dup("m_pr", "lower(trim(product_name))"), N["m_pr"]),
    ("products", "Products without a category", "High", where("m_pr", "category_id IS NULL"), N["m_pr"]),
    ("products", "Products without a supplier", "High", where("m_pr", "supplier_id IS NULL"), N["m_pr"]),
    ("products", "Products without a brand", "Low", where("m_pr", "brand IS NULL"), N["m_pr"]),
    ("categories", "Category names that differ only by capitalisation", "High", dup("m_cat", "lower(category_name)"), N["m_cat"]),
    ("products", "Negative or zero price / cost (blocked by CHECK)", "High", where("m_pr", "unit_price <= 0 OR unit_cost < 0"), N["m_pr"]),
    ("sales_order_items", "Quantity zero or negative (blocked by CHECK)", "High", where("m_it", "qty < 1"), N["m_it"]),
    ("sales_order_items", "Unusually large quantity (25 or more units on one line)", "Medium", where("m_it", "qty > 24"), N["m_it"]),
    ("sales_orders", "Order header total differs from the sum of its lines", "High",
     "(SELECT count(*) FROM m_so o JOIN (SELECT order_id, sum(line_total) AS s FROM m_it GROUP BY 1) i USING (order_id) WHERE abs(o.total - i.s) > 0.05)", N["m_so"]),
    ("multiple", "Orphan records (child rows without a parent)", "High",
     f"{where('m_it', 'order_id NOT IN (SELECT order_id FROM m_so)')} + {where('m_inv', 'product_id NOT IN (SELECT product_id FROM m_pr)')}"
     f" + {where('m_pay', 'order_id NOT IN (SELECT order_id FROM m_so)')} + {where('m_rl', 'order_id NOT IN (SELECT order_id FROM m_so)')}",
     f"{N['m_it']} + {N['m_pay']} + {N['m_rl']} + {N['m_inv']}"),
    ("multiple", "Impossible date order (order before registration, return before order, PO received before ordered)", "High",
     "(SELECT count(*) FROM m_so o JOIN m_cu c USING (customer_id) WHERE o.day < c.registration_date) + (SELECT count(*) FROM m_rl r JOIN m_so o USING (order_id)"
     f" WHERE r.ship < o.ts) + {where('m_po', 'got < day')}", f"{N['m_so']} + {N['m_rl']} + {N['m_po']}"),
    ("sales_orders", "Completed orders with no payment record", "High", "(SELECT count(*) FROM m_done ANTI JOIN m_pay USING (order_id))", N["m_done"]),
    ("sales_orders", "Completed orders where successful payments differ from the order total", "High",
     "(SELECT count(*) FROM m_done o JOIN m_pay p USING (order_id) WHERE p.status = 'SUCCESS' AND abs(o.total - p.amount) > 0.01)", N["m_done"]),
    ("inventory", "Stock on hand differs from the sum of the inventory ledger", "High", f"(SELECT count(*) FROM {MISMATCH})", N["m_inv"]),
    ("inventory", "Positions with zero stock on hand", "Info", where("m_inv", "on_hand = 0"), N["m_inv"]),
    ("products", "Inactive products that still hold stock", "Medium",
     "(SELECT count(DISTINCT product_id) FROM m_pr JOIN m_inv USING (product_id) WHERE NOT is_active AND on_hand > 0)", where("m_pr", "NOT is_active")),
    ("customers", "Customers flagged inactive who ordered in the last 90 days", "Medium",
     "(SELECT count(DISTINCT customer_id) FROM m_cu JOIN m_so USING (customer_id), m_asof WHERE NOT is_active AND day > d - 90)", where("m_cu", "NOT is_active")),
    ("suppliers", "Suppliers missing e-mail, phone or GSTIN", "Medium",
     where("m_su", "contact_email IS NULL OR contact_phone IS NULL OR gstin IS NULL"), N["m_su"]),
    ("products", "Products never sold", "Info", where("m_pr", "product_id NOT IN (SELECT product_id FROM m_it)"), N["m_pr"]),
    ("sales_orders", "Cancelled orders (kept in the data, excluded from KPIs)", "Info", where("m_so", "status = 'CANCELLED'"), N["m_so"]),
    ("inventory_transactions", "Cancelled orders that moved stock (must be none)", "High",
     "(SELECT count(*) FROM m_ledger l JOIN m_so o ON o.order_id = l.ref WHERE l.kind = 'SALE' AND o.status = 'CANCELLED')", where("m_ledger", "kind = 'SALE'")),
]
ROWS = " UNION ALL ".join(
    f"SELECT 'DQ{i:02d}' AS check_id, '{t}' AS table_name, '{n}' AS check_name, '{s}' AS severity, {c} AS issue_count, {w} AS total_rows"
    for i, (t, n, s, c, w) in enumerate(CHECKS, 1))
oracle("q301_scorecard",
       "check_id:s table_name:s check_name:s severity:s issue_count:i total_rows:i issue_pct:f status:s",
       f"""SELECT *, round(100e0 * issue_count / nullif(total_rows, 0), 2) AS issue_pct,
       CASE WHEN issue_count = 0 THEN 'PASS' WHEN severity = 'Info' THEN 'INFO' ELSE 'ATTENTION' END AS status FROM ({ROWS})""")
oracle("q302_duplicate_groups", "normalised_email:s records:i customer_id:i first_name:s",
       """WITH g AS (SELECT lower(trim(email)) AS normalised_email, count(*) AS records FROM m_cu WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10)
       SELECT g.normalised_email, g.records, c.customer_id, c.first_name FROM g JOIN m_cu c ON lower(trim(c.email)) = g.normalised_email""")
# Members are those that stand in a pair of the self join.
oracle("q303_duplicate_products", "name_key:s records:i first_product:i product_id:i sku:s product_name:s",
       """WITH pairs AS (SELECT lower(trim(a.product_name)) AS k, a.product_id AS a, b.product_id AS b FROM m_pr a
         JOIN m_pr b ON lower(trim(a.product_name)) = lower(trim(b.product_name)) AND a.product_id < b.product_id),
       members AS (SELECT k, a AS id FROM pairs UNION SELECT k, b FROM pairs)
       SELECT k AS name_key, count(*) OVER (PARTITION BY k) AS records, min(id) OVER (PARTITION BY k) AS first_product, p.product_id, p.sku, p.product_name
       FROM members JOIN m_pr p ON p.product_id = id""")
oracle("q304_null_profile", "column_name:s null_count:i null_pct:f", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, round(100e0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct FROM m_cu"
    for c in ("email", "phone", "gender", "date_of_birth", "city", "segment_id")))
oracle("q305_invalid_contacts", "issue:s customer_id:i value:s",
       f"""(SELECT 'invalid e-mail' AS issue, customer_id, email AS value FROM m_cu WHERE {EMAIL} ORDER BY customer_id LIMIT 6)
       UNION ALL (SELECT 'invalid phone', customer_id, phone FROM m_cu WHERE {PHONE} ORDER BY customer_id LIMIT 6)""")
oracle("q306_ledger_mismatch", "store_name:s product_name:s recorded_stock:i ledger_stock:i difference:i",
       f"""SELECT s.store_name, p.product_name, v.on_hand AS recorded_stock, v.b AS ledger_stock, v.on_hand - v.b AS difference FROM {MISMATCH} v
       JOIN m_st s ON s.store_id = v.store_id JOIN m_pr p ON p.product_id = v.product_id ORDER BY abs(v.on_hand - v.b) DESC, s.store_name, v.product_id LIMIT 15""")
oracle("q307_extreme_quantities",
       "order_id:i product_name:s quantity:i avg_qty_for_product:f line_total:f order_status:s",
       """SELECT i.order_id, p.product_name, i.qty AS quantity, round(a.v, 1) AS avg_qty_for_product, round(i.line_total, 0) AS line_total, o.status AS order_status FROM m_it i
       JOIN m_so o ON o.order_id = i.order_id JOIN m_pr p ON p.product_id = i.product_id JOIN (SELECT product_id, avg(qty) AS v FROM m_it GROUP BY 1) a ON a.product_id = i.product_id
       ORDER BY i.qty DESC, i.order_id, i.product_id, i.line_total LIMIT 10""")
oracle("q308_unpaid_by_store", "store_name:s orders_without_payment:i order_value:f",
       """SELECT s.store_name, count(*) AS orders_without_payment, round(sum(o.total), 0) AS order_value FROM m_done o ANTI JOIN m_pay p ON p.order_id = o.order_id
       JOIN m_st s ON s.store_id = o.store_id GROUP BY 1""")
oracle("q309_category_variants", "normalised_name:s variants:s",
       """SELECT lower(category_name) AS normalised_name, string_agg(category_name || ' (id ' || category_id || ', ' || n || ' products)', ' ; ' ORDER BY category_id) AS variants
       FROM (SELECT c.*, (SELECT count(*) FROM m_pr p WHERE p.category_id = c.category_id) AS n FROM m_cat c) GROUP BY 1 HAVING count(*) > 1""")

# ---- business questions
oracle("q401_executive_kpis",
       "net_revenue:f gross_profit:f completed_orders:i buying_customers:i avg_order_value:f repeat_customer_rate_pct:f order_return_rate_pct:f inventory_value_at_cost:f",
       """SELECT round(net, 0) AS net_revenue, round(p, 0) AS gross_profit, n AS completed_orders, c AS buying_customers, round(CAST(gross AS DOUBLE) / n + 1e-7, 0) AS avg_order_value,
       round(100e0 * r / c, 1) AS repeat_customer_rate_pct, round(100e0 * b / n, 2) AS order_return_rate_pct, round(v, 0) AS inventory_value_at_cost
       FROM (SELECT sum(net) AS net, sum(gross) AS gross, sum(n) AS n, count(*) AS c, count(*) FILTER (n > 1) AS r FROM x_cust), (SELECT sum(profit) AS p FROM m_sl),
       (SELECT count(DISTINCT order_id) AS b FROM m_rl), (SELECT sum(value) AS v FROM m_stock)""")
oracle("q402_products_to_review",
       "product_name:s net_revenue:f margin_pct:f growth_2000_pct:f return_rate_pct:f days_of_cover:f flags:s",
       """SELECT product_name, round(net, 0) AS net_revenue, round(mg, 1) AS margin_pct, round(100e0 * (b / a - 1), 1) AS growth_2000_pct, round(rr, 1) AS return_rate_pct,
       round(cover, 0) AS days_of_cover, flags FROM (SELECT *, concat_ws('; ', CASE WHEN mg < cm THEN 'margin below company average' END,
         CASE WHEN b < 0.85 * a THEN 'revenue down more than 15 pct' END, CASE WHEN rr > 3 THEN 'return rate above 3 pct' END, CASE WHEN cover < 30 THEN 'under 30 days of stock' END) AS flags
        FROM (SELECT x.product_id, x.net, 100e0 * x.profit / x.net AS mg, y.a, y.b, 100e0 * coalesce(k.back, 0) / x.units AS rr, coalesce(s.units, 0) / (CAST(q.u90 AS DOUBLE) / 90) AS cover,
          sum(x.net) OVER (ORDER BY x.net DESC, x.product_id ROWS UNBOUNDED PRECEDING) - x.net AS before, sum(x.net) OVER () AS whole, 100e0 * sum(x.profit) OVER () / sum(x.net) OVER () AS cm
         FROM x_prod x JOIN (SELECT product_id, sum(net) FILTER (yr = 1999) AS a, sum(net) FILTER (yr = 2000) AS b FROM m_sl GROUP BY 1) y ON y.product_id = x.product_id
         LEFT JOIN x_prodstock s ON s.product_id = x.product_id LEFT JOIN x_back k ON k.product_id = x.product_id LEFT JOIN x_sold90 q ON q.product_id = x.product_id)
        WHERE 100e0 * before / whole < 80) t JOIN m_pr p ON p.product_id = t.product_id WHERE flags <> '' ORDER BY net DESC, t.product_id LIMIT 20""")
ONLINE = "round(100e0 * sum(net) FILTER (channel = 'ONLINE') / sum(net), 1)"
METRICS = [
    ("Growth", "Net revenue growth 2000 vs 1999 (pct)",
     "SELECT round(100e0 * (CAST(sum(net) FILTER (yr = 2000) AS DOUBLE) / CAST(sum(net) FILTER (yr = 1999) AS DOUBLE) - 1), 1) FROM m_done"),
    ("Channel", "Online share of net revenue in 2000 (pct)", f"SELECT {ONLINE} FROM m_done WHERE yr = 2000"),
    ("Channel", "Online share of net revenue in 1998 (pct)", f"SELECT {ONLINE} FROM m_done WHERE yr = 1998"),
    ("Promotions", "Gross margin on promoted lines (pct)", "SELECT round(100e0 * sum(profit) / sum(net), 1) FROM m_sl WHERE promotion_id IS NOT NULL"),
    ("Promotions", "Gross margin on non-promoted lines (pct)", "SELECT round(100e0 * sum(profit) / sum(net), 1) FROM m_sl WHERE promotion_id IS NULL"),
    ("Customers", "Share of revenue from the top 10 pct of buyers (pct)",
     "SELECT round(100e0 * sum(net) FILTER (k = 10) / sum(net), 1) FROM (SELECT net, ntile(10) OVER (ORDER BY net, customer_id) AS k FROM x_cust)"),
    ("Products", "Share of revenue from the top 20 pct of products (pct)",
     "SELECT round(100e0 * sum(net) FILTER (k <= 0.2 * c) / sum(net), 1) FROM (SELECT net, row_number() OVER (ORDER BY net DESC, product_id) AS k, count(*) OVER () AS c FROM x_prod)"),
    ("Returns", "Order return rate, online (pct)",
     "SELECT round(100e0 * count(*) FILTER (back) / count(*), 2) FROM x_flag WHERE status = 'COMPLETED' AND channel = 'ONLINE'"),
    ("Returns", "Order return rate, in-store (pct)",
     "SELECT round(100e0 * count(*) FILTER (back) / count(*), 2) FROM x_flag WHERE status = 'COMPLETED' AND channel = 'IN_STORE'"),
    ("Suppliers", "On-time delivery, all received POs (pct)", "SELECT round(100e0 * count(*) FILTER (got <= due) / count(*), 1) FROM m_po WHERE status = 'RECEIVED'"),
    ("Inventory", "Positions at or below reorder level but not empty (pct)",
     "SELECT round(100e0 * count(*) FILTER (on_hand > 0 AND on_hand <= reorder) / count(*), 1) FROM m_inv"),
    ("Inventory", "Positions above max stock level (pct)", "SELECT round(100e0 * count(*) FILTER (on_hand > ceiling) / count(*), 1) FROM m_inv"),
]
oracle("q403_operational_metrics", "theme:s metric:s value:f",
       " UNION ALL ".join(f"SELECT '{t}' AS theme, '{m}' AS metric, ({q}) AS value" for t, m, q in METRICS))
oracle("q404_inventory_abc",
       "inventory_abc_class:s products:i share_of_products_pct:f stock_value_at_cost:f share_of_value_pct:f",
       """SELECT CASE WHEN 100e0 * before / whole < 80 THEN 'A' WHEN 100e0 * before / whole < 95 THEN 'B' ELSE 'C' END AS inventory_abc_class, count(*) AS products,
       round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS share_of_products_pct, round(sum(value), 0) AS stock_value_at_cost,
       round(100e0 * sum(value) / sum(sum(value)) OVER (), 1) AS share_of_value_pct FROM (SELECT value, sum(value) OVER () AS whole,
        sum(value) OVER (ORDER BY value DESC, product_id ROWS UNBOUNDED PRECEDING) - value AS before FROM x_prodstock WHERE units > 0) GROUP BY 1""")

# ---- lookups
oracle("q501_customer_history", "order_id:i order_date:t total_amount:f", "SELECT order_id, ts AS order_date, total AS total_amount FROM m_done WHERE customer_id = 42")
oracle("q502_month_revenue", "orders:i net_revenue:f", "SELECT count(*) AS orders, sum(net) AS net_revenue FROM m_done WHERE month = DATE '2000-10-01'")
oracle("q503_product_lines", "units:i line_total:f", "SELECT sum(qty) AS units, sum(line_total) AS line_total FROM m_it WHERE product_id = 13")
for k in ("q504_correlated_average", "q517_preaggregated_average"):
    oracle(k, "order_id:i total_amount:f", f"SELECT o.order_id, o.total AS total_amount FROM m_done o JOIN {MEAN} WHERE {BIG}")
oracle("q505_product_returns", "product_id:i units_returned:i", "SELECT product_id, sum(qty) AS units_returned FROM m_rl WHERE product_id = 13 GROUP BY 1")
oracle("q506_position_ledger", "transaction_date:t transaction_type:s quantity_change:i",
       "SELECT ts AS transaction_date, kind AS transaction_type, change AS quantity_change FROM m_ledger WHERE store_id = 3 AND product_id = 13")
oracle("q507_unpaid_orders", "orders:i", "SELECT count(*) AS orders FROM m_done ANTI JOIN m_pay USING (order_id)")
oracle("q508_open_purchases", "purchase_id:i supplier_id:i expected_date:d", "SELECT purchase_id, supplier_id, due AS expected_date FROM m_po WHERE status = 'ORDERED'")
oracle("q509_email_lookup", "customer_id:i email:s", "SELECT customer_id, email FROM m_cu WHERE lower(email) = 'user123@example.com'")
oracle("q510_store_quarter", "orders:i total_amount:f",
       "SELECT count(*) AS orders, sum(total) AS total_amount FROM m_so WHERE store_id = 3 AND day BETWEEN DATE '2000-07-01' AND DATE '2000-09-30'")
oracle("q511_full_scan", "month:d net_revenue:f", "SELECT month, net AS net_revenue FROM x_month")
oracle("q512_product_stock", "units:i", "SELECT sum(on_hand) AS units FROM m_inv WHERE product_id = 13")
oracle("q513_category_products", "product_id:i product_name:s", "SELECT product_id, product_name FROM m_pr WHERE category_id = 1")
oracle("q514_order_returns", "return_date:t refund_amount:f", "SELECT ship AS return_date, refund AS refund_amount FROM m_rl WHERE order_id = 34")
oracle("q515_order_payments", "payment_id:i payment_method:s amount:f payment_status:s",
       "SELECT order_id AS payment_id, method AS payment_method, amount, status AS payment_status FROM m_pay WHERE order_id = 200")
oracle("q516_line_returns", "quantity:i refund_amount:f",
       "SELECT qty AS quantity, refund AS refund_amount FROM m_rl WHERE order_id = 34 AND refund = (SELECT max(refund) FROM m_rl WHERE order_id = 34)")
