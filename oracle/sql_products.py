from .compose import oracle

BANDS = """CASE WHEN p.unit_price < 500 THEN 'a) Under 500' WHEN p.unit_price < 2000 THEN 'b) 500 - 1,999' WHEN p.unit_price < 10000 THEN 'c) 2,000 - 9,999'
 ELSE 'd) 10,000 and above' END"""
JOINED = "x_prod x JOIN m_pr p ON p.product_id = x.product_id"

oracle("q47_product_scorecard",
       "product_id:i product_name:s units_sold:i net_revenue:f gross_profit:f margin_pct:f return_rate_pct:f revenue_rank:i",
       f"""SELECT x.product_id, p.product_name, x.units AS units_sold, round(x.net, 0) AS net_revenue, round(x.profit, 0) AS gross_profit,
       round(100e0 * x.profit / x.net, 1) AS margin_pct, round(100e0 * coalesce(b.back, 0) / x.units, 2) AS return_rate_pct, rank() OVER (ORDER BY x.net DESC) AS revenue_rank
       FROM {JOINED} LEFT JOIN x_back b ON b.product_id = x.product_id ORDER BY x.net DESC, x.product_id LIMIT 20""")
oracle("q48_category_bestseller", "category_name:s product_name:s net_revenue:f share_of_category_pct:f",
       """SELECT canonical_name AS category_name, arg_max(product_name, net) AS product_name, round(max(net), 0) AS net_revenue,
       round(100e0 * max(net) / sum(net), 1) AS share_of_category_pct FROM x_prod x JOIN x_goods g ON g.product_id = x.product_id
       WHERE canonical_id IS NOT NULL GROUP BY canonical_name""")
oracle("q49_never_sold", "product_id:i sku:s product_name:s is_active:b units_in_stock:i stock_value_at_cost:f",
       """SELECT p.product_id, p.sku, p.product_name, p.is_active, coalesce(s.units, 0) AS units_in_stock, round(coalesce(s.value, 0), 0) AS stock_value_at_cost
       FROM m_pr p LEFT JOIN x_prodstock s ON s.product_id = p.product_id WHERE p.product_id NOT IN (SELECT product_id FROM m_sl)""")
Y = "sum(l.net) FILTER (l.yr = {0}) AS y{0}"
oracle("q50_category_growth", "category:s rev_1998:f rev_1999:f rev_2000:f growth_1999_pct:f growth_2000_pct:f trend_flag:s",
       f"""SELECT category, round(y1998, 0) AS rev_1998, round(y1999, 0) AS rev_1999, round(y2000, 0) AS rev_2000,
       round(100e0 * (y1999 / y1998 - 1), 1) AS growth_1999_pct, round(100e0 * (y2000 / y1999 - 1), 1) AS growth_2000_pct,
       CASE WHEN y2000 < y1999 AND y1999 < y1998 THEN 'Declining two years in a row' WHEN y2000 < y1999 THEN 'Declined in 2000' ELSE 'Growing / stable' END AS trend_flag
       FROM (SELECT g.category, {', '.join(Y.format(y) for y in (1998, 1999, 2000))} FROM m_sl l JOIN x_goods g ON g.product_id = l.product_id GROUP BY g.category)""")
oracle("q51_declining_products", "product_id:i product_name:s is_active:b rev_1999:f rev_2000:f change_pct:f",
       """SELECT p.product_id, p.product_name, p.is_active, round(a, 0) AS rev_1999, round(b, 0) AS rev_2000, round(ch, 1) AS change_pct FROM (
        SELECT product_id, sum(net) FILTER (yr = 1999) AS a, sum(net) FILTER (yr = 2000) AS b, sum(qty) FILTER (yr = 1999) AS u,
         CAST(sum(line_total) FILTER (yr = 1999) AS DOUBLE) AS ga, CAST(sum(line_total) FILTER (yr = 2000) AS DOUBLE) AS gb, 100e0 * (gb / ga - 1) AS ch
        FROM m_sl GROUP BY product_id) x JOIN m_pr p ON p.product_id = x.product_id WHERE u >= 30 AND gb <= 0.8e0 * ga ORDER BY ch, p.product_id LIMIT 25""")
ABC = """SELECT *, sum({v}) OVER (ORDER BY {v} DESC, product_id ROWS UNBOUNDED PRECEDING) - {v} AS before, sum({v}) OVER () AS whole FROM {t}"""
CLASS = "CASE WHEN 100e0 * before / whole < 80 THEN 'A' WHEN 100e0 * before / whole < 95 THEN 'B' ELSE 'C' END"
oracle("q52_abc_products", "abc_class:s products:i share_of_products_pct:f net_revenue:f share_of_revenue_pct:f",
       f"""SELECT {CLASS} AS abc_class, count(*) AS products, round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS share_of_products_pct, round(sum(net), 0) AS net_revenue,
       round(100e0 * sum(net) / sum(sum(net)) OVER (), 1) AS share_of_revenue_pct FROM ({ABC.format(v='net', t='x_prod')}) GROUP BY 1""")
oracle("q53_concentration",
       "products_sold:i top_10_products_share_pct:f top_50_products_share_pct:f top_20pct_products_share_pct:f herfindahl_index:f",
       """SELECT count(*) AS products_sold, round(100e0 * sum(s) FILTER (k <= 10), 1) AS top_10_products_share_pct, round(100e0 * sum(s) FILTER (k <= 50), 1) AS top_50_products_share_pct,
       round(100e0 * sum(s) FILTER (k <= 0.2 * c), 1) AS top_20pct_products_share_pct, round(sum(s * s), 4) AS herfindahl_index
       FROM (SELECT net / sum(net) OVER () AS s, row_number() OVER (ORDER BY net DESC, product_id) AS k, count(*) OVER () AS c FROM x_prod)""")
oracle("q54_best_margins", "category:s product_name:s units:i margin_pct:f margin_rank:i",
       f"""SELECT coalesce(c.category_name, '(no category)') AS category, product_name, units, round(100e0 * profit / net, 1) AS margin_pct, k AS margin_rank FROM (
        SELECT p.product_name, p.category_id, x.units, x.net, x.profit, rank() OVER (PARTITION BY coalesce(p.category_id, 0) ORDER BY x.profit / x.net DESC) AS k
        FROM {JOINED} WHERE x.units >= 50) t LEFT JOIN m_cat c ON c.category_id = t.category_id WHERE k <= 3""")
oracle("q55_price_bands", "price_band:s products_sold:i units:i net_revenue:f revenue_share_pct:f margin_pct:f",
       f"""SELECT {BANDS} AS price_band, count(*) AS products_sold, sum(units) AS units, round(sum(net), 0) AS net_revenue,
       round(100e0 * sum(net) / sum(sum(net)) OVER (), 1) AS revenue_share_pct, round(100e0 * sum(profit) / sum(net), 1) AS margin_pct FROM {JOINED} GROUP BY 1""")
oracle("q56_bought_together", "product_a:s product_b:s orders_together:i",
       """SELECT pa.product_name AS product_a, pb.product_name AS product_b, count(*) AS orders_together FROM m_sl a
       JOIN m_sl b ON b.order_id = a.order_id AND b.product_id > a.product_id JOIN m_pr pa ON pa.product_id = a.product_id
       JOIN m_pr pb ON pb.product_id = b.product_id GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY 3 DESC, 1, 2 LIMIT 10""")
oracle("q57_launch_groups", "launch_group:s products_sold:i net_revenue:f revenue_share_pct:f",
       f"""SELECT CASE WHEN year(p.launch_date) < 1995 THEN 'Launched before 1995' ELSE 'Launched in ' || year(p.launch_date) END AS launch_group, count(*) AS products_sold,
       round(sum(net), 0) AS net_revenue, round(100e0 * sum(net) / sum(sum(net)) OVER (), 1) AS revenue_share_pct FROM {JOINED} GROUP BY 1""")
oracle("q58_top_brands", "brand:s products:i units:i net_revenue:f margin_pct:f",
       f"""SELECT coalesce(p.brand, '(brand missing)') AS brand, count(*) AS products, sum(units) AS units, round(sum(net), 0) AS net_revenue,
       round(100e0 * sum(profit) / sum(net), 1) AS margin_pct FROM {JOINED} GROUP BY 1 ORDER BY sum(net) DESC LIMIT 10""")

# ---- inventory
oracle("q59_stock_by_store",
       "store_name:s units_on_hand:i units_reserved:i units_available:i value_at_cost:f value_at_net_price:f stocked_products:i",
       """SELECT s.store_name, sum(v.on_hand) AS units_on_hand, sum(v.reserved) AS units_reserved, sum(v.on_hand) - sum(v.reserved) AS units_available,
       round(sum(v.value), 0) AS value_at_cost, round(sum(v.on_hand * (CAST(p.unit_price AS DOUBLE) / (1 + p.gst_rate / 100e0))), 0) AS value_at_net_price,
       count(*) AS stocked_products FROM m_stock v JOIN m_pr p ON p.product_id = v.product_id JOIN m_st s ON s.store_id = v.store_id GROUP BY 1""")
oracle("q60_health_summary", "status:s store_product_positions:i share_of_positions_pct:f units:i value_at_cost:f share_of_value_pct:f",
       """SELECT status, count(*) AS store_product_positions, round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS share_of_positions_pct, sum(on_hand) AS units,
       round(sum(value), 0) AS value_at_cost, round(100e0 * sum(value) / sum(sum(value)) OVER (), 1) AS share_of_value_pct FROM x_pos GROUP BY status""")
oracle("q61_replenishment",
       "store_name:s product_name:s quantity_on_hand:i reorder_level:i max_stock_level:i avg_daily_demand:f inbound_on_open_pos:i suggested_order_qty:i",
       """SELECT s.store_name, p.product_name, v.on_hand AS quantity_on_hand, v.reorder AS reorder_level, v.ceiling AS max_stock_level,
       round(CAST(v.u90 AS DOUBLE) / 90, 2) AS avg_daily_demand, coalesce(b.q, 0) AS inbound_on_open_pos,
       greatest(v.ceiling - v.on_hand - coalesce(b.q, 0), 0) AS suggested_order_qty FROM x_pos v JOIN m_st s ON s.store_id = v.store_id
       JOIN m_pr p ON p.product_id = v.product_id LEFT JOIN (SELECT o.store_id, i.product_id, sum(i.ordered) AS q FROM m_poi i JOIN m_po o USING (purchase_id)
        WHERE o.status = 'ORDERED' GROUP BY 1, 2) b ON b.store_id = v.store_id AND b.product_id = v.product_id
       WHERE v.u90 > 0 AND v.on_hand <= v.reorder ORDER BY v.u90 DESC, v.store_id, v.product_id LIMIT 25""")
oracle("q62_turnover", "category_name:s cogs_last_12m:f inventory_value:f inventory_turnover:f days_of_inventory:f",
       """SELECT category_name, round(c, 0) AS cogs_last_12m, round(v, 0) AS inventory_value, round(c / v, 2) AS inventory_turnover, round(365 * v / c, 0) AS days_of_inventory
       FROM (SELECT g.canonical_name AS category_name, CAST(sum(y.c12) AS DOUBLE) AS c, CAST(sum(s.value) AS DOUBLE) AS v FROM x_goods g
        LEFT JOIN x_year12 y ON y.product_id = g.product_id LEFT JOIN x_prodstock s ON s.product_id = g.product_id WHERE g.canonical_id IS NOT NULL GROUP BY 1)
       WHERE c IS NOT NULL AND v IS NOT NULL""")
oracle("q63_cover_bands", "stock_cover:s positions:i share_pct:f value_at_cost:f",
       """SELECT CASE WHEN c < 7 THEN 'a) under 7 days' WHEN c < 30 THEN 'b) 7-29 days' WHEN c < 90 THEN 'c) 30-89 days' WHEN c < 180 THEN 'd) 90-179 days' ELSE 'e) 180+ days' END
       AS stock_cover, count(*) AS positions, round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS share_pct, round(sum(value), 0) AS value_at_cost
       FROM (SELECT on_hand / (CAST(u90 AS DOUBLE) / 90) AS c, value FROM x_pos WHERE u90 > 0) GROUP BY 1""")
HELD = """(SELECT s.*, coalesce(q.u90, 0) AS u FROM x_prodstock s LEFT JOIN x_sold90 q ON q.product_id = s.product_id WHERE s.units > 0)"""
oracle("q64_movement_classes", "movement_class:s products:i units_sold_90d:i stock_value_at_cost:f",
       f"""SELECT CASE WHEN u = 0 THEN 'NON_MOVING' WHEN k >= 0.75 THEN 'FAST_MOVING' WHEN k <= 0.25 THEN 'SLOW_MOVING' ELSE 'MEDIUM' END AS movement_class,
       count(*) AS products, sum(u) AS units_sold_90d, round(sum(value), 0) AS stock_value_at_cost
       FROM (SELECT *, percent_rank() OVER (PARTITION BY u > 0 ORDER BY u) AS k FROM {HELD}) GROUP BY 1""")
oracle("q65_fastest_and_slowest", "list:s product_name:s units_90d:i units_in_stock:i",
       f"""SELECT t.list, p.product_name, t.u AS units_90d, t.units AS units_in_stock FROM (
       (SELECT 'FASTEST' AS list, * FROM {HELD} ORDER BY u DESC, product_id LIMIT 10) UNION ALL
       (SELECT 'SLOWEST (sold at least 1)', * FROM {HELD} WHERE u > 0 ORDER BY u, units DESC, product_id LIMIT 10)) t JOIN m_pr p ON p.product_id = t.product_id""")
oracle("q66_aging", "stock_age:s positions:i units:i value_at_cost:f share_of_value_pct:f",
       """SELECT CASE WHEN a <= 30 THEN 'a) 0-30 days' WHEN a <= 90 THEN 'b) 31-90 days' WHEN a <= 180 THEN 'c) 91-180 days' WHEN a <= 365 THEN 'd) 181-365 days'
       ELSE 'e) over 365 days' END AS stock_age, count(*) AS positions, sum(on_hand) AS units, round(sum(value), 0) AS value_at_cost,
       round(100e0 * sum(value) / sum(sum(value)) OVER (), 1) AS share_of_value_pct FROM (SELECT *, d - restocked_on AS a FROM m_stock, m_asof WHERE on_hand > 0) GROUP BY 1""")


def tiers(how: str) -> str:
    """how: the join to the stock and the rows that are ranked."""
    return f"""(SELECT *, units / nullif(CAST(u AS DOUBLE) / 90, 0) AS cover, ntile(5) OVER (ORDER BY r, product_id) AS q FROM (
     SELECT p.product_id, p.product_name, coalesce(y.r12, 0) AS r, coalesce(y.u90, 0) AS u, coalesce(s.units, 0) AS units, s.value FROM m_pr p
     LEFT JOIN x_year12 y ON y.product_id = p.product_id {how}))"""


oracle("q67_high_revenue_low_stock", "product_name:s revenue_12m:f units_90d:i units_in_stock:i days_of_cover:f",
       f"""SELECT product_name, round(r, 0) AS revenue_12m, u AS units_90d, units AS units_in_stock, round(cover, 1) AS days_of_cover
       FROM {tiers('LEFT JOIN x_prodstock s ON s.product_id = p.product_id')} WHERE q = 5 AND u > 0 AND cover < 30 ORDER BY round(cover, 1), r DESC, product_id LIMIT 20""")
oracle("q68_low_revenue_high_stock", "product_name:s revenue_12m:f units_90d:i units_in_stock:i stock_value_at_cost:f days_of_cover:f",
       f"""SELECT product_name, round(r, 0) AS revenue_12m, u AS units_90d, units AS units_in_stock, round(value, 0) AS stock_value_at_cost, round(cover, 0) AS days_of_cover
       FROM {tiers('JOIN x_prodstock s ON s.product_id = p.product_id AND s.units > 0')} WHERE q <= 2 AND (u = 0 OR cover > 180) ORDER BY value DESC, product_id LIMIT 20""")
MATRIX = """CASE WHEN q = 5 AND u > 0 AND cover < 30 THEN 'High Revenue / Low Stock' WHEN q = 5 AND u > 0 AND cover BETWEEN 30 AND 180 THEN 'High Revenue / Healthy Stock'
 WHEN q <= 2 AND (u = 0 OR cover > 180) THEN 'Low Revenue / High Stock' WHEN q <= 2 AND u > 0 AND cover < 30 THEN 'Low Revenue / Low Stock' ELSE 'Other' END"""
oracle("q69_class_matrix", "product_class:s products:i revenue_12m:f stock_value_at_cost:f",
       f"""SELECT {MATRIX} AS product_class, count(*) AS products, round(sum(r), 0) AS revenue_12m, round(sum(value), 0) AS stock_value_at_cost
       FROM {tiers('JOIN x_prodstock s ON s.product_id = p.product_id')} GROUP BY 1""")
oracle("q70_stock_movements", "month:d purchased:i sold:i returned_to_stock:i adjustments:i net_change:i",
       """SELECT date_trunc('month', ts) AS month, sum(change) FILTER (kind = 'PURCHASE') AS purchased, -sum(change) FILTER (kind = 'SALE') AS sold,
       sum(change) FILTER (kind = 'RETURN') AS returned_to_stock, sum(change) FILTER (kind = 'ADJUSTMENT') AS adjustments,
       sum(change) FILTER (kind <> 'OPENING') AS net_change FROM m_ledger GROUP BY 1""")
oracle("q71_store_risk",
       "store_name:s positions:i stock_out_risk_positions:i stock_out_risk_pct:f surplus_value_at_cost:f surplus_share_of_store_value_pct:f",
       """SELECT store_name, n AS positions, k AS stock_out_risk_positions, round(100e0 * k / n, 1) AS stock_out_risk_pct, round(x, 0) AS surplus_value_at_cost,
       round(100e0 * x / v, 1) AS surplus_share_of_store_value_pct FROM (SELECT s.store_name, count(*) AS n, count(*) FILTER (status IN ('OUT_OF_STOCK', 'LOW_STOCK')) AS k,
       sum(value) FILTER (status IN ('OVERSTOCKED', 'DEAD_STOCK')) AS x, sum(value) AS v FROM x_pos p JOIN m_st s ON s.store_id = p.store_id GROUP BY 1)""")
