"""A few rows per table, with the defects and ties the driver's tables do not have (fixtures D1-D9)."""
from datetime import date, datetime
from decimal import Decimal

from shelfmetrics.sources import Retail, build_calendar, schema_of

D, T = date.fromisoformat, datetime.fromisoformat
NOW = T("2025-01-01T00:00:00")


def M(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


ROWS = {
    "customer_segments": [(1, "Consumer", None), (2, "Corporate", None)],
    "categories": [(1, "Electronics", None, True, NOW), (2, "Mobiles", 1, True, NOW), (3, "Phone Covers", 2, True, NOW),
                   (4, "Footwear", None, True, NOW), (5, "FOOTWEAR", None, True, NOW)],
    "suppliers": [(1, "Asha Traders", "a@x.com", "9000000001", "Pune", "MH", "G1", 7, True, NOW, NOW),
                  (2, "Beta Supply", None, "9000000002", "Delhi", "DL", "G2", 5, False, NOW, NOW),
                  (3, "No Goods", "c@x.com", None, None, None, None, 5, True, NOW, NOW)],
    "products": [  # id, sku, name, brand, category, supplier, cost, price, gst, launch, active
        (1, "S1", "Phone X", "B1", 2, 1, M(600), M(1180), M(18), D("2022-05-01"), True, NOW, NOW),
        (2, "S2", "Cover Y", None, 3, 1, M(50), M(112), M(12), D("2023-02-01"), True, NOW, NOW),
        (3, "S3", "Shoe Z", "B2", 4, 2, M(300), M(590), M(18), None, False, NOW, NOW),
        (4, "S4", "shoe z ", "B2", 5, None, M(310), M(590), M(18), D("2024-01-01"), True, NOW, NOW),
        (5, "S5", "Mystery", "B3", None, 1, M(10), M(21), M(5), D("2024-06-01"), True, NOW, NOW),
        (6, "S6", "Never Sold", "B3", 1, 1, M(20), M(42), M(5), D("2024-06-01"), True, NOW, NOW)],
    "stores": [(1, "LKO01", "Lucknow", "STORE", "Lucknow", "UP", "North", D("2020-01-01"), True, NOW),
               (2, "PUN01", "Pune", "STORE", "Pune", "MH", "West", D("2024-03-01"), True, NOW),
               (3, "HUB01", "Hub", "ONLINE_WAREHOUSE", "Pune", "MH", "West", D("2020-01-01"), True, NOW)],
    "employees": [  # D4: one report hired before the manager
        (1, "Ravi", "Rao", None, 1, None, "Store Manager", D("2020-01-01"), True, NOW, NOW),
        (2, "Mina", "Sen", None, 2, None, "Store Manager", D("2024-03-01"), True, NOW, NOW),
        (3, "Old", "Hand", None, 1, 1, "Associate", D("2019-06-01"), True, NOW, NOW),
        (4, "New", "Hand", None, 1, 1, "Associate", D("2022-06-01"), False, NOW, NOW),
        (5, "Jo", "Lee", None, 1, 3, "Trainee", D("2023-06-01"), True, NOW, NOW)],
    "customers": [  # D2
        (1, "AMIT", "Shah", "a@x.com", "+91 9812345678", "M", D("1990-01-01"), "Pune", "MH", 1, D("2023-01-01"), True, NOW, NOW),
        (2, "neha ", None, " A@X.com ", "12345", "F", D("1900-01-01"), None, "MH", 2, D("2023-02-01"), True, NOW, NOW),
        (3, "Kiran", "Das", "a..b@x.com", None, "O", None, "Delhi", "DL", None, D("2023-03-01"), False, NOW, NOW),
        (4, "Never", "Buys", None, "9812345670", None, D("1980-01-01"), "Delhi", "DL", 1, D("2024-01-01"), True, NOW, NOW)],
    "promotions": [(1, "DIWALI", "Diwali", "PERCENT", M(10), D("2024-10-01"), D("2024-10-10"), True, NOW)],
    "product_promotions": [(1, 1)],
    "sales_orders": [  # id, number, customer, store, employee, ts, channel, status, subtotal, discount, gst, total
        (1, "O1", 1, 1, 1, T("2023-01-15T10:00:00"), "IN_STORE", "COMPLETED", M(1180), M(0), M(180), M(1180), NOW, NOW),
        (2, "O2", 1, 1, 3, T("2023-03-10T13:00:00"), "IN_STORE", "COMPLETED", M(224), M(0), M(24), M(224), NOW, NOW),
        (3, "O3", 1, 1, 3, T("2024-10-05T17:00:00"), "IN_STORE", "COMPLETED", M(2360), M(236), M(324), M(2124), NOW, NOW),
        (4, "O4", 2, 3, None, T("2024-10-05T20:00:00"), "ONLINE", "COMPLETED", M(590), M(0), M(90), M(590), NOW, NOW),
        (5, "O5", 2, 3, None, T("2024-12-31T21:00:00"), "ONLINE", "CANCELLED", M(590), M(0), M(90), M(590), NOW, NOW),
        (6, "O6", 3, 2, 2, T("2023-02-01T09:00:00"), "IN_STORE", "COMPLETED", M(21), M(0), M(1), M(21), NOW, NOW),
        (7, "O7", 1, 1, 1, T("2024-09-20T11:00:00"), "IN_STORE", "COMPLETED", M(1180), M(0), M(180), M(1180), NOW, NOW)],
    "sales_order_items": [  # id, order, product, promotion, quantity, price, cost, discount, total
        (1, 1, 1, None, 1, M(1180), M(600), M(0), M(1180)), (2, 2, 2, None, 2, M(112), M(50), M(0), M(224)),
        (3, 3, 1, 1, 2, M(1180), M(600), M(236), M(2124)), (4, 4, 3, None, 1, M(590), M(300), M(0), M(590)),
        (5, 5, 4, None, 1, M(590), M(310), M(0), M(590)), (6, 6, 5, None, 1, M(21), M(10), M(0), M(20)),
        (7, 7, 1, None, 1, M(1180), M(600), M(0), M(1180))],
    "payments": [(1, 1, T("2023-01-15T10:01:00"), "UPI", M(1180), "SUCCESS", None, NOW), (2, 2, T("2023-03-10T13:01:00"), "CASH", M(200), "SUCCESS", None, NOW),
                 (3, 3, T("2024-10-05T17:01:00"), "CARD", M(2124), "SUCCESS", None, NOW), (4, 4, T("2024-10-05T20:01:00"), "CARD", M(590), "FAILED", None, NOW),
                 (5, 5, T("2024-12-31T21:01:00"), "CARD", M(590), "REFUNDED", None, NOW), (6, 7, T("2024-09-20T11:01:00"), "UPI", M(1180), "SUCCESS", None, NOW)],
    "returns": [(1, 1, T("2023-01-20T22:00:00"), "DEFECTIVE", M(1180), None, NOW), (2, 4, T("2024-10-01T00:00:00"), "OTHER", M(590), None, NOW)],
    "return_items": [(1, 1, 1, 1, M(1180), False), (2, 2, 4, 1, M(590), True)],
    "inventory": [  # id, store, product, on hand, reserved, reorder, max, restocked
        (1, 1, 1, 5, 1, 10, 50, D("2024-12-01"), NOW), (2, 1, 2, 100, 0, 10, 50, None, NOW), (3, 3, 3, 0, 0, 10, 50, D("2024-06-01"), NOW),
        (4, 1, 6, 7, 0, 1, 50, D("2023-01-01"), NOW), (5, 3, 4, 3, 0, 1, 50, D("2024-12-30"), NOW)],
    "inventory_transactions": [  # D6: position (1, 2) goes below zero on the way
        (1, 1, 1, "OPENING", 9, T("2022-12-31T00:00:00"), None, None, NOW), (2, 1, 1, "SALE", -4, T("2023-01-15T10:00:00"), "SALES_ORDER", 1, NOW),
        (3, 1, 2, "SALE", -2, T("2023-03-10T13:00:00"), "SALES_ORDER", 2, NOW), (4, 1, 2, "PURCHASE", 102, T("2023-04-01T00:00:00"), "PURCHASE", 1, NOW)],
    "purchases": [(1, "P1", 1, 1, D("2023-03-20"), D("2023-04-01"), D("2023-04-01"), "RECEIVED", M(5100), NOW),
                  (2, "P2", 2, 1, D("2024-12-01"), D("2024-12-10"), None, "ORDERED", M(3000), NOW),
                  (3, "P3", 1, 1, D("2024-05-10"), D("2024-05-20"), D("2024-05-25"), "RECEIVED", M(600), NOW)],
    "purchase_items": [(1, 1, 2, 102, 102, M(50)), (2, 2, 1, 5, 0, M(600)), (3, 3, 1, 1, 0, M(600))],
}


def micro_model(spark) -> Retail:
    tables = {t: spark.createDataFrame(rows, schema_of(t)) for t, rows in ROWS.items()}
    tables["dim_date"] = build_calendar(spark, "2023-01-01", "2024-12-31")
    return Retail(spark, tables)
