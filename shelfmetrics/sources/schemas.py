"""Explicit schemas of the nineteen retail tables (fixed values), in load order: parents before children."""
from pyspark.sql.types import StructType

MONEY = "decimal(12,2)"
STAMPS = "created_at timestamp_ntz, updated_at timestamp_ntz"

TABLES = {
    "dim_date": "date_key date, year smallint, quarter smallint, month smallint, month_name string, year_month string,"
                " week_of_year smallint, day_of_month smallint, day_of_week smallint, day_name string, is_weekend boolean",
    "customer_segments": "segment_id smallint, segment_name string, description string",
    "categories": "category_id int, category_name string, parent_category_id int, is_active boolean, created_at timestamp_ntz",
    "suppliers": "supplier_id int, supplier_name string, contact_email string, contact_phone string, city string, state string,"
                 f" gstin string, lead_time_days smallint, is_active boolean, {STAMPS}",
    "products": "product_id int, sku string, product_name string, brand string, category_id int, supplier_id int,"
                f" unit_cost {MONEY}, unit_price {MONEY}, gst_rate decimal(4,2), launch_date date, is_active boolean, {STAMPS}",
    "stores": "store_id int, store_code string, store_name string, store_type string, city string, state string, region string,"
              " opened_date date, is_active boolean, created_at timestamp_ntz",
    "employees": "employee_id int, first_name string, last_name string, email string, store_id int, manager_id int,"
                 f" job_title string, hire_date date, is_active boolean, {STAMPS}",
    "customers": "customer_id int, first_name string, last_name string, email string, phone string, gender string,"
                 " date_of_birth date, city string, state string, segment_id smallint, registration_date date,"
                 f" is_active boolean, {STAMPS}",
    "promotions": "promotion_id int, promo_code string, promo_name string, discount_type string,"
                  " discount_value decimal(10,2), start_date date, end_date date, is_active boolean, created_at timestamp_ntz",
    "product_promotions": "promotion_id int, product_id int",
    "sales_orders": "order_id int, order_number string, customer_id int, store_id int, employee_id int,"
                    " order_date timestamp_ntz, channel string, order_status string,"
                    f" subtotal {MONEY}, discount_amount {MONEY}, gst_amount {MONEY}, total_amount {MONEY}, {STAMPS}",
    "sales_order_items": "order_item_id int, order_id int, product_id int, promotion_id int, quantity int,"
                         f" unit_price {MONEY}, unit_cost {MONEY}, discount_amount {MONEY}, line_total {MONEY}",
    "payments": f"payment_id int, order_id int, payment_date timestamp_ntz, payment_method string, amount {MONEY},"
                " payment_status string, transaction_ref string, created_at timestamp_ntz",
    "returns": "return_id int, order_id int, return_date timestamp_ntz, return_reason string,"
               f" refund_amount {MONEY}, processed_by int, created_at timestamp_ntz",
    "return_items": f"return_item_id int, return_id int, order_item_id int, quantity int, refund_amount {MONEY}, restocked boolean",
    "inventory": "inventory_id int, store_id int, product_id int, quantity_on_hand int, reserved_quantity int,"
                 " reorder_level int, max_stock_level int, last_restocked_date date, updated_at timestamp_ntz",
    "inventory_transactions": "transaction_id bigint, store_id int, product_id int, transaction_type string,"
                              " quantity_change int, transaction_date timestamp_ntz, reference_type string,"
                              " reference_id int, created_at timestamp_ntz",
    "purchases": "purchase_id int, po_number string, supplier_id int, store_id int, order_date date, expected_date date,"
                 " received_date date, status string, total_amount decimal(14,2), created_at timestamp_ntz",
    "purchase_items": "purchase_item_id int, purchase_id int, product_id int, quantity_ordered int, quantity_received int,"
                      f" unit_cost {MONEY}",
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
