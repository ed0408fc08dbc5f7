"""Oracle SQL for DuckDB: the retail model as common table expressions over the driver's tables, and one statement per
registered query. Written apart from the Spark plans, so that the two can be compared."""
from .compose import ORACLE
from . import sql_basics, sql_customers, sql_products, sql_stores, sql_advanced, sql_datasets, sql_layers  # noqa: F401  (register)
