"""Named queries and datasets. Importing this package fills the query registry."""
from . import advanced, basics, business, classic, customers, inventory, lookups, products, quality, returns, sales, stores, suppliers  # noqa: F401
from .datasets import DATASETS, dataset
from .registry import QUERIES
