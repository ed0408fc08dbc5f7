from .calendar import append_missing, build_calendar
from .model import KEYED, Retail, read_csv, read_records, shared
from .schemas import TABLES, schema_of
from .testbed import event_orders, testbed
