from .columns import (as_double, band, basket_label, cover_days, day_of, growth_pct, month_of, net_of_tax, no_zero, pct, quarter_of,
                      ratio, rnd, title_name, week_of)
from .frames import inline_rows, one_row, part_of_total, stacked, top
