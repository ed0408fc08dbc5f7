"""Column expressions shared by all metrics."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x) -> Column:
    return _c(x).cast("double")


def no_zero(x) -> Column:
    """NULL instead of zero, so a division by it gives NULL rather than an error."""
    return F.nullif(as_double(x), F.lit(0.0))


def ratio(a, b) -> Column:
    return as_double(a) / no_zero(b)


def pct(a, b, digits: int | None = None) -> Column:
    value = F.lit(100.0) * as_double(a) / no_zero(b)
    return value if digits is None else rnd(value, digits)


def growth_pct(now, before, digits: int | None = None) -> Column:
    value = F.lit(100.0) * (ratio(now, before) - 1)
    return value if digits is None else rnd(value, digits)


def rnd(x, digits: int = 2) -> Column:
    """Half away from zero. A quotient of doubles can miss an exact half by its last bit, so it is first rounded six
    digits further; decimals are not changed by that."""
    return F.round(F.round(_c(x), digits + 6), digits)


def net_of_tax(amount, rate_pct) -> Column:
    """Amount without GST. A ratio, hence double; stored money stays decimal."""
    return as_double(amount) / (F.lit(1.0) + as_double(rate_pct) / 100)


def day_of(ts) -> Column:
    return _c(ts).cast("date")


def month_of(ts) -> Column:
    return F.trunc(day_of(ts), "month")


def quarter_of(ts) -> Column:
    return F.trunc(day_of(ts), "quarter")


def week_of(ts) -> Column:
    return F.trunc(day_of(ts), "week")


def band(value, limits: list[tuple[float, str]], last: str, closed: bool = False) -> Column:
    """First-match banding: ``limits`` are (upper bound, label); the bound belongs to its band only if ``closed``."""
    v, out = _c(value), None
    for upper, label in limits:
        hit = v <= upper if closed else v < upper
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


def basket_label(lines) -> Column:
    return band(lines, [(1, "1 item"), (2, "2 items"), (4, "3-4 items")], "5+ items", closed=True)


def cover_days(on_hand, units, days: int = 90) -> Column:
    """How long the stock lasts at the demand of the last ``days``; NULL without demand."""
    return as_double(on_hand) / no_zero(as_double(units) / float(days))


def title_name(first, last, missing_last: bool = True) -> Column:
    tail = F.coalesce(_c(last), F.lit("")) if missing_last else _c(last)
    return F.concat(F.initcap(F.trim(_c(first))), F.lit(" "), F.initcap(F.trim(tail)))
