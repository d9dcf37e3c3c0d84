"""Column -> Column helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(ts) -> Column:
    """Monday of the ISO week of a timestamp, by date arithmetic only (no session time zone involved)."""
    d = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    return F.date_sub(d, (F.dayofweek(d) + 5) % 7)
