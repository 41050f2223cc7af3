"""Date expressions. The clock is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions import fixed_values as V
from playbill.functions.text import col, strip


def as_date(value: dt.date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def as_ts(value: dt.datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def parse_event_date(c: Column | str) -> Column:
    """Date from the first ten characters, ``YYYY-MM-DD``; anything else is null."""
    head = F.substr(strip(c), F.lit(1), F.lit(10))
    return F.when(head.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def store_date(c: Column | str) -> Column:
    """Date of a stored text value; the compact ``YYYYMMDD`` form is read as well."""
    head = F.substr(strip(c), F.lit(1), F.lit(10))
    dashed = F.concat_ws("-", F.substr(head, F.lit(1), F.lit(4)), F.substr(head, F.lit(5), F.lit(2)), F.substr(head, F.lit(7), F.lit(2)))
    return F.coalesce(parse_event_date(c), F.when(head.rlike(r"^(?!0000)\d{8}$"), dashed.try_cast("date")))


def weekday_label(c: Column | str) -> Column:
    """``Thu 7 May 2026``; a text that is no date is shown as it is."""
    text = strip(c)
    parsed = parse_event_date(c)
    return F.when(parsed.isNotNull(), date_label(parsed)).when(text != "", text).otherwise(V.BLANK_LABEL)


def date_label(d: Column | str) -> Column:
    return F.coalesce(F.date_format(col(d), "E d MMM yyyy"), F.lit(V.BLANK_LABEL))


def utc_ts(c: Column | str, as_of: dt.datetime | str | Column) -> Column:
    """Time stamp of an ISO text; unreadable text counts as now."""
    return F.coalesce(strip(c).try_cast("timestamp"), as_ts(as_of))


def is_fresh(checked: Column | str, as_of: dt.datetime | str | Column, ttl_days: int) -> Column:
    """The link was verified less than ``ttl_days`` ago; without a limit every link is fresh."""
    if ttl_days <= 0:
        return F.lit(True)
    when = strip(checked).try_cast("timestamp")
    age = as_ts(as_of) - F.expr(f"INTERVAL {int(ttl_days)} DAYS")
    return F.coalesce(when > age, F.lit(False))
