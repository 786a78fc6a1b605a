"""Clocks: news comes in universal time, exchanges keep their own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXCHANGE_ZONE = "Europe/Moscow"


def to_zone(at: str | Column, zone: str = EXCHANGE_ZONE) -> Column:
    """A universal time without zone on the clock of ``zone``, summer time included; also without zone, so sessions do not shift it."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def trading_day(at: str | Column, close_hour: int, zone: str = EXCHANGE_ZONE) -> Column:
    """The exchange's date, or the next one from ``close_hour`` on. Which dates trade is the calendar's matter (``events.trading_index``)."""
    local = to_zone(at, zone)
    return F.when(F.hour(local) >= close_hour, F.date_add(local.cast("date"), 1)).otherwise(local.cast("date"))
