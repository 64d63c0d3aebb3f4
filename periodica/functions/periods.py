"""Calendar periods: starts, shifts, day labels, comparison windows and payroll to date."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("week", "month", "quarter", "year")
# Pay per engineer and week, and the number of engineers.
WEEKLY_PAY = 1200
ENGINEERS = 40
MONTHS_IN = {"month": 1, "quarter": 3, "year": 12}
# The longest window, in days, a period may be compared over.
SPAN_LIMIT = {"week": 7, "month": 31, "quarter": 90}


def period_start(ts: Column, period: str) -> Column:
    """First day of the week (Monday), month, quarter or year a timestamp lies in."""
    return F.trunc(F.to_date(ts), period)


def period_start_of(moment: datetime, period: str) -> datetime:
    day = datetime(moment.year, moment.month, moment.day)
    if period == "week":
        return day - timedelta(days=day.weekday())
    if period == "month":
        return day.replace(day=1)
    if period == "quarter":
        return day.replace(month=day.month - (day.month - 1) % 3, day=1)
    return day.replace(month=1, day=1)


def shift(ts: Column, period: str, count: int = 1) -> Column:
    """Move a zone-free timestamp back by whole periods; month ends are clamped."""
    if period == "week":
        step = F.make_dt_interval(F.lit(7 * count))
    else:
        step = F.make_ym_interval(F.lit(0), F.lit(MONTHS_IN[period] * count))
    return ts.cast("timestamp_ntz") - step


def shift_moment(moment: datetime, period: str) -> datetime:
    if period == "week":
        return moment - timedelta(days=7)
    index = moment.year * 12 + moment.month - 1 - MONTHS_IN[period]
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return moment.replace(year=year, month=month + 1, day=min(moment.day, last))


def day_label(ts: Column, period: str) -> Column:
    """Position of a row inside its period, equal for matching days of different periods."""
    day = F.to_date(ts)
    if period == "week":
        return F.weekday(day)
    if period == "month":
        return F.dayofmonth(day)
    if period == "year":
        return F.dayofyear(day)
    part_day = F.when(ts > day.cast("timestamp_ntz"), 1).otherwise(0)
    return F.datediff(day, F.trunc(day, "quarter")) + part_day


@dataclass(frozen=True)
class Window:
    label: str
    start: datetime
    end: datetime  # exclusive

    def holds(self, ts: Column) -> Column:
        return (ts >= F.lit(self.start).cast("timestamp_ntz")) & (ts < F.lit(self.end).cast("timestamp_ntz"))


def window_label(period: str, k: int) -> str:
    return f"{k} {period}(s) prev" + ("(current)" if k == 0 else "")


def comparison_windows(period: str, start: date, end: date, history: int, initial: date) -> list[Window]:
    """The current window and up to ``history - 1`` earlier ones, by calendar day, ends included.

    Earlier windows stop before the initial date.
    """
    lo, hi = datetime(start.year, start.month, start.day), datetime(end.year, end.month, end.day)
    floor = datetime(initial.year, initial.month, initial.day)
    windows = [Window(window_label(period, 0), lo, hi + timedelta(days=1))]
    for k in range(1, int(history)):
        lo, hi = shift_moment(lo, period), shift_moment(hi, period)
        if lo < floor:
            break
        windows.append(Window(window_label(period, k), lo, hi + timedelta(days=1)))
    return windows


def payroll_to_date(day: Column, period: str) -> Column:
    """Payroll from the start of the period up to a day, in whole weeks except for the week itself."""
    day = F.to_date(day)
    weekly = F.lit(WEEKLY_PAY * ENGINEERS).cast("double")
    if period == "year":
        weeks = F.weekofyear(day)
    elif period == "week":
        weeks = F.weekday(day) / F.lit(7.0)
    elif period == "month":
        weeks = F.floor(F.dayofmonth(day) / 7) + 1
    else:
        weeks = F.floor((F.datediff(day, F.trunc(day, "quarter")) + 1) / 7) + 1
    return F.round(weekly * weeks, 2)
