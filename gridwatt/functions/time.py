"""Calendar and run-time arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cet_day(ts: Column) -> Column:
    """UTC instant to the calendar day in Central European Time, DST included."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), "CET"))


def hours(n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_interval(hours=n.cast("int"))


def init_time(reference_date: Column, init_hour: Column) -> Column:
    """Initialisation time of a run: CET day of the issue stamp plus the cycle hour."""
    return cet_day(reference_date).cast("timestamp") + hours(init_hour)


def snap_to_cycle(loaded_at: Column, cycle_hours: int = 12, lag_hours: int = 5) -> Column:
    """Latest cycle that was at least ``lag_hours`` old when the row was loaded."""
    t = loaded_at.cast("timestamp") - hours(lag_hours)
    hour = (F.floor(F.hour(t) / cycle_hours) * cycle_hours).cast("int")
    return F.date_trunc("day", t) + hours(hour)


def load_cycle_hour(loaded_at: Column) -> Column:
    """Cycle hour alone (no date shift): loads from 05:00 are the 00z, from 17:00 the 12z,
    earlier ones the 12z."""
    h = F.hour(loaded_at)
    return F.when(h >= 17, 12).when(h >= 5, 0).otherwise(12)


def pattern_init_hour(pattern: Column) -> Column:
    return F.when(pattern.contains("12"), 12).otherwise(0)


def lead_day(day: Column, lead_from: Column) -> Column:
    """Days ahead of ``lead_from``; callers choose the UTC issue day or the init day."""
    return F.datediff(day, F.to_date(lead_from))


def is_leap(day: Column) -> Column:
    y = F.year(day)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def doy365(day: Column) -> Column:
    """Day of year on a 365-day calendar: one less after February in leap years."""
    return F.dayofyear(day) - F.when(is_leap(day) & (F.month(day) > 2), 1).otherwise(0)


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def week_label(day: Column) -> Column:
    return F.concat(F.lit("W"), F.weekofyear(day))


def winter_start_year(day: Column) -> Column:
    return F.year(day) - F.when(F.month(day) <= 7, 1).otherwise(0)


def winter_season(day: Column) -> Column:
    y = winter_start_year(day)
    return F.concat(y.cast("string"), F.lit("/"), (y + 1).cast("string"))


def day_of_winter(day: Column) -> Column:
    """1 on 1 October; negative before it from August on."""
    return F.datediff(day, F.make_date(winter_start_year(day), F.lit(10), F.lit(1))) + 1


def season(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM")
            .when(month.isin(6, 7, 8), "JJA").otherwise("SON"))


def heating_season(month: Column) -> Column:
    return (F.when(month.isin(11, 12, 1, 2, 3), "winter").when(month.isin(6, 7, 8), "summer")
            .otherwise("shoulder"))


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def report_windows(day: Column) -> dict[str, Column]:
    """The two tabulated windows, the third one, and the comparison offset of a report day.

    Monday and Tuesday look at the running week, Wednesday and Thursday at the
    weekend, Friday to Sunday at the coming week; each is followed by a whole week.
    """
    wd = F.weekday(day)
    start = (F.when(wd < 2, F.date_add(day, -wd))
             .when(wd < 4, F.date_add(day, F.lit(5) - wd))
             .otherwise(F.date_add(day, F.lit(7) - wd)))
    length = F.when(wd.isin(2, 3), 2).otherwise(7)
    w1_end = F.date_add(start, length - 1)
    back = F.when(wd == 0, 3).when(wd >= 5, wd - 4).otherwise(1)
    return {
        "w1_start": start, "w1_end": w1_end,
        "w2_start": F.date_add(w1_end, 1), "w2_end": F.date_add(w1_end, 7),
        "w3_start": F.date_add(w1_end, 8), "w3_end": F.date_add(w1_end, 14),
        "prev_days": back,
        "delta_label": F.concat(F.lit("Δ -"), (back * 24).cast("string"), F.lit("h")),
        "kind1": F.when(wd.isin(2, 3), "weekend").otherwise("week"),
    }


def gas_run_pair(pattern: Column, init: Column) -> dict[str, Column]:
    """Which run a scored run is compared with, and over which days the change is summed."""
    day0 = F.to_date(init)
    hour = F.when(F.hour(init) != 0, F.hour(init)).otherwise(
        F.when(pattern.endswith("12ens"), 12).otherwise(0))
    report = F.date_add(day0, F.when(hour < 12, 0).otherwise(1))
    monday = F.weekday(report) == 0
    first_cycle = hour == 0
    back = F.when(first_cycle, F.when(monday, 3).otherwise(1)).otherwise(
        F.when(monday & (report != day0), 2).otherwise(0))
    prev_pattern = F.when(~first_cycle & pattern.endswith("12ens"),
                          F.replace(pattern, F.lit("12ens"), F.lit("00ens"))).otherwise(pattern)
    return {
        "prev_pattern": prev_pattern,
        "prev_day": F.date_sub(day0, back),
        "d_in": F.date_add(day0, F.when(monday, 0).otherwise(1)),
        "d_out": F.date_add(day0, F.when(monday, 11).otherwise(13)),
        "is_monday": monday,
    }


def forecast_windows(issue: Column, last: Column) -> dict[str, Column]:
    """Rest of the issue week, next week and the week after, cut at the last forecast day.

    The issue day is never in a window. A window the forecast does not reach, or the
    rest of the week on a Sunday issue, is NULL at both ends.
    """
    monday = F.next_day(issue, "Mon")
    spans = {
        "rest": (F.date_add(issue, 1), F.date_sub(monday, 1)),
        "next": (monday, F.date_add(monday, 6)),
        "after": (F.date_add(monday, 7), F.date_add(monday, 13)),
    }
    out = {}
    for name, (a, b) in spans.items():
        there = (a <= b) & (a <= last)
        out[f"{name}_start"] = F.when(there, a)
        out[f"{name}_end"] = F.when(there, F.least(b, last))
    return out
