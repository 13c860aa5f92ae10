"""Public holidays and day types, computed on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# National holidays on fixed dates as month-day numbers (1003 = 3 October).
FIXED_DATES = {
    "DE": [1003], "FR": [508, 714, 815, 1101, 1111],
    "IT": [106, 425, 602, 815, 1101, 1208],
    "ES": [106, 815, 1012, 1101, 1206, 1208],
    "NL": [427], "BE": [721, 815, 1101, 1111],
    "PL": [106, 503, 815, 1101, 1111], "AT": [106, 815, 1026, 1101, 1208],
    "CH": [801], "CZ": [508, 705, 706, 928, 1028, 1117],
    "HU": [315, 820, 1023, 1101], "PT": [425, 610, 815, 1005, 1101, 1201, 1208],
    "SK": [106, 508, 705, 829, 901, 915, 1101, 1117],
    "SI": [208, 427, 625, 815, 1031, 1101], "HR": [106, 530, 622, 805, 815, 1101, 1118],
    "NO": [517], "SE": [106, 606], "FI": [106, 1206], "DK": [605],
    "EE": [224, 623, 624, 820], "LV": [504, 623, 624, 1118],
    "LT": [216, 311, 624, 706, 815, 1101],
}
# National holidays as days from Easter Sunday.
EASTER_OFFSETS = {
    "DE": [39, 50], "FR": [39, 50], "NL": [39, 50], "BE": [39, 50], "AT": [39, 50, 60], "CH": [39, 50],
    "PL": [60], "HU": [50], "PT": [60], "HR": [60], "NO": [-3, 39, 50], "SE": [39], "FI": [39], "DK": [-3, 39, 50],
}
# Holidays everywhere, and the days between Christmas and New Year.
COMMON_DATES = [101, 501, 1225, 1226]
COMMON_EASTER = [-2, 1]
YEAR_END_DATES = [1224, 1227, 1228, 1229, 1230, 1231]


_FIRST_YEAR, _LAST_YEAR = 1583, 2999


def _easter_in_march(year: int) -> int:
    """Easter Sunday as a day counted from 1 March: the Sunday after the ecclesiastical full moon, by the epact."""
    century = year // 100 + 1
    lost_leap_days = 3 * century // 4 - 12
    golden = year % 19 + 1
    epact = (11 * golden + 20 + (8 * century + 5) // 25 - 5 - lost_leap_days) % 30
    if epact == 24 or (epact == 25 and golden > 11):
        epact += 1
    moon = 44 - epact if epact < 24 else 74 - epact
    sunday = 5 * year // 4 - lost_leap_days - 10
    return moon + 7 - (sunday + moon) % 7


# One number per Gregorian year, made by rule: a constant array is read by position,
# where the arithmetic on columns would be expanded many times over in every use.
_EASTER = [_easter_in_march(y) for y in range(_FIRST_YEAR, _LAST_YEAR + 1)]


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year; NULL outside 1583 to 2999."""
    table = F.split(F.lit(",".join(map(str, _EASTER))), ",").cast("array<int>")  # one literal, folded to a constant
    days = F.get(table, (year - _FIRST_YEAR).cast("int"))
    return F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(1)), days - 1)


def month_day(day: Column) -> Column:
    return F.month(day) * 100 + F.dayofmonth(day)


def _bank_monday(day: Column) -> Column:
    """First and last Monday of May, last Monday of August."""
    monday, dom = F.weekday(day) == 0, F.dayofmonth(day)
    return monday & (((F.month(day) == 5) & ((dom <= 7) | (dom > 24))) | ((F.month(day) == 8) & (dom > 24)))


def is_common_holiday(day: Column) -> Column:
    gap = F.datediff(day, easter(F.year(day)))
    return month_day(day).isin(COMMON_DATES) | gap.isin(COMMON_EASTER)


def _listed(table: dict[str, list[int]], area: Column, number: Column) -> Column:
    lists = F.create_map(*[x for code, days in table.items() for x in (F.lit(code), F.lit(days))])
    return F.coalesce(F.array_contains(F.try_element_at(lists, area), number), F.lit(False))


def is_holiday(day: Column, area: Column) -> Column:
    """Holiday of an area, read off the day itself: no calendar has to be joined."""
    md, gap = month_day(day), F.datediff(day, easter(F.year(day)))
    return (md.isin(COMMON_DATES + YEAR_END_DATES) | gap.isin(COMMON_EASTER)
            | _listed(FIXED_DATES, area, md) | _listed(EASTER_OFFSETS, area, gap)
            | ((area == "UK") & _bank_monday(day)))


def holiday_calendar(areas_years: DataFrame) -> DataFrame:
    """(area, year) rows to one row per holiday (area, day)."""
    days = F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))))
    return (areas_years.select("area", "year", days.alias("day"))
            .filter(is_holiday(F.col("day"), F.col("area"))).select("area", "year", "day"))


def daytype_gas(day: Column) -> Column:
    """Weekend wins over the common holidays."""
    wd = F.weekday(day)
    return (F.when(wd == 5, "sat").when(wd == 6, "sun").when(is_common_holiday(day), "holiday")
            .otherwise("weekday"))


def daytype_load(day: Column, area: Column) -> Column:
    """A holiday wins over the weekend."""
    wd = F.weekday(day)
    return (F.when(is_holiday(day, area), "holiday").when(wd == 5, "sat").when(wd == 6, "sun")
            .otherwise("weekday"))
