"""Calendar features as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Month and weekday names and their numbers (Monday = 1).
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
            "Saturday", "Sunday"]
# Months counted as warm for the high-ozone label.
WARM_MONTHS = ["May", "June", "July", "August", "September"]
# Fourier period (days, also in leap years) and harmonics.
FOURIER_PERIOD = 365
FOURIER_HARMONICS = 2


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def calendar_date(ts) -> Column:
    """Wall-clock date of a timestamp (NTZ) or of an offset timestamp string.

    For strings like ``2024-01-01 00:30:00+01:00`` the local date is the first
    ten characters; parsing to an instant first would shift it to UTC.
    """
    return F.to_date(_c(ts))


def wall_clock_date(s) -> Column:
    return F.try_to_date(F.substring(_c(s), 1, 10), "yyyy-MM-dd")


def month_name(d) -> Column:
    return F.date_format(_c(d), "MMMM")


def weekday_name(d) -> Column:
    return F.date_format(_c(d), "EEEE")


def _lookup(names: list[str]) -> Column:
    pairs = []
    for i, n in enumerate(names, start=1):
        pairs += [F.lit(n), F.lit(i)]
    return F.create_map(*pairs)


def month_number(name) -> Column:
    """Month name -> 1..12; unknown -> NULL."""
    return F.try_element_at(_lookup(MONTHS), _c(name))


def weekday_number(name) -> Column:
    """Weekday name -> Monday=1..Sunday=7; unknown -> NULL."""
    return F.try_element_at(_lookup(WEEKDAYS), _c(name))


def day_of_year(d) -> Column:
    return F.dayofyear(_c(d))


def fourier_terms(doy, harmonics: int = FOURIER_HARMONICS,
                  period: int = FOURIER_PERIOD) -> list[Column]:
    """[sin_1, cos_1, sin_2, cos_2, ...] of 2*pi*k*doy/period."""
    out = []
    for k in range(1, harmonics + 1):
        angle = F.lit(2 * math.pi * k) * _c(doy) / F.lit(float(period))
        out += [F.sin(angle).alias(f"sin_{k}"), F.cos(angle).alias(f"cos_{k}")]
    return out


def hour_after(ts) -> Column:
    return _c(ts) + F.expr("INTERVAL 1 HOUR")


# --- public holidays (Netherlands rule set) ---------------------------------
# The rule set. Fixed-date holidays as (month, day, name).
FIXED_HOLIDAYS = [(1, 1, "New Year's Day"), (12, 25, "Christmas Day"),
                  (12, 26, "Second Day of Christmas")]
# Easter-relative holidays as (offset in days, name).
EASTER_HOLIDAYS = [(0, "Easter Sunday"), (1, "Easter Monday"),
                   (39, "Ascension Day"), (49, "Whit Sunday"),
                   (50, "Whit Monday")]
# Royal holiday - King's Day 27 April from 2014 (26 April if that
# is a Sunday); Queen's Day 30 April before (29 April if Sunday). Liberation Day
# 5 May in years divisible by 5.
KINGS_DAY_FROM = 2014
LIBERATION_EVERY = 5


# Anonymous Gregorian computus. Each step only uses columns of earlier steps,
# so no step re-inlines the previous ones (keeps generated code small); the
# independent intermediates of a step share one projection.
_EASTER_STEPS = [
    {"_ea": "_ey % 19", "_eb": "_ey div 100", "_ec": "_ey % 100"},
    {"_ed": "_eb div 4", "_ee": "_eb % 4", "_ef": "(_eb + 8) div 25", "_ei": "_ec div 4",
     "_ek": "_ec % 4"},
    {"_eg": "(_eb - _ef + 1) div 3"},
    {"_eh": "(19 * _ea + _eb - _ed - _eg + 15) % 30"},
    {"_el": "(32 + 2 * _ee + 2 * _ei - _eh - _ek) % 7"},
    {"_em": "(_ea + 11 * _eh + 22 * _el) div 451"},
    {"_en": "_eh + _el - 7 * _em + 114"},
]


def with_easter(df: DataFrame, year, out: str = "easter") -> DataFrame:
    """Append ``out`` = Easter Sunday of ``year`` (an int column)."""
    tmp = df.withColumn("_ey", _c(year).cast("bigint"))
    for step in _EASTER_STEPS:
        tmp = tmp.withColumns({name: F.expr(e) for name, e in step.items()})
    tmp = tmp.withColumn(out, F.expr("make_date(CAST(_ey AS INT), CAST(_en div 31 AS INT), "
                                     "CAST(_en % 31 + 1 AS INT))"))
    return tmp.drop("_ey", *[n for step in _EASTER_STEPS for n in step])


def holiday_calendar(years: DataFrame, year_col: str = "year") -> DataFrame:
    """(holiday_date, holiday_name) for each distinct year in ``years``."""
    years = with_easter(years.select(F.col(year_col).cast("int").alias("_y")).distinct(),
                        F.col("_y"), "_easter")
    y = F.col("_y")
    easter = F.col("_easter")
    royal_base = F.when(y >= KINGS_DAY_FROM, F.make_date(y, F.lit(4), F.lit(27))) \
                  .otherwise(F.make_date(y, F.lit(4), F.lit(30)))
    royal = F.when(F.dayofweek(royal_base) == 1, F.date_sub(royal_base, 1)).otherwise(royal_base)
    royal_name = F.when(y >= KINGS_DAY_FROM, F.lit("King's Day")).otherwise(F.lit("Queen's Day"))
    entries = [F.struct(F.make_date(y, F.lit(mo), F.lit(dd)).alias("d"), F.lit(n).alias("n"))
               for mo, dd, n in FIXED_HOLIDAYS]
    entries += [F.struct(F.date_add(easter, off).alias("d"), F.lit(n).alias("n"))
                for off, n in EASTER_HOLIDAYS]
    entries.append(F.struct(royal.alias("d"), royal_name.alias("n")))
    entries.append(F.struct(
        F.when(y % LIBERATION_EVERY == 0, F.make_date(y, F.lit(5), F.lit(5))).alias("d"),
        F.lit("Liberation Day").alias("n")))
    return (years.select(F.inline(F.array(*entries)))
            .where(F.col("d").isNotNull())
            .select(F.col("d").alias("holiday_date"), F.col("n").alias("holiday_name"))
            .distinct())


# A year is a 4-digit number, so the calendar holds at most 10000 * 11 rows.
MAX_HOLIDAY_ROWS = 10000 * (len(FIXED_HOLIDAYS) + len(EASTER_HOLIDAYS) + 2)


def with_holiday_flag(df: DataFrame, date_col: str = "date",
                      out: str = "holiday") -> DataFrame:
    """Boolean ``out`` = date is a public holiday.

    Every rule is evaluated for the row's own year, so the flag is a narrow
    projection: no join and no second pass over the input.
    """
    d = F.col(date_col)
    y = F.year(d)
    tmp = with_easter(df, y, "_easter")
    royal_base = F.when(y >= KINGS_DAY_FROM, F.make_date(y, F.lit(4), F.lit(27))) \
                  .otherwise(F.make_date(y, F.lit(4), F.lit(30)))
    royal = F.when(F.dayofweek(royal_base) == 1, F.date_sub(royal_base, 1)).otherwise(royal_base)
    md = F.month(d) * 100 + F.dayofmonth(d)
    fixed = md.isin([mo * 100 + dd for mo, dd, _ in FIXED_HOLIDAYS])
    from_easter = F.datediff(d, F.col("_easter")).isin([off for off, _ in EASTER_HOLIDAYS])
    liberation = (y % LIBERATION_EVERY == 0) & (md == 505)
    flag = F.coalesce(fixed | from_easter | (d == royal) | liberation, F.lit(False))
    return tmp.withColumn(out, flag).drop("_easter")


def with_holiday_flag_join(df: DataFrame, date_col: str = "date",
                           out: str = "holiday") -> DataFrame:
    """Same flag through the calendar dimension: distinct years -> holiday
    dates -> broadcast left join (the dimension is bounded by MAX_HOLIDAY_ROWS)."""
    cal = holiday_calendar(df.select(F.year(date_col).alias("year")))
    cal = cal.select(F.col("holiday_date").alias("_hd")).distinct()
    joined = df.join(F.broadcast(cal),
                     F.col(date_col) == F.col("_hd"), "left")
    return joined.withColumn(out, F.col("_hd").isNotNull()).drop("_hd")
