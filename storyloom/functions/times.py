"""Times for readers: local times, ages, window starts, long dates; the run's time is always a parameter (F-31, F-32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic names of the days (Monday first) and months.
ARABIC_DAYS = "الاثنين الثلاثاء الأربعاء الخميس الجمعة السبت الأحد".split()
ARABIC_MONTHS = "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر".split()
ENGLISH_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
ENGLISH_MONTHS = "January February March April May June July August September October November December".split()


def local_seconds(instant: Column, zone: str = "Asia/Kuwait") -> Column:
    """Seconds of the local clock since 1970, whatever the session's zone."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(F.unix_seconds(instant)), zone))


def local_date(instant: Column, zone: str = "Asia/Kuwait") -> Column:
    return F.date_from_unix_date(F.floor(local_seconds(instant, zone) / 86400).cast("int"))


def local_text(instant: Column, zone: str = "Asia/Kuwait") -> Column:
    """YYYY-MM-DD HH:MM; 'time unknown' without a time."""
    s = F.pmod(local_seconds(instant, zone), F.lit(86400))
    text = F.format_string("%s %02d:%02d", local_date(instant, zone).cast("string"), F.floor(s / 3600), F.floor(s / 60) % 60)
    return F.when(instant.isNull(), "time unknown").otherwise(text)


def age_text(instant: Column, run: Column) -> Column:
    """Whole minutes, hours or days since the instant, never negative; 'time unknown' without one."""
    s = F.greatest(F.unix_seconds(run) - F.unix_seconds(instant), F.lit(0))
    return F.when(instant.isNull(), "time unknown").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))


def window_start(run: Column, hours: int = 26) -> Column:
    return run - F.expr(f"INTERVAL {int(hours)} HOURS")


def long_date(date: Column, arabic: bool = False) -> Column:
    """Weekday, day, month and year in words."""
    days, months = (ARABIC_DAYS, ARABIC_MONTHS) if arabic else (ENGLISH_DAYS, ENGLISH_MONTHS)
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), i)
    return F.concat_ws(" ", pick(days, F.weekday(date) + 1), F.dayofmonth(date).cast("string"), pick(months, F.month(date)), F.year(date).cast("string"))
