"""Timestamps in mixed formats, precisions and zones, as one UTC instant (problem 7).

An ordered cascade of anchored patterns rewrites a value into `year|month|day|hour|minute|second|half|zone`;
one strict reader then checks every part against the calendar. Everything is a column expression, so the
parser runs inside whole-stage code generation and its result does not depend on the session's time zone.

Policy for local times (values without zone or offset are local to the source's zone):
a time that occurs twice (clocks set back) is the earlier instant; a time that does not occur (clocks set
forward) is moved forward by the length of the gap.

Null, empty, blank and meaningless values and days outside the calendar give null. A null zone counts as UTC.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.vocab.calendar import ZONE_MINUTES, month_numbers

_SPACE = r"[\s\p{Z}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}]"
_ZONE = r"(?:\s*(Z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}:?\d{0,2}))?"
_CLOCK = r"(\d{1,2})(?::|h|\.)(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([AaPp])\.?[Mm]\.?)?(?:\s*Uhr)?"
_WEEKDAY = r"(?:\p{L}+\.?,?\s+)?"

#: (pattern, its parts as year|month|day|hour|minute|second|half|zone). Slashed dates have the day first here;
#: where the month comes first the two numbers are exchanged before. A rewritten value matches no later pattern.
_CASCADE: list[tuple[str, str]] = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:[Tt]|,?\s+){_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt]?(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE})?$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+(?:-\s+)?{_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})[.-](\d{{1,2}})[.-](\d{{4}})(?:,?\s+(?:um\s+|-\s+)?{_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^{_WEEKDAY}(\d{{1,2}})(?:\.|er|st|nd|rd|th)?[\s-]+(?:de\s+)?(\p{{L}}+)\.?,?[\s-]+(\d{{4}})(?:,?\s*(?:[-–—]|à|um|at|في|ساعت)?\s*{_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^{_WEEKDAY}(\p{{L}}+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s*(?:[-–—]|at)?\s*{_CLOCK}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    # the form of C's asctime: Mon Mar 16 04:17:00 [zone] 2026
    (rf"^\p{{L}}+\s+(\p{{L}}+)\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:\s+([A-Za-z]{{2,5}}|[+-]\d{{4}}))?\s+(\d{{4}})$", "$7|$1|$2|$3|$4|$5||$6"),
]

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def clean_stamp(value: Column) -> Column:
    """Without markup, surrounding white space and invisible marks; digits of other scripts as ASCII digits."""
    v = F.regexp_replace(value, r"<!\[CDATA\[|\]\]>|<[^>]*>|&nbsp;|&#160;", " ")
    v = F.translate(v, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹،", "01234567890123456789,")
    return F.trim(F.regexp_replace(v, f"{_SPACE}+", " "))


def known_zone(zone: Column) -> Column:
    """The zone where it is an IANA name, else UTC. Apply it to the small table of sources, not to facts."""
    return F.when(zone.isin(*sorted(zoneinfo.available_timezones())), zone).otherwise(F.lit("UTC"))


def with_utc_seconds(rows: DataFrame, value: str, zone: str, out: str) -> DataFrame:
    """`rows` with `out`: seconds since 1970-01-01 UTC that `value` denotes, or null; `zone`: column of IANA zones.

    The steps are separate projections, each read more than once by the next, so that Catalyst keeps them apart
    and every pattern is matched once per row.
    """
    v, p, z = F.col("__v"), F.col("__p"), F.coalesce(F.col(zone), F.lit("UTC"))
    month_first = z.startswith("America/")
    parts = F.when(month_first, F.regexp_replace(v, r"^(\d{1,2})/(\d{1,2})/(?=\d{4})", "$2/$1/")).otherwise(v)
    for pattern, order in _CASCADE:
        parts = F.regexp_replace(parts, pattern, order)
    epoch = (
        F.when(v.rlike(r"^-?\d{9,10}(\.\d+)?$"), F.floor(v.try_cast("decimal(38,9)")).cast("bigint"))
        .when(v.rlike(r"^-?\d{12,13}(\.\d+)?$"), F.floor(v.try_cast("decimal(38,9)") / 1000).cast("bigint"))
        .when(v.rlike(r"^-?\d{15,16}$"), F.floor(v.try_cast("decimal(38,0)") / 1000000).cast("bigint"))
        .when(v.rlike(r"^-?\d{18,19}$"), F.floor(v.try_cast("decimal(38,0)") / 1000000000).cast("bigint"))
    )
    at = lambda i: F.get(p, F.lit(i))
    months = F.create_map(*[F.lit(x) for pair in sorted(month_numbers().items()) for x in pair])
    zones = F.create_map(*[F.lit(x) for pair in sorted(ZONE_MINUTES.items()) for x in pair])
    pad = lambda c, n: F.lpad(c, n, "0")
    month = F.coalesce(F.try_element_at(months, F.lower(at(1))).cast("string"), at(1))
    clock = F.when(at(3) == "", "00:00:00").otherwise(F.concat_ws(":", pad(at(3), 2), pad(at(4), 2), pad(at(5), 2)))
    stamp = F.concat(pad(at(0), 4), F.lit("-"), pad(month, 2), F.lit("-"), pad(at(2), 2), F.lit(" "), clock)
    rows = rows.withColumn("__v", clean_stamp(F.col(value)))
    rows = rows.withColumn("__e", epoch).withColumn("__p", F.split(parts, r"\|", -1))
    rows = rows.withColumn("__n", F.regexp_replace(F.lower(at(7)), r"^(utc|gmt)(?=[+-])", "")).withColumn("__t", stamp.try_cast("timestamp_ntz"))
    half, name = F.lower(at(6)), F.col("__n")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("__t"))
    hour = F.hour("__t")
    shift = F.when(half == "", 0).when((hour == 0) | (hour > 12), None).when((half == "a") & (hour == 12), -43200).when((half == "p") & (hour < 12), 43200).otherwise(0)
    rows = rows.withColumn("__local", seconds + shift)
    signed = F.regexp_replace(name, r"^([+-])(\d):?(\d\d)?$", "$10$2:$3")
    offset = F.when(signed.rlike(r"^[+-]\d\d"), F.concat(F.substring(signed, 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substring(signed, 4, 3), ":", ""), 2, "0")))
    minutes = F.try_element_at(zones, name)
    in_zone = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.col("__local")), z))
    apart = F.when(offset.rlike(r"^[+-](0\d|1[0-8]):[0-5]\d$"), F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.col("__local")), offset)))
    stamped = F.when(name == "", in_zone).when(minutes.isNotNull(), F.col("__local") - minutes * 60).otherwise(apart)
    return rows.withColumn(out, F.coalesce(F.col("__e"), stamped)).drop("__v", "__e", "__p", "__n", "__t", "__local")


def is_canonical(value: Column) -> Column:
    """Whether the value is already exactly of the form YYYY-MM-DDTHH:MM:SSZ."""
    return F.coalesce(value.rlike(CANONICAL), F.lit(False))
