"""Types of expressions, and the texts of dates and intervals."""

from __future__ import annotations

import calendar
import datetime
import re
from dataclasses import dataclass

from pyspark.sql import types as T

INT, DOUBLE, STRING, DATETIME, BOOL, INTERVAL, NULL = "INT", "DOUBLE", "STRING", "DATETIME", "BOOL", "INTERVAL", "NULL"

#: Names that CAST, CONVERT and :: know.
TARGETS = {
    "INT": INT, "INTEGER": INT, "DOUBLE": DOUBLE, "DECIMAL": DOUBLE, "NUMERIC": DOUBLE, "FLOAT": DOUBLE,
    "STRING": STRING, "VARCHAR": STRING, "CHAR": STRING, "DATETIME": DATETIME, "BOOL": BOOL, "BOOLEAN": BOOL,
}


def of_spark(kind: T.DataType) -> str | None:
    """The expression type of a Spark type; None where there is none (arrays, maps, structs, binary)."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DOUBLE
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(kind, T.BooleanType):
        return BOOL
    return None


#: DATETIME constants go from minus to plus so many seconds since 1970, one less than a timestamp of 64-bit microseconds.
LAST_SECOND = (1 << 63) // 1_000_000 - 2

_TIME = r"(?:.(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.\d*)?)?)?)?"
_ZONE = r"\s*(Z|[+-]\d{2}:?\d{2})?"
#: Year first: groups year, month, day, hour, minute, second, zone.
YEAR_FIRST = r"^ *(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})" + _TIME + r")?)?" + _ZONE + r" *$"
#: Month first: groups month, day, year, hour, minute, second, zone.
MONTH_FIRST = r"^ *(\d{1,2})-(?:(\d{1,2})-)?(\d{4})" + _TIME + _ZONE + r" *$"


def parse_datetime(text: str) -> int | None:
    """Seconds since 1970 UTC, or None where the text is no date."""
    if m := re.match(YEAR_FIRST, text, re.S):
        year, month, day, *rest = m.groups()
    elif m := re.match(MONTH_FIRST, text, re.S):
        month, day, year, *rest = m.groups()
    else:
        return None
    hour, minute, second, zone = rest
    try:
        d = datetime.datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0))
    except ValueError:
        return None
    shift = 0
    if zone and zone != "Z":
        shift = (int(zone[1:3]) * 3600 + int(zone[-2:]) * 60) * (1 if zone[0] == "+" else -1)
    return calendar.timegm(d.timetuple()) - shift


@dataclass(frozen=True)
class Interval:
    """A span; ``text`` is how it was written."""

    years: int = 0
    months: int = 0
    days: int = 0
    hours: int = 0
    minutes: int = 0
    seconds: int = 0
    microseconds: int = 0
    text: str = ""

    @property
    def whole_months(self) -> int:
        return 12 * self.years + self.months

    @property
    def clock_seconds(self) -> int:
        return 3600 * self.hours + 60 * self.minutes + self.seconds + int(self.microseconds / 1_000_000)


_UNITS = ("year", "month", "day", "hour", "minute", "second", "microsecond")
_ISO = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$", re.I)


def parse_interval(text: str) -> Interval | None:
    """``1 day 2 hours`` (the last value of a unit wins) or ISO 8601 (a week is seven days and takes the place of days)."""
    plain = text.strip()
    if (m := _ISO.match(plain)) and len(plain) > 1:
        years, months, weeks, days, hours, minutes, seconds = (int(g) if g else 0 for g in m.groups())
        return Interval(years, months, days or 7 * weeks, hours, minutes, seconds, 0, text)
    if not re.fullmatch(r"(?:\d+\s*[A-Za-z]+\s*)+", plain):
        return None
    found = {}
    for n, unit in re.findall(r"(\d+)\s*([A-Za-z]+)", plain):
        name = unit.lower().removesuffix("s")
        if name not in _UNITS:
            return None
        found[f"{name}s"] = int(n)
    return Interval(**found, text=text)
