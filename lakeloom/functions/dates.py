"""Date and time texts to values, without any use of the session's time zone.

A text's fields are taken out by one pattern over all layouts, and all values are
made from that array.  It is bound to a lambda variable, which computes it once a
row and keeps the expression out of generated code, where it is a method too large
for the JVM to compile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import layouts as L

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"  # three letters a month, so a name's place gives its number


class Fields:
    """Fields of a text, by name; empty where its layout has none, null where the text has no known layout."""

    def __init__(self, array: Column):
        self.array = array

    def text(self, name: str) -> Column:
        return F.get(self.array, F.lit(L.FIELDS.index(name) + 1))  # a text without a layout is left alone, before the first mark

    def number(self, *names: str) -> Column:
        """The field that is there of several of the same kind."""
        return F.coalesce(*[F.when(self.text(n) != "", self.text(n)) for n in names]).cast("int")  # the layout has digits there


def _bound(column: Column, value: Callable[[Column], Column]) -> Column:
    """``value`` of a column that is computed once, however often it is named."""
    return F.get(F.transform(F.array(column), value), F.lit(0))


def _read(text: Column, value: Callable[[Fields], Column]) -> Column:
    """What ``value`` makes of the fields of a text."""
    return _bound(F.split(F.regexp_replace(F.trim(text), L.READ, L.TAKEN), L.MARK, -1), lambda a: value(Fields(a)))


def _clock(f: Fields, date_order: str) -> Column:
    first, second = f.number("first"), f.number("second")
    day_first = (first > 12) if date_order == "MDY" else (second <= 12)
    name = F.lower(F.concat(f.text("word"), f.text("name")))  # one of them is empty
    at = F.when(name != "", F.instr(F.lit(MONTHS), name))
    month = F.coalesce(f.number("month"), F.when(day_first, second).otherwise(first), F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int")))
    day = F.coalesce(f.number("day"), F.when(day_first, first).otherwise(second), f.number("word_day", "name_day"))
    hour = F.coalesce(f.number("hour"), F.lit(0))
    hour = F.when(f.text("half") != "", hour % 12 + F.when(f.text("half") == "P", 12).otherwise(0)).otherwise(hour)
    fraction = F.when(f.text("fraction") != "", F.concat(F.lit("0"), F.substr(f.text("fraction"), F.lit(1), F.lit(7))).cast("decimal(8,6)"))
    seconds = F.coalesce(f.number("seconds"), F.lit(0)).cast("decimal(8,6)") + F.coalesce(fraction, F.lit(0).cast("decimal(8,6)"))
    year = f.number("year", "short_year", "word_year", "name_year")
    return F.when(year.isNotNull(), F.try_make_timestamp_ntz(year, month, day, hour, F.coalesce(f.number("minute"), F.lit(0)), seconds))


def _epoch(f: Fields) -> Column:
    ms = F.when(f.text("epoch") != "", f.text("epoch")).cast("long")
    start = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.when(ms.isNotNull(), start + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)")))


def _zone_minutes(f: Fields) -> Column:
    size = f.number("zone_hours") * 60 + f.number("zone_minutes")
    return F.when(f.text("zulu") != "", 0).otherwise(F.when(F.concat(f.text("gmt_sign"), f.text("sign")) == "-", -size).otherwise(size))


def wall_clock(text: Column, date_order: str = "MDY") -> Column:
    """Timestamp without zone as written; null if the layout or the date is not valid.

    Day and month of a text like 03/04/2024 follow ``date_order``, unless one of
    them is above 12.
    """
    return _read(text, lambda f: _clock(f, date_order))


def epoch_instant(text: Column) -> Column:
    """UTC wall clock of ``/Date(ms)/``, whose sign counts; null for other shapes."""
    return _read(text, _epoch)


def zone_minutes(text: Column) -> Column:
    """Minutes ahead of UTC that a text states; null if it states none."""
    return _read(text, _zone_minutes)


def minus_minutes(value: Column, minutes: Column) -> Column:
    return value - F.make_dt_interval(mins=minutes.cast("int"))


def zone_seconds(value: Column, zone: str) -> Column:
    """Seconds that an IANA zone is ahead of UTC at a wall clock there.

    Two passes: the zone's offset at the wall clock read as UTC gives a first
    instant, the offset there decides.  So an hour that is skipped or repeated
    has one defined result.
    """

    def offset(utc: Column) -> Column:
        # from_utc_timestamp works on the instant; NTZ values are instants in UTC when the offset is measured.
        shifted = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
        return F.timestamp_diff("SECOND", utc, shifted)

    def back(seconds: Column) -> Column:
        return value - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

    return offset(back(offset(value)))


def zone_to_utc(value: Column, zone: str) -> Column:
    """UTC wall clock of a wall clock in an IANA zone, both without zone."""
    return value - F.make_dt_interval(secs=zone_seconds(value, zone).cast("decimal(18,6)"))


def to_datetime(text: Column, zone: str | None = None, date_order: str = "MDY") -> Column:
    """Value of a datetime text as a UTC or wall-clock timestamp without zone.

    A stated offset is taken off; a text without one keeps its wall clock, or is
    converted from ``zone`` if that is given.
    """
    def parts(f: Fields) -> Column:
        stated = F.when(f.text("epoch") != "", 0).otherwise(_zone_minutes(f))
        return F.struct(F.coalesce(_clock(f, date_order), _epoch(f)).alias("clock"), stated.alias("stated"))

    def utc(read: Column) -> Column:
        clock, stated = read["clock"], read["stated"]
        if not zone:
            return minus_minutes(clock, F.coalesce(stated, F.lit(0)))
        return F.when(stated.isNull(), zone_to_utc(clock, zone)).otherwise(minus_minutes(clock, stated))

    return _bound(_read(text, parts), utc)


def to_date(text: Column, date_order: str = "MDY") -> Column:
    """Date as written, whatever zone the text states."""
    return _read(text, lambda f: F.coalesce(_epoch(f), _clock(f, date_order))).cast("date")


def to_time_text(text: Column) -> Column:
    """``HH:MM:SS`` as written, fraction kept; null if there is no time."""

    def shown(f: Fields) -> Column:
        seconds = F.when(f.text("seconds") == "", "00").otherwise(f.text("seconds"))
        parts = F.concat(F.lpad(f.text("hour"), 2, "0"), F.lit(":"), f.text("minute"), F.lit(":"), seconds, f.text("fraction"))
        return F.coalesce(F.date_format(_epoch(f), "HH:mm:ss"), F.when(f.text("hour") != "", parts))

    return _read(text, shown)
