"""How dates and times are written: one table of layouts for typing and for reading.

A layout is a day, a clock and a zone.  Typing asks for the exact shape, with
values in range; reading takes the layouts more loosely and hands out the fields,
all of them by one pattern.
"""

from __future__ import annotations

# Ranges, and how a day and a zone may be written.
YEAR, MONTH, DAY = "[0-9]{4}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
HOUR, SIXTY, TWO = "(?:[01][0-9]|2[0-3])", "[0-5][0-9]", "[0-9]{2}"
NAME = "[A-Za-z]{3}"
ZONE_NAME = "[A-Z]{3}"
QUOTE = '"?'


def _any(*shapes: str) -> str:
    return rf"\A(?:{'|'.join(shapes)})\z"


def _joined(mark: str, *parts: str) -> str:
    return mark.join(parts)


def _clock(hour: str, minute: str, second: str, needed: bool) -> str:
    return f"{hour}:{minute}:{second}" if needed else f"{hour}:{minute}(?::{second})?"


def _stamp(zoned: bool) -> str:
    """Texts with day and clock: those that state their zone, or those that don't."""

    def with_zone(clock: str, zone: str) -> str:
        return clock + (zone if zoned else "")

    layouts = {
        "epoch milliseconds": r"/Date\(" + with_zone("-?[0-9]{12,14}", r"\+[0-9]{4}") + r"\)/",
        "year first": _joined("[-/.]?", YEAR, MONTH, DAY) + r"[T\s]" + with_zone(_clock(HOUR, SIXTY, SIXTY, zoned) + r"(?:\.[0-9]+)?", f"(?:Z|[+-]{HOUR}:?{SIXTY}| {ZONE_NAME})"),
        "weekday first": _joined(" ", NAME, NAME, TWO, YEAR, "")
        + with_zone(_clock(TWO, TWO if zoned else SIXTY, TWO if zoned else SIXTY, zoned), rf" GMT[+-]?[0-9]{{4}}(?: \({ZONE_NAME}\))?"),
        "month first": f"{NAME} {TWO}, {YEAR} " + (f"{TWO}:{TWO}" if zoned else _clock(TWO, SIXTY, SIXTY, False)) + with_zone(" [AP]M", f" {ZONE_NAME}"),
    }
    epoch = layouts.pop("epoch milliseconds")
    return _any(epoch, *(QUOTE + shape + QUOTE for shape in layouts.values()))


ZONED, UNZONED = _stamp(True), _stamp(False)
ONLY_DAY = _any(*(_joined("[-/.]", *parts) for parts in ((YEAR, MONTH, DAY), (MONTH, DAY, YEAR), (DAY, MONTH, YEAR))))
ONLY_CLOCK = _any(_clock("(?:[01]?[0-9]|2[0-3])", SIXTY, SIXTY, False))

# Reading: the fields of every layout, in the order of their groups; those of other layouts are empty.
_READ = {
    "day": (
        (r"([0-9]{4})[-/.]?([0-9]{2})[-/.]?([0-9]{2})", ("year", "month", "day")),
        (r"([0-9]{2})[-/.]([0-9]{2})[-/.]([0-9]{4})", ("first", "second", "short_year")),
        (rf"{NAME} ({NAME}) ([0-9]{{2}}) ([0-9]{{4}})", ("word", "word_day", "word_year")),
        (rf"({NAME}) ([0-9]{{2}}), ([0-9]{{4}})", ("name", "name_day", "name_year")),
    ),
    "clock": ((r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(\.[0-9]+)?)?(?: ([AP])M)?", ("hour", "minute", "seconds", "fraction", "half")),),
    "zone": (
        (r"\s*(Z)", ("zulu",)),
        (rf"\s*(?:GMT([+-]?)|([+-]))([0-9]{{2}}):?([0-9]{{2}})(?: \({ZONE_NAME}\))?", ("gmt_sign", "sign", "zone_hours", "zone_minutes")),
        (f" {ZONE_NAME}", ()),
    ),
}


def _read(part: str) -> str:
    return "(?:" + "|".join(pattern for pattern, _ in _READ[part]) + ")"


READ = rf'\A{QUOTE}(?:/Date\((-?[0-9]{{1,14}})(?:[+-][0-9]+)?\)/|(?:{_read("day")}(?=[T\s"]|\z))?(?:[T\s]?{_read("clock")}{_read("zone")}?)?){QUOTE}\z'
FIELDS = ("epoch", *(name for part in _READ.values() for _, names in part for name in names))
MARK = "\u0001"
TAKEN = "".join(f"{MARK}${i}" for i in range(1, len(FIELDS) + 1))  # replacement that leaves the fields alone, each after a mark
