"""Dates as people write them, read by a grammar over tokens.

A clock is taken out wherever it stands, week days, ordinal endings and fillers go, and what is left becomes a shape of tokens: year (four digits),
number (one or two), month name. The shape alone decides which token is the year, the month and the day.
"""

from pyspark.sql import Column, functions as F

from .text import let, strip

# Names in English, whole or short.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
WEEKDAYS = "mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs?(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
_MONTH = rf"(?<![a-z])({MONTHS})(?![a-z])\.?"
_DROPPED = rf"(?<![a-z])(?:{WEEKDAYS})(?![a-z])[.,]?|(?<=\d)(?:st|nd|rd|th)(?![a-z])|(?<![a-z])of(?![a-z])"
# A clock: hours, minutes, seconds, fraction, am/pm, zone.
_CLOCK = r"(?:^|[T ,]+)(\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?(?: ?([AaPp])\.?[Mm]\.?)?(?: ?(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}))?(?=[ ,]|$)"
# What every date text begins with; one cheap test turns other texts away.
_BEGINNING = rf"(?i)^(?:(?:{WEEKDAYS})[., ]+)?(?:\d{{1,2}}(?:st|nd|rd|th)?[-/. :,]|\d{{1,2}}(?:{MONTHS})|\d{{4}}[-/. ]|\d{{8}}(?:[T ]|$)|(?:{MONTHS})[-/., ]+\d)"

# Shapes of tokens: year with four digits, n for a number of one or two, M for a month's name; separators count in shapes of digits only. Where both numbers could be
# the month, it is the first; a first number above 12 is the day. Without a day it is the first of the month.
YEAR_FIRST = ["Y-n-n", "Y/n/n", "Y.n.n", "Y-n", "Y/n", "YMn", "YM"]
YEAR_SECOND = ["n-Y", "n/Y", "nMY", "MnY", "nMn", "Mnn"]
YEAR_THIRD = ["n-n-Y", "n/n/Y", "n.n.Y", "n-n-n", "n/n/n"]
YEAR_ONLY = ["MY"]
NO_DAY = ["Y-n", "Y/n", "YM", "n-Y", "n/Y", "MY"]
COMPACT = "C"


def _shape(text: Column) -> Column:
    shape = F.regexp_replace(text, _MONTH, "M")
    for digits, letter in ((8, "C"), (4, "Y"), ("1,2", "n")):
        shape = F.regexp_replace(shape, rf"(?<!\d)\d{{{digits}}}(?!\d)", letter)
    return F.when(shape.contains("M"), F.regexp_replace(shape, "[ ,./-]+", "")).otherwise(F.btrim(shape, F.lit(" ,")))


def _year(digits: Column) -> Column:
    """Two digits are 1969 to 2068; one digit is no year."""
    return F.when(F.length(digits) == 4, digits).when(F.length(digits) == 2, F.concat(F.when(digits < "69", "20").otherwise("19"), digits))


def _date(text: Column) -> Column:
    name = F.substring(F.regexp_extract(text, _MONTH, 1), 1, 3)
    named = ((F.position(name, F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int").cast("string")
    # three runs of digits, with the shape in front: computed once and used by all branches
    parts = F.concat(F.array(_shape(text)), F.regexp_extract_all(text, F.lit(r"(\d+)")), F.array(F.lit(""), F.lit(""), F.lit("")))

    def read(p):
        shape, one, two, three = p[0], p[1], p[2], p[3]
        first, second, third = shape.isin(YEAR_FIRST), shape.isin(YEAR_SECOND), shape.isin(YEAR_THIRD)
        has_name, day_first = shape.contains("M"), (F.length(one) == 2) & (one > "12")
        year = F.when(first | shape.isin(YEAR_ONLY), one).when(second, two).when(third, three)
        month = F.when(has_name, named).when(first, two).when(third & day_first, two).otherwise(one)
        day = F.when(shape.isin(NO_DAY), "1").when(first & has_name, two).when(first, three).when(third & ~day_first, two).otherwise(one)
        compact = F.regexp_replace(text, r"^\D*(\d{4})(\d{2})(\d{2})\D*$", "$1-$2-$3")
        return F.when(shape == COMPACT, compact).otherwise(F.concat(_year(year), F.lit("-"), month, F.lit("-"), day)).try_cast("date")

    return let(parts, read)


def _clock(t: Column) -> Column:
    """Time of day as an interval, zone taken off; null when out of range."""
    number = lambda i: F.coalesce(F.regexp_extract(t, _CLOCK, i).try_cast("int"), F.lit(0))
    half, zone = F.lower(F.regexp_extract(t, _CLOCK, 5)), F.regexp_extract(t, _CLOCK, 6)
    hour = F.when(half == "", number(1)).when(number(1).between(1, 12), number(1) % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    second = number(3) + F.coalesce(F.regexp_extract(t, _CLOCK, 4).try_cast("decimal(18,6)"), F.lit(0))
    away = F.when(zone.rlike("^[+-]"), F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (
        F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int"))).otherwise(0)
    return F.when((hour < 24) & (number(2) < 60) & (number(3) < 60), F.make_dt_interval(F.lit(0), hour, number(2) - away, second))


def may_be_date(c: Column) -> Column:
    """Whether a text begins like a date; true for every text that ``parse_datetime`` reads."""
    return strip(c.cast("string")).rlike(_BEGINNING)


def parse_datetime(c: Column) -> Column:
    """Text to timestamp_ntz by the grammar, with or without a clock; null when it isn't a date. A time with a zone becomes UTC, a month alone its first day."""
    def read(t):
        clocked = t.rlike(_CLOCK)
        plain = F.lower(F.when(clocked, F.regexp_replace(t, _CLOCK, " ")).otherwise(t))
        day = let(strip(F.regexp_replace(plain, _DROPPED, "")), _date).cast("timestamp_ntz")
        return F.when(clocked, day + _clock(t)).otherwise(day)

    return let(strip(c.cast("string")), lambda t: F.when(t.rlike(_BEGINNING), read(t)))
