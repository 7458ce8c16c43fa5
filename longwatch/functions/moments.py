"""ISO 8601 dates and moments in all their written forms, as column expressions.

The grammar is read in stages: where the date ends, the date (calendar or week
dates, with hyphens or without), one character of any kind, the time (with
colons or without), the offset. Every stage is null where the text does not
fit, so one bad part makes the whole null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from longwatch.functions.horizon import format_instant
from longwatch.functions.text import strip

_MICROS = 1_000_000


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _group(text: Column, pattern: str, k: int) -> Column:
    """A group's whole number, null where it has none."""
    found = F.regexp_extract(text, pattern, k)
    return F.when(found != "", found.cast("int"))


_DAY = r"\A(\d{4})(-?)(\d{2})\2(\d{2})\z"
_WEEK = r"\A(\d{4})(-?)W(\d{2})(?:\2(\d))?\z"


def calendar_date(text: Column) -> Column:
    """A date written as 2038-01-19, 20380119, 2038-W03-2, 2038W032, or a week alone for its Monday; null for anything else."""

    def of_week(w: Column) -> Column:
        # the week of a year that has one less is the first of the next
        return _let(F.date_add(w["monday"], (w["number"] - 1) * 7), lambda at: F.when(w["number"].between(1, 53) & (F.weekofyear(at) == w["number"]) & w["day"].between(1, 7), F.date_add(at, w["day"] - 1)))

    def read(t: Column) -> Column:
        plain = F.when(t.rlike(_DAY) & ~t.startswith("0000"), F.regexp_replace(t, _DAY, "$1-$3-$4").try_cast("date"))
        year = F.regexp_extract(t, _WEEK, 1)
        fourth = F.when((year != "") & (year != "0000"), F.concat(year, F.lit("-01-04")).try_cast("date"))
        monday = _let(fourth, lambda d: F.date_sub(d, F.weekday(d)))
        week = F.struct(monday.alias("monday"), _group(t, _WEEK, 3).alias("number"), F.coalesce(_group(t, _WEEK, 4), F.lit(1)).alias("day"))
        return F.coalesce(plain, F.when(t.rlike(_WEEK), _let(week, of_week)))

    return _let(text, read)


def _date_length(text: Column) -> Column:
    """Characters of the date with which a moment begins."""
    digits = lambda n: F.when(n < 9, n).when(n % 2 == 0, 7).otherwise(8)
    short_week = _let(F.length(F.regexp_extract(text, r"\A.{7}(\d*)", 1)) + 7, digits)
    long_week = F.when(F.substring(text, 9, 1) != "-", 8).when(F.substring(text, 11, 1).rlike(r"\d"), 8).otherwise(10)
    hyphen = F.when(F.substring(text, 6, 1) == "W", long_week).otherwise(10)
    return F.when(F.length(text) == 7, 7).when(F.substring(text, 5, 1) == "-", hyphen).when(F.substring(text, 5, 1) == "W", short_week).otherwise(8)


_LONG = r"(\d{2})(?::(\d{2})(?::(\d{2}))?)?(?:[.,](\d+))?"
_SHORT = r"(\d{2})(?:(\d{2})(?:(\d{2}))?)?(?:[.,](\d+))?"


def _clock(text: Column) -> Column:
    """Microseconds of hours, minutes, seconds and a fraction, of which six digits count; null where text has another form."""

    def micros(p: Column) -> Column:
        fits = (p["h"] < 24) & (p["m"] < 60) & (p["s"] < 60)
        return F.when(fits, ((p["h"] * 60 + p["m"]) * 60 + p["s"]).cast("long") * _MICROS + p["f"])

    def read(t: Column) -> Column:
        out = []
        for form in (_LONG, _SHORT):
            whole = rf"\A{form}\z"
            parts = [F.coalesce(_group(t, whole, k), F.lit(0)).alias(n) for k, n in ((1, "h"), (2, "m"), (3, "s"))]
            fraction = F.rpad(F.substring(F.regexp_extract(t, whole, 4), 1, 6), 6, "0").cast("int")
            out.append(F.when(t.rlike(whole), _let(F.struct(*parts, fraction.alias("f")), micros)))
        return F.coalesce(*out)

    return _let(text, read)


_PARTED = r"\A([^+Z-]*)(?:(Z)|([+-])(.+))?\z"


def _instant(text: Column, length: Column) -> Column:
    """The timestamp of a date of so many characters, one character of any kind, and a time; null if they do not fit."""

    def read(p: Column) -> Column:
        clock = F.when(p["bare"], F.lit(0).cast("long")).otherwise(_clock(F.regexp_extract(p["tail"], _PARTED, 1)))
        sign = F.regexp_extract(p["tail"], _PARTED, 3)
        offset = F.when(sign == "", F.lit(0).cast("long")).otherwise(_clock(F.regexp_extract(p["tail"], _PARTED, 4)))
        signed = F.when(sign == "-", F.lit(-1)).otherwise(F.lit(1)) * offset
        return F.when(p["tail"].rlike(_PARTED), F.timestamp_micros(F.unix_date(p["day"]).cast("long") * 86_400 * _MICROS + clock - signed))

    day = calendar_date(F.substring(text, F.lit(1), length))
    # one character of any kind can stand between the time and its offset
    tail = F.regexp_replace(F.substring(text, length + 2, F.length(text)), r"\A(\d{2}(?:(?::\d{2}){0,2}|(?:\d{2}){0,2}))[^+Z-](?=[+Z-])", "$1")
    return _let(F.struct(day.alias("day"), tail.alias("tail"), (F.length(text) <= length).alias("bare")), read)


def iso_moment(text: Column) -> Column:
    """struct(day, at): a date for a text that is one (with Z or not), a timestamp for a date and a time; both null for no moment.

    Without an offset the time is UTC. A text of which only the first ten
    characters make a date is that date.
    """

    def read(p: Column) -> Column:
        t = p["text"]
        at = F.when(~p["alone"], _let(F.regexp_replace(t, r"Z\z", "+00:00"), lambda z: _let(_date_length(z), lambda n: _instant(z, n))))
        ten = F.substring(t, 1, 10)
        # of ten characters without hyphens eight are the date
        first = F.when((F.length(t) >= 10) & (F.substring(t, 5, 1) != "-"), F.substring(t, 1, 8)).otherwise(ten)
        short = F.length(first).isin(7, 8, 10) & ten.rlike(r"\A\p{ASCII}*\z")
        return _let(F.struct(F.when(short, calendar_date(first)).alias("day"), at.alias("at")), lambda f: F.struct(F.when(f["at"].isNull(), f["day"]).alias("day"), f["at"].alias("at")))

    def alone(t: Column) -> Column:
        dated = (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-") & (F.length(t) >= 10)
        return dated & F.upper(F.substring(t, F.lit(11), F.length(t))).isin("", "Z")

    return _let(text, lambda t: _let(F.struct(t.alias("text"), alone(t).alias("alone")), read))


def legacy_claim(text: Column) -> Column:
    """struct(value, precision) of a claimed horizon of the first two versions, which is a text; null for one that is no moment. (M9)"""

    def told(m: Column) -> Column:
        value = F.coalesce(F.date_format(m["day"], "yyyy-MM-dd"), F.when(m["at"].isNotNull(), format_instant(m["at"])))
        return F.when(m["day"].isNotNull() | m["at"].isNotNull(), F.struct(value.alias("value"), F.when(m["day"].isNotNull(), "day").otherwise("instant").alias("precision")))

    return _let(iso_moment(strip(text)), told)
