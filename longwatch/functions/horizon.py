"""Exact ranges of fixed-width time counters as column expressions.

Bounds of up to 128 bits come from a table of 128 rows that is made by rule and
broadcast. Instants are exact: a bound times the microseconds of a tick, as a
ratio of integers, cut toward zero; an instant outside years 1 to 9999 is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_WIDTH = 128
FIRST_MICROS, LAST_MICROS = -62135596800000000, 253402300799999999

# Civil UTC midnights of named epochs.
EPOCHS = {
    "unix": "1970-01-01", "ntp": "1900-01-01", "gps": "1980-01-06", "mjd": "1858-11-17",
    "ntfs": "1601-01-01", "uuid": "1582-10-15", "tai_1958": "1958-01-01",
}
# Other spellings of epoch kinds.
EPOCH_ALIASES = {
    "unix": ("unix", "posix", "unix_epoch"), "ntp": ("ntp", "ntp_epoch"), "gps": ("gps", "gps_epoch"),
    "mjd": ("mjd", "modified_julian", "modified_julian_date", "modified_julian_day"), "ntfs": ("ntfs", "windows"),
    "uuid": ("uuid", "gregorian_uuid"), "tai_1958": ("tai_1958", "tai1958"), "other": ("other",),
}
# Spellings of units, with microseconds of one as (numerator, denominator).
UNITS = {
    ("seconds", "second", "s"): (1_000_000, 1),
    ("milliseconds", "millisecond", "ms"): (1_000, 1),
    ("microseconds", "microsecond", "us", "µs"): (1, 1),
    ("nanoseconds", "nanosecond", "ns"): (1, 1_000),
    ("days", "day", "d"): (86_400_000_000, 1),
    ("weeks", "week", "w"): (604_800_000_000, 1),
}
TICKS = ("ticks", "tick", "fixed_rate", "fixed-rate")
# Rollover dates of well-known counters.
ROLLOVERS = {"y2036": "2036-02-07", "y2038": "2038-01-19", "y2106": "2106-02-07"}
SIGNED32_MAX = 2_147_483_647


def bounds_table(spark: SparkSession) -> DataFrame:
    """(width, smin, smax, send, umin, umax, uend): bounds by width as decimal text, end the first value above. (M1)"""
    rows = [(w, str(-(1 << w - 1)), str((1 << w - 1) - 1), str(1 << w - 1), "0", str((1 << w) - 1), str(1 << w)) for w in range(1, MAX_WIDTH + 1)]
    return spark.createDataFrame(rows, "width int, smin string, smax string, send string, umin string, umax string, uend string")


def parse_epoch_kind(value: Column) -> Column:
    """(M15)"""
    key = F.translate(F.lower(F.trim(value)), " -", "__")
    out = None
    for kind, names in EPOCH_ALIASES.items():
        out = F.when(key.isin(*names), kind) if out is None else out.when(key.isin(*names), kind)
    return out


def epoch_table(spark: SparkSession) -> DataFrame:
    """(kind, anchor)."""
    return spark.createDataFrame(list(EPOCHS.items()), "kind string, day string").select("kind", F.to_timestamp("day").alias("anchor"))


def unit_table(spark: SparkSession) -> DataFrame:
    """(spelling, num, den): microseconds of a unit as a ratio."""
    rows = [(name, *map(str, ratio)) for names, ratio in UNITS.items() for name in names]
    made = spark.createDataFrame(rows, "spelling string, num string, den string")
    return made.select("spelling", *[F.col(k).cast("decimal(38,0)").alias(k) for k in ("num", "den")])


def with_ticks(rows: DataFrame) -> DataFrame:
    """Adds _epoch, _num and _den to counters: the anchor or explicit epoch, and microseconds of a tick.

    A rate of ticks a second counts to a millionth.
    """
    c, spark = F.col, rows.sparkSession
    units, epochs = F.broadcast(unit_table(spark)), F.broadcast(epoch_table(spark))  # 19 and 7 rows
    rows = rows.join(units, F.lower(F.trim(c("unit"))) == c("spelling"), "left").join(epochs, c("epoch_kind") == c("kind"), "left")
    ticks = F.lower(F.trim(c("unit"))).isin(*TICKS) & (c("ticks_per_second") > 0)
    scaled = F.round(c("ticks_per_second").cast("string").cast("decimal(38,6)") * 1_000_000, 0).cast("decimal(38,0)")
    num = F.when(ticks, F.lit(10**12).cast("decimal(38,0)")).otherwise(c("num"))
    return rows.withColumns({"_epoch": F.coalesce("anchor", "epoch"), "_num": num, "_den": F.when(ticks, scaled).otherwise(c("den"))}).drop("spelling", "num", "den", "kind", "anchor")


def instant(epoch: Column, value: Column, num: Column, den: Column) -> Column:
    """The epoch and so many ticks (decimal text), or null outside years 1 to 9999. (M3)"""
    rough = value.cast("double") * num.cast("double") / den.cast("double")
    near = F.abs(rough) < 4e17
    whole = F.when(near, (value.try_cast("decimal(38,0)") * num).cast("decimal(38,0)"))
    at = F.unix_micros(epoch) + F.when(near, _div(whole, den))
    return F.when(near & at.between(FIRST_MICROS, LAST_MICROS), F.timestamp_micros(at))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient, cut toward zero."""
    rest = a % b
    return ((a - rest) / b).cast("decimal(38,0)").cast("long")


def claim_valid(value: Column, precision: Column) -> Column:
    """Whether a claim has just the form that its precision asks for. (M8)"""
    year = value.rlike(r"\A\d{4}\z") & (value != "0000")
    month = value.rlike(r"\A\d{4}-(0[1-9]|1[0-2])\z") & ~value.startswith("0000")
    day = value.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & ~value.startswith("0000") & value.try_cast("date").isNotNull()
    moment = value.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})\z") & claim_instant(value).isNotNull()
    return F.when(precision == "year", year).when(precision == "month", month).when(precision == "day", day).when(precision == "instant", moment).otherwise(F.lit(False))


def claim_instant(value: Column) -> Column:
    """The instant of an ISO text with an offset, or null."""
    full = F.regexp_replace(F.regexp_replace(value, ",", "."), r"([T ]\d{2})(Z|[+-])", "$1:00$2")
    # a cast wants seconds
    return F.regexp_replace(full, r"([T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2").try_cast("timestamp")


def claim_matches(value: Column, precision: Column, last: Column, end: Column) -> Column:
    """Whether a day or instant is that of a boundary. (M7)"""
    day = value.try_cast("date")
    is_day = F.coalesce(F.to_date(last) == day, F.lit(False)) | F.coalesce(F.to_date(end) == day, F.lit(False))
    at = claim_instant(value)
    is_at = F.coalesce(last == at, F.lit(False)) | F.coalesce(end == at, F.lit(False))
    return F.when(precision == "day", is_day).otherwise(is_at)


def _instants(bounds: list[str]) -> Column:
    """The instants of the lowest and highest values and of the first above."""
    c = F.col
    known = c("_num").isNotNull() & c("_den").isNotNull() & c("_epoch").isNotNull()
    return F.transform(F.array(*bounds), lambda v: F.when(known, instant(c("_epoch"), v, c("_num"), c("_den"))))


def _branch(low: Column, high: Column, at: Column) -> Column:
    """Status, bounds and instants under one signedness. (M6)"""
    c = F.col
    num, first, last, out = c("_num"), at[0], at[1], at[2]
    known = num.isNotNull() & c("_den").isNotNull() & c("_epoch").isNotNull()
    claimed = c("claim_value").isNotNull()
    exact = claimed & c("claim_precision").isin("day", "instant")
    bad_width = (c("width_bits") < 1) | (c("width_bits") > MAX_WIDTH)
    ticks = F.lower(F.trim(c("unit"))).isin(*TICKS)
    matches = claim_matches(c("claim_value"), c("claim_precision"), last, out)
    compared = exact & (last.isNotNull() | out.isNotNull()) & ~bad_width
    status = (
        F.when(bad_width, "error")
        .when(c("_epoch").isNull() & c("unit").isNull(), F.when(claimed, "insufficient_parameters").otherwise("verified"))
        .when(c("_epoch").isNull(), "insufficient_parameters")
        .when(c("unit").isNull() | (F.trim(c("unit")) == ""), "insufficient_parameters")
        .when(ticks & ~F.coalesce(c("ticks_per_second") > 0, F.lit(False)), "insufficient_parameters")
        .when(num.isNull(), "unsupported")
        .when(first.isNull() & last.isNull() & out.isNull(), "verified")
        .when(~exact, "verified")
        .when(last.isNull() & out.isNull(), "insufficient_parameters")
        .when(matches, "verified").otherwise("contradicted")
    )
    return F.struct(
        status.alias("status"), low.alias("minimum_value"), high.alias("maximum_value"), first.alias("earliest"), last.alias("last"), out.alias("first_out_of_range"),
        F.when(known & compared, matches).alias("claim_consistent"),
    )


def validate(rows: DataFrame) -> DataFrame:
    """Adds horizon (the result that stands), signed_branch and unsigned_branch to counters. (M5)

    Input columns: width_bits, signed, epoch_kind, epoch, unit, ticks_per_second,
    claim_value, claim_precision. A null means that the document does not say.
    """
    c = F.col
    rows = with_ticks(rows)
    table = F.broadcast(bounds_table(rows.sparkSession))  # 128 rows
    rows = rows.join(table, rows.width_bits == table.width, "left")
    rows = rows.withColumns({"_sat": _instants(["smin", "smax", "send"]), "_uat": _instants(["umin", "umax", "uend"])})
    rows = rows.withColumns({"_s": _branch(c("smin"), c("smax"), c("_sat")), "_u": _branch(c("umin"), c("umax"), c("_uat"))})
    lost = (c("epoch_kind") == "other") & c("epoch").isNull()
    unsure = c("signed").isNull() & c("width_bits").isNotNull() & ~F.coalesce(lost, F.lit(False))
    exact = c("claim_precision").isin("day", "instant") & c("claim_value").isNotNull()
    any_match = F.coalesce(c("_s.claim_consistent"), F.lit(False)) | F.coalesce(c("_u.claim_consistent"), F.lit(False))
    either = F.when(exact & any_match, True).when(exact & (c("_s.last").isNotNull() | c("_u.last").isNotNull()), False)
    empty = lambda status, consistent=None: F.struct(
        status.alias("status"), *[F.lit(None).cast(k).alias(n) for n, k in (("minimum_value", "string"), ("maximum_value", "string"), ("earliest", "timestamp"), ("last", "timestamp"), ("first_out_of_range", "timestamp"))],
        (F.lit(None).cast("boolean") if consistent is None else consistent).alias("claim_consistent"),
    )
    result = (
        F.when(F.coalesce(lost, F.lit(False)) | c("width_bits").isNull(), empty(F.lit("insufficient_parameters")))
        .when(unsure, empty(F.lit("ambiguous_signedness"), either))
        .when(c("signed"), c("_s")).otherwise(c("_u"))
    )
    rows = rows.withColumn("horizon", result)
    for name, own in (("signed_branch", "_s"), ("unsigned_branch", "_u")):
        rows = rows.withColumn(name, F.when(unsure, c(own)))
    return rows.drop("_epoch", "_num", "_den", "_sat", "_uat", "_s", "_u", "width", "smin", "smax", "send", "umin", "umax", "uend")


def validation_status(status: Column) -> Column:
    """(M13)"""
    return F.when(status == "verified", "verified").when(status.isin("contradicted", "error"), "failed").otherwise("not_applicable")


def rollover_matches(label: Column, day: Column) -> Column:
    """Whether a date is the rollover that a label names."""
    out = None
    for name, known in ROLLOVERS.items():
        hit = day == F.lit(known).cast("date")
        out = F.when(label == name, hit) if out is None else out.when(label == name, hit)
    return out


def iso_dates(text: Column) -> Column:
    """The calendar dates that a text writes as YYYY-MM-DD, in order, repeats included."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1)
    return F.filter(F.transform(found, lambda d: d.try_cast("date")), lambda d: d.isNotNull())


def dated_status(text: Column, domains: Column) -> Column:
    """Status by dates near a rollover that a text or its domains name, or null if they decide nothing."""
    dates = iso_dates(text)
    out = None
    for label, known in ROLLOVERS.items():
        day = F.lit(known).cast("date")
        named = F.array_contains(domains, label) | F.contains(F.lower(text), F.lit(label))
        ranked = F.transform(dates, lambda d, i: F.struct(F.abs(F.date_diff(d, day)).alias("far"), i.alias("at"), d.alias("d")))  # noqa: B023
        best = F.array_min(ranked)
        hit = F.coalesce(named, F.lit(False)) & (best["far"] <= 366)
        value = F.when(best["d"] == day, "verified").otherwise("failed")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    known_days = [F.lit(d).cast("date") for d in ROLLOVERS.values()]
    once = F.size(F.filter(dates, lambda d: d.isin(*known_days))) == 1
    return out.when(once, "verified")


def duration(seconds: Column) -> Column:
    """Seconds as 1h 22m 10.5s: tenths, halves up."""
    tenths = F.floor(F.greatest(seconds, F.lit(0.0)) * 10 + 0.5).cast("long")
    hours, minutes = F.floor(tenths / 36000).cast("long"), F.floor(tenths % 36000 / 600).cast("long")
    rest = F.concat(F.floor(tenths % 600 / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    return F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "))).otherwise(""),
        F.when((hours > 0) | (minutes > 0), F.concat(minutes.cast("string"), F.lit("m "))).otherwise(""), rest,
    )


#: The last second of a signed counter of 32 bits.
LAST_SECOND = (1 << 31) - 1


def unix_seconds_claim(seconds: Column) -> Column:
    """Struct (verified, detail): whether seconds are the last of a signed 32-bit counter."""
    said = seconds.cast("string")
    right = F.concat(F.lit("Signed 32-bit max seconds "), said, F.lit(" is correct."))
    wrong = F.concat(F.lit("Claimed max seconds "), said, F.lit(f"; expected {LAST_SECOND}."))
    return F.struct((seconds == LAST_SECOND).alias("verified"), F.when(seconds == LAST_SECOND, right).otherwise(wrong).alias("detail"))


def format_instant(moment: Column) -> Column:
    """An instant as ISO text in UTC, fractions only where there are some; n/a for null.

    The session's time zone must be UTC.
    """
    fraction = F.when(F.unix_micros(moment) % 1_000_000 != 0, F.date_format(moment, ".SSSSSS")).otherwise("")
    return F.coalesce(F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z")), F.lit("n/a"))


def format_claim(value: Column, precision: Column, version: Column) -> Column:
    """A claimed horizon as it is shown: instants as such, else the value with its precision; n/a for null.

    Reports of the first two versions show no precision.
    """
    moment = claim_instant(value)
    exact = F.when(moment.isNotNull(), format_instant(moment)).otherwise(value)
    old = version.isin("0.1.0", "0.2.0")
    return F.when(value.isNull(), "n/a").when(old | (precision == "instant"), exact).otherwise(F.concat(value, F.lit(" ("), precision, F.lit(" precision)")))
