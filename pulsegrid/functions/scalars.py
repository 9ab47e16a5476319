"""Expressions for identifiers, lists, numbers and times as they arrive in raw exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(c: Column) -> Column:
    """Number, or null for anything else; NaN is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def to_int(c: Column) -> Column:
    """Whole part of a number given as text or number, or null."""
    x = to_float(c)
    return F.when(F.abs(x) < 9.0e18, x.cast("long"))


def parse_strings(c: Column) -> Column:
    """Items of a JSON list, a ``{a,"b"}`` array, or a list split by commas: trimmed, non-empty. Null gives
    an empty list."""
    text = F.trim(F.coalesce(c, F.lit("")))
    json = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    plain = F.split(F.regexp_replace(F.regexp_replace(text, r"^[\[{]|[\]}]$", ""), '["\']', ""), ",")
    return F.filter(F.transform(F.coalesce(json, plain), lambda x: F.trim(x)), lambda x: x != "")


def parse_ints(c: Column) -> Column:
    return F.filter(F.transform(parse_strings(c), to_int), lambda x: x.isNotNull())


def parse_floats(c: Column) -> Column:
    return F.filter(F.transform(parse_strings(c), to_float), lambda x: x.isNotNull())


def align(values: Column, to: Column) -> Column:
    """``values`` cut or filled with nulls to the length of ``to``."""
    n = F.size(to)
    return F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("double"), n)), F.lit(1), n)


def rack_id(host: Column) -> Column:
    """Rack number in ``name-<rack>-<slot>``, or null."""
    return F.regexp_extract(host, r"^[A-Za-z]+-(\d+)-\d+", 1).try_cast("int")


def decode_bytes(c: Column) -> Column:
    """Text of a ``{104,105}`` byte array; anything that is not one, or is not printable UTF-8, unchanged."""
    inner = F.regexp_extract(c, r"^\{([0-9, ]+)\}$", 1)
    codes = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("int"))
    fits = F.forall(codes, lambda x: F.coalesce((x >= 0) & (x <= 255), F.lit(False)))
    digits = F.transform(codes, lambda x: F.lpad(F.hex(F.greatest(F.least(F.coalesce(x, F.lit(0)), F.lit(255)), F.lit(0))), 2, "0"))
    text = F.try_validate_utf8(F.unhex(F.array_join(digits, "")).cast("string"))
    good = (inner != "") & fits & text.isNotNull() & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
    return F.when(good, text).otherwise(c)


def minute_of_epoch(c: Column) -> Column:
    """Minute of an epoch number whose unit its size tells: 1e17 and up nanoseconds, 1e14 micro, 1e11 milli, else seconds."""
    n = to_int(c)
    seconds = F.when(n >= 10**17, F.floor(n / 10**9)).when(n >= 10**14, F.floor(n / 10**6)).when(n >= 10**11, F.floor(n / 10**3)).otherwise(n)
    return F.date_trunc("minute", F.timestamp_seconds(seconds.cast("long"))).cast("timestamp_ntz")


#: Keywords of each incident category; the first category with a match counts. Fixed values.
CATEGORIES = [
    ("thermal", "therm|temp|cool|fan|overheat"),
    ("power", "power|psu|pdu|outage|voltage"),
    ("hardware", "hard|disk|dimm|memory|cpu|gpu|node"),
    ("software", "soft|kernel|driver|os|job"),
    ("network", "net|link|switch|infiniband"),
]


def category(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda rest, x: F.when(low.rlike(x[1]), x[0]).otherwise(rest), CATEGORIES[::-1], F.lit("unknown"))


def severity(c: Column) -> Column:
    """1 to 3 from a number (clamped) or a label; 2 otherwise."""
    n, low = to_int(c), F.lower(F.trim(F.coalesce(c, F.lit(""))))
    label = F.when(low.isin("low", "minor", "info"), 1).when(low.isin("high", "critical", "major"), 3).otherwise(2)
    return F.coalesce(F.greatest(F.least(n, F.lit(3)), F.lit(1)), label).cast("int")


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def duration_text(minutes: Column) -> Column:
    """Minutes under two hours, hours under two days, else days."""
    return F.when(minutes < 120, F.format_string("%d min", F.round(minutes).cast("long"))).when(minutes < 2880, F.format_string("%.1f h", minutes / 60)).otherwise(F.format_string("%.1f days", minutes / 1440))
