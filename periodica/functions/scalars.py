"""Column expressions for text, numbers, arrays and epoch conversions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: integers above this are epoch milliseconds, others are seconds.
EPOCH_MS_FLOOR = 16307632000


def prefix(c: Column, n: int = 10) -> Column:
    return F.substring(c, 1, n)


def normalise_label(c: Column) -> Column:
    """Spaces and dashes become underscores; lower case."""
    return F.lower(F.translate(c, " -", "__"))


def split_bracketed(c: Column, sep: str = ",", keep: bool = False) -> Column:
    """Array of the values in a bracketed list text. The separator holds no brackets.

    ``keep`` also puts the unsplit text first when there is more than one value.
    """
    values = F.split(F.translate(c, "[]", ""), re.escape(sep))
    if not keep:
        return values
    return F.when(F.size(values) > 1, F.concat(F.array(c), values)).otherwise(values)


def hex_to_int(c: Column) -> Column:
    """Hex text, with or without 0x, as a decimal(20,0), up to 2 ** 64 - 1.

    Missing text gives 0; text that is not hex, or stands for a larger number, gives null.
    """
    digits = F.regexp_replace(F.lower(F.trim(c)), "^0x", "")
    number = F.when(digits.rlike("^0*[0-9a-f]{1,16}$"), F.conv(digits, 16, 10).cast("decimal(20,0)"))
    return F.when(c.isNull(), F.lit(0).cast("decimal(20,0)")).otherwise(number)


def epoch_to_date(c: Column) -> Column:
    """Epoch seconds or milliseconds as a UTC calendar day."""
    seconds = F.when(c > EPOCH_MS_FLOOR, F.floor(c / 1000)).otherwise(c)
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def epoch_ns_to_date(c: Column) -> Column:
    return F.date_from_unix_date(F.floor(c / F.lit(86_400_000_000_000)).cast("int"))


def _utc_seconds(c: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp, without the session zone."""
    return (
        F.unix_date(F.to_date(c)).cast("long") * 86400
        + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    ).cast("long")


def to_epoch_seconds(c: Column) -> Column:
    return _utc_seconds(c)


def to_epoch_ms(c: Column) -> Column:
    micros = F.date_format(c, "SSSSSS").cast("long")
    return _utc_seconds(c) * 1000 + F.floor(micros / 1000)


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def parse_timestamp(c: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.to_timestamp_ntz(c, F.lit(fmt))


def drop_minutes(c: Column) -> Column:
    """Cut a timestamp to its hour."""
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def relative_day(c: Column, days: int) -> Column:
    return F.date_format(F.date_add(F.to_date(c), days), "yyyy-MM-dd")


def compose_key(parts: list[Column], start: Column, end: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts], day_text(start), day_text(end))


def first_scaled(c: Column, factor: float = 10) -> Column:
    """First array element times a factor; empty arrays give null."""
    return F.try_element_at(c, F.lit(1)) * factor


def finite_or_zero(c: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)
