"""Day-first time parsing and the cyclic and weekend features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.presets import TIME_FORMATS


def parse_time(text: Column, *, formats=TIME_FORMATS, strict: bool = False) -> Column:
    """Text to ``timestamp_ntz``, trying the formats in order.

    Each format is guarded by its shape, so rows in another format cost a regex test
    instead of a parser exception. Text is read as UTC and turned into a zone-free value,
    which keeps the result independent of the session time zone (no daylight gaps).
    Unparsable text gives null, or fails the job when ``strict``.
    """
    attempts = [
        F.when(
            text.rlike(shape),
            F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(f"{pattern} XXX")),
        )
        for shape, pattern in formats
    ]
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    parsed = F.timestamp_add("MICROSECOND", F.unix_micros(F.coalesce(*attempts)), epoch)
    if strict:
        failure = F.raise_error(F.concat(F.lit("unparsable time: "), text)).cast("timestamp_ntz")
        parsed = F.when(text.isNotNull() & parsed.isNull(), failure).otherwise(parsed)
    return parsed


def cyclic(part: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a clock part on a circle of ``period`` steps."""
    angle = part * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def clock_parts(ts: Column) -> tuple[Column, Column]:
    """Minute and hour."""
    return F.minute(ts), F.hour(ts)


def cyclic_time(ts: Column, prefix: str = "hr") -> list[Column]:
    minute, hour = clock_parts(ts)
    sin_m, cos_m = cyclic(minute, 60)
    sin_h, cos_h = cyclic(hour, 24)
    return [
        sin_m.alias(f"{prefix}_sin_minutes"),
        cos_m.alias(f"{prefix}_cos_minutes"),
        sin_h.alias(f"{prefix}_sin_hours"),
        cos_h.alias(f"{prefix}_cos_hours"),
    ]


def weekend_flag(ts: Column) -> Column:
    """1 on Saturday and Sunday, 0 otherwise and for a missing time."""
    return F.coalesce(F.weekday(ts) > 4, F.lit(False)).cast("int")
