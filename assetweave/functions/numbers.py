"""Rounding, units and formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(x: Column, digits: int = 4) -> Column:
    """Half goes up, towards plus infinity, also below zero."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def round_up_of(x: float, digits: int = 4) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def decibels(x: Column) -> Column:
    """dBFS to one decimal; none for silence."""
    return F.when(x > 0, round_up(20 * F.log10(x), 1))


def decibels_of(x: float) -> float | None:
    return round_up_of(20 * math.log10(x), 1) if x > 0 else None


def average_kbps(n_bytes: Column, seconds: Column) -> Column:
    return F.floor(n_bytes * 8 / seconds / 1000 + 0.5).cast("int")


def aspect_of(width: int, height: int) -> tuple[float, str]:
    by = math.gcd(width, height)
    return round_up_of(width / height), f"{width // by}:{height // by}"


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def iso_time(epoch_ms: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, whatever the session's time zone."""
    shown = F.date_format(F.to_utc_timestamp(F.timestamp_millis(epoch_ms.cast("long")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.concat(shown, F.lit("Z"))


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def checked_int(text: str, low: int, high: int, name: str) -> int:
    from ..errors import AssetError

    try:
        value = int(text)
    except (TypeError, ValueError):
        value = low - 1
    if not low <= value <= high:
        raise AssetError("USAGE_ERROR", f"{name} must be an integer from {low} to {high}")
    return value
