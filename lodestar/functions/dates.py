"""Dates: tolerant parsing, whole-number days, local days and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Zone of local days, as the published figures use it.
LOCAL_ZONE = "America/Lima"


def utc_timestamp(text: Column) -> Column:
    """ISO text as a timestamp; what cannot be read is null."""
    return F.try_to_timestamp(text.cast("string"))


def day_number(at: Column) -> Column:
    """``YYYYMMDD`` as a whole number; null stays null."""
    return F.date_format(at, "yyyyMMdd").cast("int")


def local_date(at: Column, zone: str = LOCAL_ZONE) -> Column:
    """The local day of a UTC time without zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz")))


def local_time(at: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local time of day as ``HH:mm``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz")), "HH:mm")


def is_iso_day(text: Column) -> Column:
    """A real day written ``YYYY-MM-DD``."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def in_band(time: Column, start: Column, end: Column) -> Column:
    """``[start, end)`` on times of day; ``24:00`` is the end of the day."""
    return (time >= start) & ((end == "24:00") | (time < end))
