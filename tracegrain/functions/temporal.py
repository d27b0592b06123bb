"""Date and time as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FIRST = "dd.MM.yyyy HH:mm:ss"


def parse_datetime(date: Column, time: Column, pattern: str = DAY_FIRST) -> Column:
    """Timestamp without zone of a date and a time string; an error if it does not parse."""
    return F.to_timestamp_ntz(F.concat_ws(" ", date, time), F.lit(pattern))


def try_parse_datetime(date: Column, time: Column, pattern: str = DAY_FIRST) -> Column:
    """Like :func:`parse_datetime`, but null where it does not parse."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(pattern)).cast("timestamp_ntz")


def epoch_s(at: Column) -> Column:
    return F.unix_timestamp(at)


def time_bin(at: Column, minutes: int = 60) -> Column:
    """Number of the bin of ``minutes`` length within the day."""
    return F.floor((F.hour(at) * 60 + F.minute(at)) / minutes).cast("int")


def seconds_of_day(at: Column) -> Column:
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
