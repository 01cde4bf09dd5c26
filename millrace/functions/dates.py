"""Date texts of articles in the formats that the parser of the crawler knows.

Day before month where both are possible; local times are those of ``zone``; today and yesterday are midnights; 31/02 is
no date. For the wider problem of all notations and site zones see operators/instants.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats, in the order in which they are tried.
WITH_ZONE = ("dd/MM/yyyy HH:mm XXX", "dd/MM/yyyy HH:mm zzz", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "MMM dd, yyyy HH:mm XXX", "dd MMM yyyy HH:mm XXX")
BESIDE_GMT = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm")
LOCAL_TIMES = (
    "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm",
    "MMM dd, yyyy HH:mm:ss", "MMM dd, yyyy HH:mm", "dd MMM yyyy HH:mm:ss", "dd MMM yyyy HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm",
)
LOCAL_DATES = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "MMM dd, yyyy", "dd MMM yyyy", "yyyy/MM/dd", "MM/dd/yyyy")


def _first_read(text: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_date(text: Column, as_of: Column, zone: str = "UTC") -> Column:
    """The instant of a date text; null for null, blank and unknown texts. Blanks around it don't matter."""
    t = F.trim(text)
    now = as_of.cast("timestamp")

    def utc(local: Column) -> Column:
        return F.to_utc_timestamp(local, zone)

    gmt = F.regexp_extract(t, r"GMT([+-]\d{1,2})", 1)
    hours = gmt.try_cast("int")
    bare = F.trim(F.regexp_replace(t, r"\s*GMT[+-]\d{1,2}\s*", ""))
    with_gmt = _first_read(bare, BESIDE_GMT)
    shifted = F.when((gmt != "") & (F.abs(hours) <= 18), F.timestamp_micros(F.unix_micros(with_gmt) - hours.cast("long") * 3_600_000_000))
    zoned, local, dates = (_first_read(t, f) for f in (WITH_ZONE, LOCAL_TIMES, LOCAL_DATES))
    today = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    low = F.lower(t)
    n = F.regexp_extract(low, r"(\d{1,9})\s+(?:day|hour|minute)s?\s+ago", 1).try_cast("long")
    unit = F.regexp_extract(low, r"\d{1,9}\s+(day|hour|minute)s?\s+ago", 1)
    seconds = reduce(lambda c, u: c.when(unit == u[0], u[1]), (("day", 86_400), ("hour", 3600), ("minute", 60)), F.when(F.lit(False), 0))
    relative = F.when(F.contains(low, F.lit("today")), utc(today)).when(F.contains(low, F.lit("yesterday")), utc(today - F.expr("interval 1 day"))).otherwise(F.timestamp_micros(F.unix_micros(now) - n * seconds * 1_000_000))
    return F.coalesce(shifted, zoned, utc(local), utc(dates), relative)
