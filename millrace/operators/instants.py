"""Problem 4: one UTC instant for times written in many notations, precisions and zones.

A text is first brought to one canonical spelling (weekdays dropped, month names made numbers, brackets removed), then
read by four notations: date first, time first, a bare number, a distance from now. What it says about its zone decides
the offset: a numeric offset, an abbreviation of the site's own zone, or none. Times without a zone are local to the
site. The zone of a site comes from the locale table; for sites that it leaves out the offset history is estimated:
every history of the tz database is laid over the site's zone-less times and the one that fits their arrival times best is
taken.
Everything is a built-in expression, so parsing runs inside the scan's stage.

Defined results: null, blank, unreadable and non-existing dates give null; a zone name that is unknown everywhere gives
null; a site whose zone is neither given nor estimable counts as UTC; a local time that occurs twice is the earlier
instant and one that is skipped moves on by the skipped length.
"""

from __future__ import annotations

import zoneinfo
from collections import defaultdict
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators.joins import lookup_join
from millrace.session import cut

# First letters of the months' names, weekdays, words for distances from now.
MONTHS = {"jan": 1, "feb": 2, "fév": 2, "mar": 3, "apr": 4, "avr": 4, "may": 5, "mai": 5, "jun": 6, "juin": 6, "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "déc": 12}
WEEKDAYS = r"mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?|thứ (?:hai|ba|tư|năm|sáu|bảy)|chủ nhật|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche"
UNITS = {"second": "seconds?|secs?|giây|secondes?", "minute": "minutes?|mins?|phút", "hour": "hours?|hrs?|giờ|tiếng|heures?", "day": "days?|ngày|jours?", "week": "weeks?|tuần|semaines?"}
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}

_TIME = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?(am|pm))?"
_ZONE = r"(?: ?(z|[a-z]{2,5}|(?:gmt|utc)? ?[+-]\d{1,2}(?::?\d{2})?))?"
_YMD = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
_XXY = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
_NAMED = r"(\d{1,2}) m(\d{1,2}) (\d{4})"
_NAMED_US = r"m(\d{1,2}) (\d{1,2}) (\d{4})"
#: The parts of a time in the order in which they are kept; a and b are a day and a month whose order isn't known.
_PARTS = ("y", "a", "b", "mo", "d", "h", "mi", "s", "f", "ap", "z")
#: Microseconds of the wall clock __local read as if it were UTC.
_LOCAL_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', __local)"
#: Milliseconds rather than seconds from this size on.
_MILLIS_FROM = 100_000_000_000


@lru_cache(1)
def zone_abbreviations() -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation in lower case, offset in seconds) of every zone of the tz database in this century, from its own rules."""
    found: dict[tuple[str, str], int] = {}
    days = [datetime(y, m, 1, tzinfo=timezone.utc) for y in range(2000, 2038) for m in (1, 4, 7, 10)]
    for name in sorted(zoneinfo.available_timezones()):
        zone = zoneinfo.ZoneInfo(name)
        for day in days:
            local = day.astimezone(zone)
            short = (local.tzname() or "").lower()
            if short.isalpha():
                found[name, short] = int((local.utcoffset() or timedelta()).total_seconds())
    # The tz database writes +07 where people write ICT.
    for name in ("Asia/Ho_Chi_Minh", "Asia/Saigon", "Asia/Bangkok", "Asia/Vientiane", "Asia/Phnom_Penh"):
        if name in zoneinfo.available_timezones():
            found[name, "ict"] = 7 * 3600
    return tuple((z, a, o) for (z, a), o in sorted(found.items()))


@lru_cache(1)
def unique_abbreviations() -> dict[str, int]:
    """Abbreviations that mean one offset wherever they are used."""
    offsets = defaultdict(set)
    for _, short, offset in zone_abbreviations():
        offsets[short].add(offset)
    return {a: next(iter(o)) for a, o in offsets.items() if len(o) == 1} | {"z": 0, "utc": 0, "gmt": 0}


def with_canonical(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__t``: lower case, single blanks, no weekday, brackets or commas, month names as m1 to m12."""
    t = F.lower(F.trim(F.regexp_replace(F.col(text), r"[\s\u00a0\u2000-\u200a\u202f\u3000]+", " ")))
    t = F.regexp_replace(t, rf"^(?:{WEEKDAYS})\b[,.]? ?", "")
    t = F.regexp_replace(t, r"[(),]| ngày(?= \d)| (?:at|lúc|à)(?= \d)", " ")
    t = F.regexp_replace(t, r"(^| )tháng (\d{1,2})\b", "$1m$2")
    name = rf"\b({'|'.join(sorted(MONTHS, key=len, reverse=True))})[a-zà-ÿ]*\.?"
    df = df.withColumn("__t", F.trim(F.regexp_replace(t, " +", " "))).withColumn("__name", F.regexp_extract("__t", name, 1))
    numbers = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    marked = F.when(F.col("__name") != "", F.regexp_replace(F.col("__t"), F.lit(name), F.concat(F.lit("m"), F.element_at(numbers, F.col("__name")).cast("string"))))
    return df.withColumn("__t", F.coalesce(marked, "__t")).drop("__name")


def _notations() -> list[tuple[str, str]]:
    """(pattern, replacement): each pattern takes a whole text and writes its _PARTS with ';' between."""
    clock = ("h", "mi", "s", "f", "ap")
    found = []
    for date, names in ((_YMD, ("y", "mo", "d")), (_XXY, ("a", "b", "y")), (_NAMED, ("d", "mo", "y")), (_NAMED_US, ("mo", "d", "y"))):
        for pattern, order in ((rf"{date}(?:(?:t| t?){_TIME})?{_ZONE}", (*names, *clock, "z")), (rf"{_TIME} {date}{_ZONE}", (*clock, *names, "z"))):
            found.append((f"^{pattern}$", ";".join(f"${order.index(n) + 1}" if n in order else "" for n in _PARTS)))
    return found


def read_times(df: DataFrame, text: str, received: str) -> DataFrame:
    """Adds what ``text`` says: ``__fixed_us`` (an instant in microseconds, for numbers and distances), ``__y __mo __d`` and ``__a __b`` (date), ``__clock_us`` (time of day) and ``__zone`` (text of the zone, '' for none)."""
    df, columns = with_canonical(df, text), df.columns
    t = F.col("__t")
    number = F.when(t.rlike(r"^-?\d{1,15}$") & ~t.rlike(r"^\d{8}$"), t.try_cast("long"))
    number_us = F.when(F.abs(number) >= _MILLIS_FROM, number * 1000).otherwise(number * 1_000_000)
    distance = r"^(?:il y a )?(\d{1,6}) ([^ ]+)(?: ago| trước)?$"
    unit = F.regexp_extract("__t", distance, 2)
    seconds = reduce(lambda a, u: a.when(unit.rlike(f"^(?:{UNITS[u]})$"), UNIT_SECONDS[u]), UNITS, F.when(F.lit(False), 0))
    away = F.when(t.rlike(r"^il y a \d{1,6} [^ ]+$|^\d{1,6} [^ ]+ (?:ago|trước)$"), F.regexp_extract("__t", distance, 1).try_cast("long") * seconds)
    word = F.when(t.isin("now", "just now", "today", "vừa xong", "hôm nay", "aujourd'hui"), 0).when(t.isin("yesterday", "hôm qua", "hier"), 86_400)
    ago = F.coalesce(away, word) * 1_000_000
    written = reduce(lambda c, n: F.regexp_replace(c, n[0], n[1]), _notations(), t)
    p = df.withColumn("__fixed_us", F.coalesce(number_us, F.unix_micros(F.col(received)) - ago)).withColumn("__p", F.split(written, ";"))
    whole = F.size("__p") == len(_PARTS)
    p = p.select("*", *[F.when(whole, F.get("__p", F.lit(k))).alias(f"__p_{n}") for k, n in enumerate(_PARTS)])
    h, mi, s = (F.col(f"__p_{n}").try_cast("int") for n in ("h", "mi", "s"))
    ap = F.col("__p_ap")
    hour = F.when(ap == "", h).when(~h.between(1, 12), None).when(ap == "am", h % 12).otherwise(h % 12 + 12)
    micro = F.when(F.col("__p_f") == "", 0).otherwise(F.rpad("__p_f", 6, "0").try_cast("long"))
    second = F.coalesce(s, F.lit(0))
    clock = F.when(hour.between(0, 23) & mi.between(0, 59) & second.between(0, 59), ((hour * 60 + mi) * 60 + second).cast("long") * 1_000_000 + micro)
    return p.select(
        *columns,
        "__fixed_us",
        *[F.col(f"__p_{n}").try_cast("int").alias(f"__{n}") for n in ("y", "a", "b", "mo", "d")],
        F.when(F.col("__p_h") == "", 0).otherwise(clock).cast("long").alias("__clock_us"),
        F.regexp_replace("__p_z", " ", "").alias("__zone"),
    )


def with_local_time(df: DataFrame, date_order: Column) -> DataFrame:
    """Adds ``__local`` (timestamp_ntz) from the parts; all-numeric dates with the year last follow ``date_order`` (dmy unless it is mdy)."""
    mdy = F.coalesce(date_order == "mdy", F.lit(False))
    df = df.withColumn("__m2", F.coalesce("__mo", F.when(mdy, F.col("__a")).otherwise(F.col("__b"))))
    df = df.withColumn("__d2", F.coalesce("__d", F.when(mdy, F.col("__b")).otherwise(F.col("__a"))))
    df = df.withColumn("__midnight", F.expr("try_make_timestamp_ntz(__y, __m2, __d2, 0, 0, 0)"))
    return df.withColumn("__local", F.expr("timestampadd(MICROSECOND, __clock_us, __midnight)")).drop("__m2", "__d2", "__midnight")


def _in_zone_us() -> Column:
    """Microseconds since 1970 UTC of the wall clock __local in the zone __in_zone: the earlier of two, moved on over a gap."""
    return F.expr(f"unix_micros(to_utc_timestamp(timestamp_micros({_LOCAL_US}), __in_zone))")


def numeric_offset(zone: Column) -> Column:
    """Seconds of '+7', '+0530', 'gmt-5', 'utc+5:30'; null for other texts and offsets beyond 18 hours."""
    pattern = r"^(?:gmt|utc)?([+-])(\d{1,2}):?(\d{2})?$"
    size = F.regexp_extract(zone, pattern, 2)
    seconds = size.cast("int") * 3600 + F.coalesce(F.when(F.regexp_extract(zone, pattern, 3) != "", F.regexp_extract(zone, pattern, 3).cast("int")), F.lit(0)) * 60
    signed = F.when(F.regexp_extract(zone, pattern, 1) == "-", -seconds).otherwise(seconds)
    return F.when(zone.rlike(pattern), F.when(seconds <= 18 * 3600, signed))


#: Years for which two zones must have the same offsets to count as one.
_YEARS = (2020, 2038)
_REGIONS = ("Africa/", "America/", "Antarctica/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/")


def _history(zone: zoneinfo.ZoneInfo) -> tuple[tuple[int, int], ...]:
    """(hour since 1970, offset in seconds) of each change of a zone's offset, the first offset in front."""

    def offset(hour: int) -> int:
        return int(datetime.fromtimestamp(hour * 3600, zone).utcoffset().total_seconds())

    step, end = 14 * 24, int(datetime(_YEARS[1], 1, 1, tzinfo=timezone.utc).timestamp()) // 3600
    at = int(datetime(_YEARS[0], 1, 1, tzinfo=timezone.utc).timestamp()) // 3600
    here = offset(at)
    found = [(0, here)]
    while at < end:
        ahead = offset(at + step)
        if ahead != here:
            low, high = at, at + step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == here else (low, middle)
            here = offset(high)
            found.append((high, here))
            at = high
        else:
            at += step
    return tuple(found)


@lru_cache(1)
def zone_classes() -> dict[str, str]:
    """Each zone of the tz database with the first, by name, of those that have had the same offsets since 2020 and will have; zones of regions come before others."""
    names = sorted(zoneinfo.available_timezones(), key=lambda n: (not n.startswith(_REGIONS), n))
    first: dict[tuple, str] = {}
    return {n: first.setdefault(_history(zoneinfo.ZoneInfo(n)), n) for n in names}


def candidates() -> list[str]:
    """One zone for each history of offsets in the tz database, and UTC by its name."""
    named = {c: "UTC" if c == zone_classes()["UTC"] else c for c in set(zone_classes().values())}
    return sorted(named.values())


def estimate_zones(times: DataFrame, zones: Sequence[str], tolerance_s: int = 60) -> DataFrame:
    """(site, estimated_zone, times_used, violations): the offset history that the arrival times contradict least.

    ``times`` has __site, __local and __received_us of zone-less times, ``zones`` is bounded by the tz database; each time
    is laid over all of them. A time later than its arrival is a violation and costs 1; otherwise it costs its delay in
    days, at most 1. Ties go to the zone first by name. Costs are summed by partial aggregation, so a site with most rows
    is no hot key.
    """
    usable = times.where("__local is not null and __site is not null and __received_us is not null")
    laid = usable.select("__site", "__local", "__received_us", F.explode(F.array(*map(F.lit, sorted(zones)))).alias("__in_zone"))
    delay = F.col("__received_us") - _in_zone_us()
    late = delay < -tolerance_s * 1_000_000
    cost = F.when(late, 1.0).otherwise(F.least(F.greatest(delay, F.lit(0)) / 86_400e6, F.lit(1.0)))
    scored = laid.select("__site", "__in_zone", late.cast("int").alias("late"), F.round(cost, 6).cast("decimal(20,6)").alias("cost")).groupBy("__site", "__in_zone").agg(F.sum("cost").alias("cost"), F.sum("late").alias("late"), F.count("*").alias("n"))
    best = scored.groupBy("__site").agg(F.min(F.struct("cost", F.col("__in_zone").alias("zone"), "late", "n")).alias("b"))
    return best.select(F.col("__site").alias("site"), F.col("b.zone").alias("estimated_zone"), F.col("b.n").alias("times_used"), F.col("b.late").alias("violations"))


def _known_zones(spark: SparkSession) -> DataFrame:
    """(time_zone, zone_class) of the tz database."""
    return spark.createDataFrame(sorted(zone_classes().items()), "time_zone string, zone_class string")


def site_zones(parsed: DataFrame, locales: DataFrame) -> DataFrame:
    """(site, zone, date_order): the zone of the locale table, and the estimated one for sites that it leaves out or gives an unknown zone."""
    spark = locales.sparkSession
    names = spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "time_zone string")
    known = locales.join(F.broadcast(names), "time_zone", "left_semi")
    given = known.groupBy(F.lower("domain").alias("site")).agg(F.min("time_zone").alias("given_zone"))
    order = locales.where("domain is not null").groupBy(F.lower("domain").alias("site")).agg(F.min("date_order").alias("date_order"))
    rest = cut(lookup_join(parsed.where("__zone = '' and __fixed_us is null and __site is not null").withColumn("site", F.col("__site")), given.select("site"), ["site"], "left_anti").drop("site"))
    settled = given.join(order, "site", "full")
    if rest.isEmpty():
        return settled.select("site", F.col("given_zone").alias("zone"), "date_order")
    # the order of numbers in a date is known, if at all, from the locale table too
    ordered = lookup_join(rest.withColumn("site", F.col("__site")), order, ["site"])
    estimated = estimate_zones(with_local_time(ordered, F.col("date_order")), candidates())
    return settled.join(estimated.select("site", "estimated_zone"), "site", "full").select("site", F.coalesce("given_zone", "estimated_zone").alias("zone"), "date_order")


def parse(contents: DataFrame) -> DataFrame:
    """Rows of ``contents`` (id, url, publish_at, received_at) with what publish_at says, see read_times; written once, a few numbers a row."""
    base = contents.select("id", urls.site(F.col("url")).alias("__site"), "publish_at", F.unix_micros("received_at").alias("__received_us"), "received_at")
    return cut(read_times(base, "publish_at", "received_at").drop("publish_at", "received_at"))


def publish_instants(contents: DataFrame, locales: DataFrame) -> DataFrame:
    """(id, publish_us): microseconds since 1970 UTC of each row's publish_at; null where it denotes no existing time."""
    spark = contents.sparkSession
    parsed = parse(contents)
    zones = site_zones(parsed, locales)
    rows = lookup_join(parsed.withColumn("site", F.col("__site")), zones, ["site"])
    rows = with_local_time(rows, F.col("date_order")).withColumn("__in_zone", F.coalesce("zone", F.lit("UTC")))
    short = spark.createDataFrame(list(zone_abbreviations()), "__in_zone string, __zone string, own_offset int")
    anywhere = spark.createDataFrame(sorted(unique_abbreviations().items()), "__zone string, any_offset int")
    # both tables are bounded by the tz database
    rows = rows.join(F.broadcast(short), ["__in_zone", "__zone"], "left").join(F.broadcast(anywhere), "__zone", "left")
    offset = F.coalesce(numeric_offset(F.col("__zone")), "own_offset", "any_offset").cast("long")
    stated = F.expr(_LOCAL_US) - offset * 1_000_000
    instant = F.coalesce("__fixed_us", F.when(F.col("__zone") == "", _in_zone_us()).otherwise(stated))
    return rows.select("id", instant.alias("publish_us"))


def zone_report(contents: DataFrame, locales: DataFrame) -> DataFrame:
    """(site, given_zone, estimated_zone, same, times_used, violations): for every site with zone-less times, how the zone that arrival times suggest compares with the given one; ``same``: both have the same offsets."""
    order = locales.where("domain is not null").groupBy(F.lower("domain").alias("site")).agg(F.min("date_order").alias("date_order"), F.min("time_zone").alias("given_zone"))
    loose = lookup_join(parse(contents).where("__zone = '' and __fixed_us is null").withColumn("site", F.col("__site")), order.select("site", "date_order"), ["site"])
    estimated = estimate_zones(with_local_time(loose, F.col("date_order")), candidates())
    # both tables are bounded by the tz database
    classes = F.broadcast(_known_zones(locales.sparkSession))
    both = estimated.join(order, "site", "left").join(classes.withColumnsRenamed({"time_zone": "given_zone", "zone_class": "given_class"}), "given_zone", "left").join(classes.withColumnsRenamed({"time_zone": "estimated_zone", "zone_class": "estimated_class"}), "estimated_zone", "left")
    return both.select("site", "given_zone", "estimated_zone", (F.col("given_class") == F.col("estimated_class")).alias("same"), "times_used", "violations")
