"""URL columns: the hashed form, hosts and buckets, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters up to the blank are trimmed, as the JVM's String.trim does.
_EDGES = "".join(map(chr, range(33)))


def trimmed(url: Column) -> Column:
    return F.trim(url, F.lit(_EDGES))


def is_blank(url: Column) -> Column:
    """True for null and for text of blanks only."""
    return F.coalesce(trimmed(url) == "", F.lit(True))


def normal_form(url: Column) -> Column:
    """The form under which a URL is hashed: trimmed, lower case, one trailing slash off (not of ``http(s)://host/``), a scheme in front. Null for blank.

    Each step refers to the one before once, so nothing is worked out twice.
    """
    low = F.lower(F.nullif(trimmed(url), F.lit("")))
    short = F.regexp_replace(low, r"^(https?://[^/]+/)$|(?<=[\s\S])/$", "$1")
    return F.regexp_replace(short, r"^(?!https?://)", "http://")


def url_id(url: Column) -> Column:
    """SHA-256 of the normal form in hex; null for blank URLs."""
    return F.sha2(normal_form(url), 256)


def host(url: Column) -> Column:
    """Host of an absolute URL, case as given; null if there is none. Blanks in the path don't hide the host."""
    found = F.regexp_extract(trimmed(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", found)


def site(url: Column) -> Column:
    """The host in lower case."""
    return F.lower(host(url))


def scheme(url: Column) -> Column:
    found = F.regexp_extract(trimmed(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.when(found != "", F.lower(found))


def path(url: Column) -> Column:
    """Path of an absolute URL, '' if there is none; null without a host."""
    return F.when(host(url).isNotNull(), F.regexp_extract(trimmed(url), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))


def query(url: Column) -> Column:
    """Text between ``?`` and ``#``; null without a ``?``."""
    return F.when(trimmed(url).rlike(r"^[^?#]*\?"), F.regexp_extract(trimmed(url), r"^[^?#]*\?([^#]*)", 1))


def link_form(url: Column) -> Column:
    """A link without one trailing slash, that of the root too."""
    return F.regexp_replace(url, "/$", "")


def string_hash(text: Column) -> Column:
    """The JVM's 32-bit ``String.hashCode`` for text of the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    whole = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFFFFFF))
    return F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole)


def bucket(text: Column, n: int) -> Column:
    """``abs(hash % n)`` with the remainder's sign of the JVM."""
    return F.abs(string_hash(text) % n).cast("int")
