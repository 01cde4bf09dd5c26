"""Resolving and canonicalising URLs: RFC 1808 parts, relative references, one canonical spelling. Vectorised over distinct values."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.urls import trimmed

_SCHEME = re.compile(r"[^\W\d_][\w.+-]*$")
# Session keys that a canonical query leaves out, default ports, schemes that open a connection.
SESSION_KEYS = frozenset({"jsessionid", "phpsessid", "aspsessionid"})
PORTS = {"http": 80, "https": 443, "ftp": 21}
OPENABLE = frozenset({"http", "https", "ftp", "file", "jar", "mailto"})

PARTS = ("scheme", "location", "path", "parameters", "query", "fragment")


def split(spec: str) -> dict[str, str | None]:
    """The six parts of RFC 1808; null for parts that aren't there."""
    p: dict[str, str | None] = dict.fromkeys(PARTS)
    rest, mark, fragment = spec.partition("#")
    if mark:
        p["fragment"] = fragment
    head, colon, tail = rest.partition(":")
    if colon and head and _SCHEME.match(head):
        p["scheme"], rest = head, tail
    net = rest.startswith("//")
    if net:
        rest = rest[2:]
        # a query or parameters may follow the location without a path
        end = rest.find("/")
        if end < 0:
            found = [k for k in (rest.find("?"), rest.find(";")) if k >= 0]
            end = min(found) if found else len(rest)
        p["location"], rest = rest[:end], rest[end:]
    rest, mark, query = rest.partition("?")
    if mark:
        p["query"] = query
    rest, mark, parameters = rest.partition(";")
    if mark:
        p["parameters"] = parameters
    if rest:
        p["path"] = rest
    return p


def join(p: dict[str, str | None]) -> str:
    out = ""
    if p["scheme"] is not None:
        out += p["scheme"] + ":"
    if p["location"] is not None:
        out += "//" + p["location"]
    if p["path"] is not None:
        out += p["path"]
    for mark, name in ((";", "parameters"), ("?", "query"), ("#", "fragment")):
        if p[name] is not None:
            out += mark + p[name]
    return out


def _authority(url: str) -> tuple[str, str] | None:
    """(scheme, host) of an absolute URL that can be opened; None otherwise."""
    p = split(url.strip())
    scheme = (p["scheme"] or "").lower()
    if scheme not in OPENABLE:
        return None
    location = (p["location"] or "").rpartition("@")[2]
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(-?\d*))?", location)
    return (scheme, m[1]) if m else None


def _flat(path: str) -> str:
    """A path without ``.`` and ``..``; ``..`` above the root is dropped, as browsers do."""
    rooted, out = path.startswith("/"), []
    parts = path.split("/")[1:] if rooted else path.split("/")
    for k, s in enumerate(parts):
        last = k == len(parts) - 1
        if s == ".":
            if last:
                out.append("")
        elif s == "..":
            if out and out[-1] != "..":
                out.pop()
            elif not rooted:
                out.append(s)
                continue
            if last:
                out.append("")
        else:
            out.append(s)
    return ("/" if rooted else "") + "/".join(out)


def _unrooted_dots(path: str) -> str:
    while path.startswith("/.."):
        path = path[3:]
    return path


def resolve(base: str, href: str, same_site: bool = False) -> str:
    """``href`` seen from ``base``. With ``same_site`` an absolute reference to another protocol or host becomes the base itself; ``//host/path`` is kept in either case."""
    b, h = split(base.strip()), split(href.strip())
    if not href.strip():
        return join(b)
    if h["scheme"] is not None:
        if same_site:
            here, there = _authority(base), _authority(href)
            return join(h) if here is not None and here == there else join(b)
        return join(h)
    h["scheme"] = b["scheme"]
    if h["location"] is not None:
        return join(h)
    h["location"] = b["location"]
    if h["path"] and h["path"].startswith("/"):
        h["path"] = _unrooted_dots(h["path"])
        return join(h)
    if h["path"] is None:
        h["path"] = b["path"]
        if h["parameters"] is None:
            h["parameters"] = b["parameters"]
            if h["query"] is None:
                h["query"] = b["query"]
        return join(h)
    folder = "/" if b["path"] is None else b["path"][: b["path"].rfind("/") + 1]
    h["path"] = _unrooted_dots(_flat(folder + h["path"]))
    return join(h)


def _encoded(text: str) -> str:
    """Percent-encoded once, whether it was before or not; text that can't be decoded stays."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return text.replace("+", "%2B")
    raw = unquote_to_bytes(text.replace("+", "%2B")).decode("utf-8", "replace")
    return quote(raw, safe="-._~")


def canonical(url: str | None, base: str = "") -> str | None:
    """Lower-case scheme and host, flat path, no default port, fragment or session keys, queries in order and encoded once. Null for what can't be opened."""
    if url is None:
        return None
    try:
        p = split(resolve(base, url) if base else url.strip())
    except ValueError:
        return None
    scheme = (p["scheme"] or "").lower()
    if scheme not in OPENABLE or not p["location"]:
        return None
    location = p["location"].rpartition("@")[2]
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", location)
    if m is None or not m[1]:
        return None
    host, port = m[1].lower(), m[2]
    path = (p["path"] or "") + (";" + p["parameters"] if p["parameters"] is not None else "")
    path = path.replace("\\", "/").replace("　", "%E3%80%80").replace(" ", "%20")
    if re.search(r"[\x00-\x1f\"<>^`{|}\x7f]|%(?![0-9A-Fa-f]{2})", path):
        return None
    path = re.sub("/+", "/", path)
    path = _flat(path).strip()
    while path.startswith("/../"):
        path = path[3:]
    pairs: dict[str, str] = {}
    for pair in (p["query"] or "").split("&"):
        if pair:
            key, mark, value = pair.partition("=")
            pairs[key] = value if mark else ""
    query = "&".join(_encoded(k) + ("=" + _encoded(v) if v else "") for k, v in pairs.items() if k.lower() not in SESSION_KEYS)
    shown = f":{int(port)}" if port and int(port) != PORTS.get(scheme) else ""
    return f"{scheme}://{host}{shown}{(path or '/').replace('%7E', '~')}" + (f"?{query}" if query else "")


@F.pandas_udf(StringType())
def canonical_udf(urls: pd.Series) -> pd.Series:
    known = {u: canonical(u) for u in urls.dropna().unique()}
    return urls.map(known)


@F.pandas_udf(StringType())
def resolve_udf(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else resolve(b, h) for b, h in zip(bases, hrefs)], dtype=object)


@F.pandas_udf(StringType())
def resolve_same_site_udf(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else resolve(b, h, same_site=True) for b, h in zip(bases, hrefs)], dtype=object)


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with the parts that split() gives of a URL column, as built-in expressions; each step takes one part off what the one before left."""
    whole, left = df.columns, F.col("__left")

    def before(mark: str) -> Column:
        return F.regexp_extract(left, f"^([^{mark}]*)", 1)

    def behind(mark: str) -> Column:
        return F.when(F.contains(left, F.lit(mark)), F.regexp_extract(left, rf"^[^{mark}]*[{mark}]([\s\S]*)$", 1))

    rows = df.withColumn("__left", trimmed(F.col(url)))
    rows = rows.select(*whole, behind("#").alias("fragment"), before("#").alias("__left"))
    scheme = F.nullif(F.regexp_extract(left, r"^(\p{L}[\p{L}\p{N}_.+-]*):", 1), F.lit(""))
    rows = rows.withColumn("scheme", scheme).withColumn("__left", F.coalesce(F.substr(left, F.length("scheme") + 2), left))
    net = F.startswith(left, F.lit("//"))
    location = F.when(net & F.contains(F.substr(left, F.lit(3)), F.lit("/")), F.regexp_extract(left, "^//([^/]*)", 1)).when(net, F.regexp_extract(left, "^//([^?;]*)", 1))
    rows = rows.withColumn("location", location).withColumn("__left", F.coalesce(F.substr(left, F.length("location") + 3), left))
    rows = rows.withColumn("query", behind("?")).withColumn("__left", before("?"))
    rows = rows.withColumn("parameters", behind(";")).withColumn("__left", before(";"))
    return rows.select(*whole, "scheme", "location", F.nullif(left, F.lit("")).alias("path"), "parameters", "query", "fragment")
