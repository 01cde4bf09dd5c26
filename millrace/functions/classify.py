"""URL classes as anchored regular expressions, evaluated inside the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import urls

# Alternatives that exclude a URL wherever they stand in it, file endings, article endings.
EXCLUDED = (
    "login", "register", "logout", "signin", "signup", "admin", "dashboard", "api", "rss", "feed", "search", "tag", "archive",
    r"\d{4}/\d{2}/\d{2}", r"sitemap\.xml", r"robots\.txt", "contact", "about", "privacy", "terms", "policy", "404", "error",
    "ajax", "json", "xml", "pdf", "print", "share", "comment", "reply", "download", "upload", "edit", "delete", "create", "update",
    "wp-admin", "wp-content", "wp-includes", "node_modules", r"\.git", "favicon",
)
FILE_ENDINGS = ("jpg", "jpeg", "png", "gif", "pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "mp3", "mp4", "avi")
_PAGE = r"(\.(html?|tpo|php|aspx|epi))?"

EXCLUDE = f"(?i)({'|'.join(EXCLUDED)})"
FILE_ENDING = rf"(?i)\.({'|'.join(FILE_ENDINGS)})$"
ARTICLE = rf"(?i)^.*((\d{{10,}}|\d{{4}}-\d{{2}}-\d{{2}}|[a-z0-9-]{{50,}}){_PAGE}$|-\d{{12,}}[^/]*$|-\d{{8}}[^/]*$|-[a-z]?\d{{3,}}{_PAGE}$)"


def is_excluded(url: Column) -> Column:
    return url.rlike(EXCLUDE)


def is_file(url: Column) -> Column:
    return url.rlike(FILE_ENDING)


def looks_like_article(url: Column) -> Column:
    return url.rlike(ARTICLE)


def is_article(url: Column) -> Column:
    """Article by its form, not excluded and no file."""
    return ~is_excluded(url) & ~is_file(url) & looks_like_article(url)


def segments(url: Column) -> Column:
    """Number of path segments that aren't empty."""
    return F.size(F.filter(F.split(urls.path(url), "/"), lambda x: x != ""))


def is_section_link(url: Column) -> Column:
    """A link worth following: http(s), at most one path segment, not excluded, no file, a short single query parameter."""
    q = urls.query(url)
    short = q.isNull() | ((F.length(q) <= 20) & ~F.contains(q, F.lit("&")))
    return F.coalesce(urls.scheme(url).isin("http", "https") & urls.host(url).isNotNull() & (segments(url) <= 1) & ~is_excluded(url) & ~is_file(url) & short, F.lit(False))


def is_navigation_link(url: Column) -> Column:
    """A section link that isn't an article's."""
    return is_section_link(url) & ~looks_like_article(url)


def is_home(url: Column) -> Column:
    return urls.path(url).isin("", "/")


def has_short_path(url: Column) -> Column:
    """A path of 2 to 49 characters in at most three parts."""
    p = urls.path(url)
    # trailing empty parts don't count, as in the JVM's split
    parts = F.size(F.split(F.regexp_replace(p, "/+$", ""), "/"))
    return F.coalesce(F.length(p).between(2, 49) & (parts <= 3), F.lit(False))


def is_likely_navigation(url: Column) -> Column:
    """A short path without date directories and without a post, article or story directory."""
    return ~url.rlike(r"/\d{4}/\d{2}/") & ~url.rlike("/(post|article|story)/") & has_short_path(url)
