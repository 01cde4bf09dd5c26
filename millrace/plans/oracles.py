"""SQL counterparts of the core queries, for DuckDB over the same tables.

They are written from the definitions, not from the DataFrame code: windows where that aggregates, regular expressions of
RE2, zones by name, patterns and letters written out, results of literal inputs as literals.
"""

from __future__ import annotations

_AS_OF = "TIMESTAMPTZ '2026-01-15 00:00:00+00'"
_TRIM = r"regexp_replace({u}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _trim(u: str) -> str:
    return _TRIM.format(u=u)


def _host(u: str) -> str:
    return rf"nullif(regexp_extract({_trim(u)}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '')"


def _scheme(u: str) -> str:
    return rf"nullif(lower(regexp_extract({_trim(u)}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '')"


def _path(u: str) -> str:
    return rf"CASE WHEN {_host(u)} IS NOT NULL THEN regexp_extract({_trim(u)}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END"


def _query(u: str) -> str:
    return rf"CASE WHEN regexp_matches({_trim(u)}, '^[^?#]*\?') THEN regexp_extract({_trim(u)}, '^[^?#]*\?([^#]*)', 1) END"


def _normal(u: str) -> str:
    t = f"lower({_trim(u)})"
    cut = f"CASE WHEN length({t}) > 1 AND {t} LIKE '%/' AND NOT regexp_full_match({t}, 'https?://[^/]+/') THEN left({t}, length({t}) - 1) ELSE {t} END"
    return f"CASE WHEN length({t}) > 0 THEN CASE WHEN regexp_matches({cut}, '^https?://') THEN {cut} ELSE 'http://' || ({cut}) END END"


def _hash(s: str) -> str:
    whole = f"list_reduce(list_concat([0::BIGINT], list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295)"
    return f"(CASE WHEN {whole} >= 2147483648 THEN {whole} - 4294967296 ELSE {whole} END)"


def _bucket(s: str, n: int) -> str:
    return f"abs({_hash(s)} % {n})::INT"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Fixed values, written out here once more so that an error in the code under test shows.
_EXCLUDED = (
    r"'(?i)(login|register|logout|signin|signup|admin|dashboard|api|rss|feed|search|tag|archive|\d{4}/\d{2}/\d{2}|sitemap\.xml|robots\.txt|contact|about|privacy|terms|policy|404|error|"
    r"ajax|json|xml|pdf|print|share|comment|reply|download|upload|edit|delete|create|update|wp-admin|wp-content|wp-includes|node_modules|\.git|favicon)'"
)
_FILE = r"'(?i)\.(jpg|jpeg|png|gif|pdf|doc|docx|xls|xlsx|zip|rar|mp3|mp4|avi)$'"
_ARTICLE = r"'(?i)((\d{10,}|\d{4}-\d{2}-\d{2}|[a-z0-9-]{50,})(\.(html?|tpo|php|aspx|epi))?$|-\d{12,}[^/]*$|-\d{8}[^/]*$|-[a-z]?\d{3,}(\.(html?|tpo|php|aspx|epi))?$)'"


def _is_article(u: str) -> str:
    return f"(NOT regexp_matches({u}, {_EXCLUDED}) AND NOT regexp_matches({u}, {_FILE}) AND regexp_matches({u}, {_ARTICLE}))"


def _section(u: str) -> str:
    q = _query(u)
    one = f"len(list_filter(string_split({_path(u)}, '/'), lambda x: x <> '')) <= 1"
    return f"coalesce({_scheme(u)} IN ('http', 'https') AND {_host(u)} IS NOT NULL AND {one} AND NOT regexp_matches({u}, {_EXCLUDED}) AND NOT regexp_matches({u}, {_FILE}) AND ({q} IS NULL OR (length({q}) <= 20 AND NOT contains({q}, '&'))), false)"


# The rules of fixtures.ROBOTS that apply, written out: host, order, 1 allow or 2 disallow, expression.
_RULES = r"""
rules(host, o, kind, re) AS (VALUES ('tinsangmai.news.example', 1, 1, '/the-thao/ben-.+\.html'), ('tinsangmai.news.example', 2, 2, '/the-thao/.*'),
  ('larkhavenledger.news.example', 1, 2, '/culture.*'), ('greyholmcourier.example', 1, 2, '/.+/the-.+-ferry.*'), ('greyholmcourier.example', 2, 2, '/science/.+')),
delays(host, delay) AS (VALUES ('tinsangmai.news.example', 1), ('larkhavenledger.news.example', 4))
"""
_FOUND = "found AS (SELECT url, min(task_id) AS first_task, count(*) AS copies FROM new_url_tasks GROUP BY url)"


def _verdicts() -> str:
    """CTEs up to ``admitted``: every distinct URL with its verdict."""
    path = f"coalesce(nullif({_path('url')}, ''), '/')"
    return f"""
WITH {_RULES}, {_FOUND},
hosted AS (SELECT *, {_host('url')} AS host, lower({_host('url')}) AS site, {path} AS path FROM found),
hit AS (SELECT h.url, arg_min(r.kind, r.o) AS kind FROM hosted h JOIN rules r ON r.host = h.site AND regexp_full_match(h.path, r.re) GROUP BY h.url),
judged AS (SELECT h.url, h.first_task, h.copies, h.host, d.priority, d.last_crawled,
   CASE WHEN h.url IS NULL OR length({_trim('h.url')}) = 0 THEN 'blank' WHEN coalesce({_scheme('h.url')} NOT IN ('http', 'https', 'ftp', 'file', 'jar', 'mailto'), true) THEN 'malformed'
        WHEN d.domain IS NULL THEN 'not_whitelisted' WHEN hit.kind = 2 THEN 'robots_blocked' ELSE 'admitted' END AS verdict
   FROM hosted h LEFT JOIN domains d ON d.domain = h.host LEFT JOIN hit ON hit.url = h.url),
admitted AS (SELECT *, {_bucket('host', 3)} AS subqueue, priority * 10 + {_bucket('host', 3)} AS queue_key FROM judged WHERE verdict = 'admitted')"""


def _front(cursor: int = 0) -> str:
    """The same with ``front``: turns in the front queues, from slots listed by hand."""
    slots = {0: ("[0, 1, 2, 3, 4]", "[5, 6, 7]", "[8]"), 4: ("[0, 5, 6, 7, 8]", "[1, 2, 3]", "[4]")}[cursor]
    return f"""{_verdicts()},
ranks AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY last_crawled NULLS FIRST, subqueue, url) - 1 AS n FROM admitted),
front AS (SELECT *, CASE priority WHEN 3 THEN 9 * (n // 5) + {slots[0]}[(n % 5) + 1] WHEN 2 THEN 9 * (n // 3) + {slots[1]}[(n % 3) + 1] WHEN 1 THEN 9 * n + {slots[2]}[1] END AS visit FROM ranks)"""


_BACK = f""",
back AS (SELECT * FROM (SELECT url, host, queue, row_number() OVER (PARTITION BY queue ORDER BY visit NULLS LAST, url) AS place FROM (SELECT url, host, visit, {_bucket('lower(host)', 10)} AS queue FROM front)) WHERE place <= 10000)"""

_RETRY_READY = f"coalesce(retry_count, 0) <= 3 AND (last_attempt IS NULL OR {_AS_OF} - last_attempt >= INTERVAL 5 MINUTE)"
_TYPED = (
    "typed AS (SELECT url, status_code AS status, CASE WHEN length(url) % 6 = 0 THEN 'application/json' WHEN length(url) % 7 = 0 THEN NULL ELSE 'text/html; charset=UTF-8' END AS content_type, "
    "CASE WHEN length(url) % 11 = 0 THEN 6000000 ELSE length(url) * 100 END AS content_length FROM url_metadata), "
    "outcomes AS (SELECT url, CASE WHEN url IS NULL OR length(" + _trim("url") + ") = 0 THEN 'blank' WHEN content_length > 5242880 THEN 'too_large' WHEN content_type IS NULL THEN 'failed' WHEN content_type NOT LIKE '%html%' THEN 'skipped' "
    "WHEN status IS NULL OR status <> 200 THEN 'retry' WHEN " + _path("url") + " IN ('', '/') THEN 'home' ELSE 'content' END AS outcome FROM typed)"
)


def _allow(strict: bool) -> str:
    article = _is_article("u.url")
    rule = f"CASE WHEN coalesce(coalesce(c.status, m.status_code) <> 200, true) AND coalesce(c.retry_count, m.retry_count, 0) > 3 THEN m.last_attempt IS NULL OR {_AS_OF} - m.last_attempt >= INTERVAL 5 MINUTE ELSE NOT {article} END"
    known = "CASE WHEN c.id IS NOT NULL OR m.id IS NULL THEN true" if strict else "CASE WHEN c.id IS NULL AND m.id IS NULL THEN true"
    return f"""
WITH u AS (SELECT url, sha256({_normal('url')}) AS id FROM (SELECT DISTINCT url FROM new_url_tasks)),
m AS (SELECT id, arg_max_null(status_code, coalesce(last_attempt, TIMESTAMPTZ '1970-01-01 00:00:00+00')) AS status_code, max(retry_count) AS retry_count, max(last_attempt) AS last_attempt FROM url_metadata GROUP BY id),
c AS (SELECT id, max(status) AS status, max(retry_count) AS retry_count FROM (SELECT sha256({_normal('url')}) AS id, http_status AS status, retry_count FROM retry_url_tasks) GROUP BY id)
SELECT u.url, CASE WHEN u.url IS NULL OR length({_trim('u.url')}) = 0 OR {_host('u.url')} IS NULL THEN false ELSE {known} ELSE {rule} END END AS allowed FROM u LEFT JOIN m USING (id) LEFT JOIN c USING (id)"""


# Fixed values, written out here once more: letters with marks and what they are folded to.
_LETTERS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåā", "c": "çćč", "d": "đ", "e": "èéẻẽẹêềếểễệëēę", "i": "ìíỉĩịïîī", "l": "ł", "n": "ñń", "o": "òóỏõọôồốổỗộơờớởỡợöøō", "s": "śš", "u": "ùúủũụưừứửữựüûū", "y": "ỳýỷỹỵÿ", "z": "źżž",
}


def _words(x: str) -> str:
    marked, plain = "".join(_LETTERS.values()), "".join(k * len(v) for k, v in _LETTERS.items())
    return rf"' ' || trim(regexp_replace(translate(lower({x}), '{marked}', '{plain}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


# The date formats of the crawler, each tried alone.
def _tried(x: str, formats: list[str], kind: str = "TIMESTAMP") -> str:
    return "coalesce(" + ", ".join(f"try_strptime({x}, {_quoted(f)})::{kind}" for f in formats) + ")"


def _strict(x: str, pattern: str, formats: list[str]) -> str:
    """Formats that are only tried on texts of one shape, as DuckDB reads numbers without their leading zeros."""
    return f"CASE WHEN regexp_full_match({x}, '{pattern}') THEN {_tried(x, formats)} END"


def _date(x: str) -> str:
    """The crawler's date parser over texts as they stand in the tables; zone abbreviations are only those that the formats name."""
    t = f"trim({x})"
    two, clock = "[0-9]{2}", "[0-9]{2}:[0-9]{2}(:[0-9]{2})?"
    shapes = [(f"{two}/{two}/[0-9]{{4}}", "%d/%m/%Y"), (f"[0-9]{{4}}-{two}-{two}", "%Y-%m-%d"), (f"{two}-{two}-[0-9]{{4}}", "%d-%m-%Y"), (f"[A-Z][a-z]{{2}} {two}, [0-9]{{4}}", "%b %d, %Y"), (f"{two} [A-Z][a-z]{{2}} [0-9]{{4}}", "%d %b %Y"), (f"[0-9]{{4}}/{two}/{two}", "%Y/%m/%d")]
    times = [_strict(t, f"{p} {clock}", [f"{f} %H:%M:%S", f"{f} %H:%M"]) for p, f in shapes]
    days = [_strict(t, p, [f]) for p, f in shapes] + [_strict(t, f"{two}/{two}/[0-9]{{4}}", ["%m/%d/%Y"])]
    bare = rf"trim(regexp_replace({t}, '\s*GMT[+-]\d{{1,2}}\s*', '', 'g'))"
    gmt_times = [_strict(bare, f"{p} {clock}", [f"{f} %H:%M:%S", f"{f} %H:%M"]) for p, f in shapes[:3]]
    hours = rf"nullif(regexp_extract({t}, 'GMT([+-]\d{{1,2}})', 1), '')::INT"
    gmt = f"CASE WHEN abs({hours}) <= 18 THEN coalesce({', '.join(gmt_times)}) - to_hours({hours}) END"
    iso = rf"CASE WHEN regexp_full_match({t}, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d{{3}})?(Z|[+-]\d{{2}}:\d{{2}})') THEN timezone('UTC', try_cast({t} AS TIMESTAMPTZ)) END"
    # zone names as the JVM reads them: regions, whatever half of the year the name is of; BST is the one of Bougainville there
    named = rf"regexp_extract({t}, '^\d{{2}}/\d{{2}}/\d{{4}} \d{{2}}:\d{{2}} ([A-Z]{{3,4}})$', 1)"
    regions = "WHEN 'GMT' THEN 'UTC' WHEN 'UTC' THEN 'UTC' WHEN 'ICT' THEN 'Asia/Bangkok' WHEN 'BST' THEN 'Pacific/Bougainville' WHEN 'EST' THEN 'America/New_York' WHEN 'EDT' THEN 'America/New_York' WHEN 'PST' THEN 'America/Los_Angeles' WHEN 'PDT' THEN 'America/Los_Angeles' WHEN 'CET' THEN 'Europe/Paris' WHEN 'CEST' THEN 'Europe/Paris' WHEN 'AEST' THEN 'Australia/Sydney' WHEN 'AEDT' THEN 'Australia/Sydney'"
    zoned = f"timezone('UTC', timezone(CASE {named} {regions} END, try_strptime(left({t}, 16), '%d/%m/%Y %H:%M')::TIMESTAMP))"
    n = rf"try_cast(nullif(regexp_extract(lower({t}), '(\d{{1,9}})\s+(day|hour|minute)s?\s+ago', 1), '') AS BIGINT)"
    unit = rf"CASE regexp_extract(lower({t}), '\d{{1,9}}\s+(day|hour|minute)s?\s+ago', 1) WHEN 'day' THEN 86400 WHEN 'hour' THEN 3600 WHEN 'minute' THEN 60 END"
    now = "TIMESTAMP '2026-01-15 00:00:00'"
    ago = f"CASE WHEN contains(lower({t}), 'today') THEN {now} WHEN contains(lower({t}), 'yesterday') THEN {now} - INTERVAL 1 DAY ELSE {now} - to_seconds({n} * {unit}) END"
    return f"coalesce({gmt}, {zoned}, {iso}, {', '.join(times)}, {', '.join(days)}, {ago})"


# Problem 4 once more, from its statement: notations, units and zone abbreviations written out.
_MONTHS = ("jan", "feb|fév", "mar", "apr|avr", "may|mai", "jun|juin", "jul|juil", "aug|aoû", "sep", "oct", "nov", "dec|déc")
_WEEKDAYS = "monday|mon|tuesday|tues|tue|wednesday|wed|thursday|thurs|thur|thu|friday|fri|saturday|sat|sunday|sun|thứ hai|thứ ba|thứ tư|thứ năm|thứ sáu|thứ bảy|chủ nhật|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche"
_OFFSETS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 3600, "bst": 3600, "cet": 3600, "cest": 7200, "eet": 7200, "eest": 10800, "msk": 10800, "ict": 25200, "jst": 32400, "kst": 32400, "awst": 28800, "acst": 34200, "acdt": 37800, "aest": 36000, "aedt": 39600, "nzst": 43200, "nzdt": 46800,
    "est": -18000, "edt": -14400, "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200,
}


def _instants() -> str:
    t = r"lower(trim(regexp_replace(publish_at, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')))"
    t = f"regexp_replace({t}, '^(?:{_WEEKDAYS})[,.]? ', '')"
    t = f"regexp_replace({t}, '[(),]', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, ' (?:ngày|at|lúc|à) +(\d)', ' \1', 'g'), '(^| )tháng (\d{{1,2}})', '\1m\2')"
    for k, names in enumerate(_MONTHS, 1):
        t = rf"regexp_replace({t}, '\b(?:{names})[a-zà-ÿ]*\.?', 'm{k}')"
    t = f"trim(regexp_replace({t}, ' +', ' ', 'g'))"
    clock = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?(am|pm))?"
    zone = r"(?: ?(z|[a-z]{2,5}|(?:gmt|utc)? ?[+-]\d{1,2}(?::?\d{2})?))?"
    dates = [(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "y mo d"), (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", "a b y"), (r"(\d{1,2}) m(\d{1,2}) (\d{4})", "d mo y"), (r"m(\d{1,2}) (\d{1,2}) (\d{4})", "mo d y")]
    cases = []
    for date, names in dates:
        for pattern, order in ((f"^{date}(?:(?:t| t?){clock})?{zone}$", f"{names} h mi s f ap z"), (f"^{clock} {date}{zone}$", f"h mi s f ap {names} z")):
            where = order.split()
            parts = ", ".join(f"{n} := " + (f"regexp_extract(t, '{pattern}', {where.index(n) + 1})" if n in where else "''") for n in ("y", "a", "b", "mo", "d", "h", "mi", "s", "f", "ap", "z"))
            cases.append(f"WHEN regexp_matches(t, '{pattern}') THEN struct_pack({parts})")
    n = lambda x: f"try_cast(p.{x} AS BIGINT)"
    month = f"coalesce({n('mo')}, CASE WHEN mdy THEN {n('a')} ELSE {n('b')} END)"
    day = f"coalesce({n('d')}, CASE WHEN mdy THEN {n('b')} ELSE {n('a')} END)"
    hour = f"CASE WHEN p.ap = '' THEN {n('h')} WHEN {n('h')} NOT BETWEEN 1 AND 12 THEN NULL WHEN p.ap = 'am' THEN {n('h')} % 12 ELSE {n('h')} % 12 + 12 END"
    second = f"coalesce({n('s')}, 0)"
    units = "CASE WHEN regexp_full_match(u, 'seconds?|secs?|giây|secondes?') THEN 1 WHEN regexp_full_match(u, 'minutes?|mins?|phút') THEN 60 WHEN regexp_full_match(u, 'hours?|hrs?|giờ|tiếng|heures?') THEN 3600 WHEN regexp_full_match(u, 'days?|ngày|jours?') THEN 86400 WHEN regexp_full_match(u, 'weeks?|tuần|semaines?') THEN 604800 END"
    away = r"CASE WHEN regexp_matches(t, '^il y a \d{1,6} [^ ]+$|^\d{1,6} [^ ]+ (?:ago|trước)$') THEN try_cast(regexp_extract(t, '^(?:il y a )?(\d{1,6})', 1) AS BIGINT) END"
    unit = r"regexp_extract(t, '^(?:il y a )?\d{1,6} ([^ ]+)', 1)"
    offsets = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _OFFSETS.items())
    number = r"CASE WHEN regexp_matches(t, '^-?\d{1,15}$') AND NOT regexp_matches(t, '^\d{8}$') THEN try_cast(t AS BIGINT) END"
    numeric = r"^(?:gmt|utc)?([+-])(\d{1,2}):?(\d{2})?$"
    return f"""
WITH c AS (SELECT c.id, {_host('c.url')} AS h, epoch_us(received_at) AS received, {t} AS t FROM contents c),
w AS (SELECT c.*, coalesce(l.time_zone, 'UTC') AS tz, coalesce(l.date_order = 'mdy', false) AS mdy, {unit} AS u, {away} AS k, {number} AS num, CASE {' '.join(cases)} END AS p FROM c LEFT JOIN site_locales l ON lower(l.domain) = lower(c.h)),
r AS (SELECT *, try_cast(lpad(p.y, 4, '0') || '-' || lpad(({month})::VARCHAR, 2, '0') || '-' || lpad(({day})::VARCHAR, 2, '0') AS DATE) AS day, {hour} AS hour, {n('mi')} AS minute, {second} AS second, CASE WHEN p.f = '' THEN 0 ELSE rpad(p.f, 6, '0')[1:6]::BIGINT END AS micro, replace(p.z, ' ', '') AS zone FROM w),
q AS (SELECT *, epoch_us(day::TIMESTAMP) + CASE WHEN p.h = '' THEN 0 WHEN hour BETWEEN 0 AND 23 AND minute BETWEEN 0 AND 59 AND second BETWEEN 0 AND 59 THEN ((hour * 60 + minute) * 60 + second) * 1000000 + micro END AS wall FROM r),
i AS (SELECT *, make_timestamp(wall) AS ts, CASE WHEN regexp_matches(zone, '{numeric}') THEN CASE WHEN regexp_extract(zone, '{numeric}', 1) = '-' THEN -1 ELSE 1 END * (regexp_extract(zone, '{numeric}', 2)::BIGINT * 3600 + coalesce(try_cast(regexp_extract(zone, '{numeric}', 3) AS BIGINT), 0) * 60) ELSE CASE zone {offsets} END END AS off FROM q),
z AS (SELECT id, CASE WHEN num IS NOT NULL THEN CASE WHEN abs(num) >= 100000000000 THEN num * 1000 ELSE num * 1000000 END WHEN k IS NOT NULL THEN received - k * ({units}) * 1000000
  WHEN t IN ('now', 'just now', 'today', 'vừa xong', 'hôm nay', 'aujourd''hui') THEN received WHEN t IN ('yesterday', 'hôm qua', 'hier') THEN received - 86400000000
  WHEN zone <> '' THEN wall - off * 1000000
  WHEN timezone(tz, timezone(tz, ts) - INTERVAL 1 HOUR) = ts THEN epoch_us(timezone(tz, ts) - INTERVAL 1 HOUR) ELSE epoch_us(timezone(tz, ts)) END AS publish_us FROM i)
SELECT DISTINCT id, publish_us FROM z WHERE publish_us IS NOT NULL"""


# Pages by regular expressions, for the markup of the tables: links stand in double quotes, navigation isn't nested.
_PAGES = r"""
pages AS (SELECT DISTINCT id, url, raw_html, coalesce(nullif(regexp_extract(raw_html, '<link rel="canonical" href="([^"]*)"', 1), ''), regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS base FROM url_metadata WHERE status_code = 200 AND raw_html IS NOT NULL),
sited AS (SELECT *, regexp_extract(base, '^[A-Za-z]+://[^/]+') AS root, regexp_extract(base, '^([A-Za-z]+)://', 1) AS scheme FROM pages)"""


def _full(href: str) -> str:
    """A link of a page in sight of its base: kept on its own site, the base itself elsewhere."""
    return f"CASE WHEN {href} = '' THEN base WHEN {href} LIKE '//%' THEN scheme || ':' || {href} WHEN {href} LIKE '/%' THEN root || {href} WHEN {href} LIKE root || '/%' OR {href} = root THEN {href} WHEN {href} LIKE '#%' THEN regexp_extract(base, '^[^#]*') || {href} ELSE base END"


_HREF = "'<a(?: [^>]*)? href=\"([^\"]*)\"'"
_NAV = r"""'(?s)<nav[ >].*?</nav>|<div class="(?:nav|navigation|navbar|menu|main-menu|top-menu)">.*?</div>|<div id="?(?:nav|menu)"?>.*?</div>|<ul class="(?:nav|menu)">.*?</ul>'"""


def _links(within: str | None = None) -> str:
    """CTE ``links`` (id, base, url): those of whole pages, or of the parts that a pattern finds."""
    if within is None:
        return f"links AS (SELECT DISTINCT id, base, {_full('h')} AS url FROM (SELECT *, unnest(regexp_extract_all(raw_html, {_HREF}, 1)) AS h FROM sited))"
    part = f"SELECT id, base, root, scheme, unnest(regexp_extract_all(raw_html, {within})) AS part FROM sited"
    return f"navs AS (SELECT DISTINCT id, base, {_full('h')} AS url FROM (SELECT *, unnest(regexp_extract_all(part, {_HREF}, 1)) AS h FROM ({part})) WHERE h NOT IN ('', '#') AND h NOT LIKE 'javascript:%')"


_SERIES = "inc AS (SELECT event_type AS metric, date_trunc('second', ts) AS ts, count(*) AS inc FROM events GROUP BY ALL), series AS (SELECT metric, ts, sum(inc) OVER (PARTITION BY metric ORDER BY ts)::BIGINT AS value FROM inc)"


def oracle_sql() -> dict[str, str]:
    u = "(SELECT DISTINCT url FROM new_url_tasks WHERE url IS NOT NULL)"
    phrase = _words("'mùa giải mới'")
    scored = f"s AS (SELECT id, url, CASE WHEN contains({_words('title')}, {phrase}) THEN 3.0 ELSE 0.0 END + CASE WHEN contains({_words('content')}, {phrase}) THEN 1.0 ELSE 0.0 END AS score FROM contents)"
    valid = "length(trim(url)) > 0 AND length(trim(title)) > 0 AND length(trim(content)) > 0"
    robots_path = f"coalesce(nullif({_path('url')}, ''), '/')"
    new_hosts = "('tinsangmai.news.example'), ('new-one.example'), ('new-two.example'), (' new-one.example ')"
    embed = "concat_ws(' ', nullif(trim(title), ''), nullif(left(trim(content), 8000), ''))"
    changes = "c AS (SELECT domain, priority AS p FROM domains)"
    bootstrap = f"SELECT DISTINCT trim(v) AS h FROM (VALUES {new_hosts}) t(v) WHERE trim(v) NOT IN (SELECT domain FROM domains)"
    dated = f"dated AS (SELECT id, url, title, content, {_date('publish_at')} AS moment FROM contents)"
    hits = f"hits AS (SELECT id, url, moment FROM dated WHERE contains({_words('title')}, {phrase}) OR contains({_words('content')}, {phrase}))"
    base = "regexp_replace(base, '/$', '')"
    section, nav = _section("url"), f"({_section('url')} AND NOT regexp_matches(url, {_ARTICLE}))"
    fresh = f"""WITH {_PAGES}, {_links()}, {_links(_NAV)},
known AS (SELECT id, base, {base} AS u FROM pages UNION SELECT id, base, regexp_replace(url, '/$', '') FROM navs WHERE {nav}),
fresh AS (SELECT DISTINCT l.id, regexp_replace(l.url, '/$', '') AS url FROM (SELECT * FROM links WHERE {section}) l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = l.id AND k.base = l.base AND k.u = regexp_replace(l.url, '/$', '')))"""

    def closure(seeds: str) -> str:
        """Each URL at the smallest depth at which a walk over stored pages reaches it; walks go far beyond the depth of the tables."""
        known = f"length({_trim('url')}) > 0 AND {_scheme('url')} IN ('http', 'https', 'ftp', 'file', 'jar', 'mailto') AND {_host('url')} IN (SELECT domain FROM domains)"
        return f"""{fresh.replace('WITH', 'WITH RECURSIVE', 1)},
m AS (SELECT id, arg_max_null(status_code, coalesce(last_attempt, TIMESTAMPTZ '1970-01-01 00:00:00+00')) AS status_code, max(retry_count) AS retry_count, max(last_attempt) AS last_attempt FROM url_metadata GROUP BY id),
ok AS (SELECT DISTINCT f.id, f.url, f.next FROM (SELECT id, url, sha256({_normal('url')}) AS next FROM fresh WHERE {known}) f LEFT JOIN m ON m.id = f.next
  WHERE CASE WHEN m.id IS NULL THEN true WHEN coalesce(m.status_code <> 200, true) AND coalesce(m.retry_count, 0) > 3 THEN m.last_attempt IS NULL OR {_AS_OF} - m.last_attempt >= INTERVAL 5 MINUTE ELSE NOT {_is_article('f.url')} END),
r AS (SELECT DISTINCT url, sha256({_normal('url')}) AS id, 0 AS depth FROM ({seeds}) WHERE {known} UNION SELECT ok.url, ok.next, r.depth + 1 FROM r JOIN ok ON ok.id = r.id WHERE r.depth < 40)
SELECT url, min(depth)::INT AS depth FROM r GROUP BY url"""

    # small pages and what is left of them without noise, end tags added
    kept = """SELECT * FROM (VALUES ('1', 'a.example', '<h1>T</h1><div class=content>C <p>c</p></div><span class=author>A</span>', '<h1>T</h1><div class=content>C <p>c</p></div><span class=author>A</span>'),
  ('2', 'b.example', '<h1>T</h1><main>M &amp; m</main><nav>n</nav>', '<h1>T</h1><main>M &amp; m</main>'), ('3', 'c.example', '<h1>T</h1><p>no content', '<h1>T</h1><p>no content</p>'),
  ('4', 'd.example', '<header><a class=main href=/h1>h</a></header><div id=content><div class=menu><a href=/m1>m</a></div><a href=/m2>no</a></div><a class=''btn'' href=/p1>p</a><a class=''btn'' href=/2024/05/x>p</a><div class=breadcrumbs><a href=/b1/>b</a><a href=''#''>b</a></div><a href=/r1>1</a><a href=/r1/>2</a><a href=/once>3</a>',
   '<header><a class=main href=/h1>h</a></header><div id=content><a href=/m2>no</a></div><a class=''btn'' href=/p1>p</a><a class=''btn'' href=/2024/05/x>p</a><div class=breadcrumbs><a href=/b1/>b</a><a href=''#''>b</a></div><a href=/r1>1</a><a href=/r1/>2</a><a href=/once>3</a>')) t(id, domain, page, kept)"""
    merge_valid = f"SELECT *, coalesce(received_at < TIMESTAMPTZ '2025-02-01 00:00:00+00', true) AS early FROM contents WHERE {valid}"
    rest = "regexp_replace(regexp_extract(t, '^([^#]*)'), '^\\p{L}[\\p{L}\\p{N}_.+-]*:', '')"
    flushes = f"""WITH RECURSIVE f AS (SELECT host, us, row_number() OVER (PARTITION BY host ORDER BY us) AS k FROM (SELECT lower({_host('url')}) AS host, epoch_us(ts) AS us FROM new_url_tasks WHERE {_host('url')} IS NOT NULL AND ts IS NOT NULL)),
r AS (SELECT host, k, us, 0 AS n, us AS since, 1 AS flushed FROM f WHERE k = 1
  UNION ALL SELECT f.host, f.k, f.us, CASE WHEN g.go THEN 0 ELSE g.n END, CASE WHEN g.go THEN f.us ELSE r.since END, CASE WHEN g.go THEN g.n ELSE 0 END
  FROM r JOIN f ON f.host = r.host AND f.k = r.k + 1, LATERAL (SELECT CASE WHEN f.us - r.since > 1200000000 THEN 1 ELSE r.n + 1 END AS n, (CASE WHEN f.us - r.since > 1200000000 THEN 1 ELSE r.n + 1 END >= 10 OR f.us - r.since > 180000000) AS go) g)"""
    by_host = f"{_verdicts()} SELECT lower(host) AS host, verdict, count(*) AS urls, sum(copies)::BIGINT AS copies FROM judged GROUP BY lower(host), verdict"
    upserts = f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY received_at, id) AS first, row_number() OVER (PARTITION BY url ORDER BY received_at DESC, id DESC) AS last FROM contents WHERE {valid})
SELECT f.id, l.url, l.title, md5(l.content) AS content_md5 FROM v f JOIN v l ON f.url = l.url AND f.first = 1 AND l.last = 1"""
    not_blank = f"length({_trim('url')}) > 0"
    return {
        # streams give what their tables give at once
        "stream_dedup": "SELECT DISTINCT url FROM new_url_tasks",
        "stream_windows": "SELECT event_type, to_timestamp(s) AS start, to_timestamp(s + 300) AS \"end\", count(*) AS n FROM (SELECT event_type, (epoch_us(ts) // 15000000 - k) * 15 AS s FROM events, range(20) t(k)) GROUP BY event_type, s",
        "stream_host_flushes": f"{flushes} SELECT host, us, flushed::INT AS fetches FROM r WHERE flushed > 0",
        "stream_upserts": upserts,
        "stream_retries": f"""SELECT DISTINCT url, CASE WHEN {_RETRY_READY} THEN 'frontier' ELSE 'retry_set' END AS route FROM retry_url_tasks WHERE {not_blank}
UNION ALL SELECT * FROM (SELECT DISTINCT url, 'sent' AS route FROM retry_url_tasks WHERE {not_blank} AND NOT ({_RETRY_READY}) ORDER BY url LIMIT 5)""",
        "stream_admission": by_host,
        "admit_by_host": by_host,
        "admit_counters": f"{_verdicts()} SELECT lower(host) AS host, count(*) FILTER (verdict = 'admitted') AS processed, count(*) FILTER (verdict <> 'admitted') AS rejected FROM judged WHERE verdict <> 'blank' GROUP BY lower(host)",
        "url_hash_id": f"SELECT url, sha256({_normal('url')}) AS id FROM {u}",
        "java_bucket": f"SELECT domain, {_hash('domain')} AS hash, {_bucket('domain', 3)} AS of_3, {_bucket('domain', 10)} AS of_10 FROM domains",
        "article_classify": f"SELECT url, regexp_matches(url, {_EXCLUDED}) AS excluded, regexp_matches(url, {_FILE}) AS file, regexp_matches(url, {_ARTICLE}) AS article_like, {_is_article('url')} AS article FROM {u}",
        "link_valid": f"SELECT url, {_section('url')} AS section, {_section('url')} AND NOT regexp_matches(url, {_ARTICLE}) AS navigation, coalesce({_path('url')} IN ('', '/'), false) AS home FROM {u}",
        "front_queue_order": f"{_front()} SELECT url, host, priority, last_crawled, subqueue, queue_key, visit FROM front",
        "front_queue_cursor": f"{_front(4)} SELECT url, visit FROM front WHERE visit IS NOT NULL",
        "front_batch": f"{_front()} SELECT url, priority, visit FROM front WHERE visit IS NOT NULL ORDER BY visit LIMIT 50",
        "back_queue_order": f"{_front()}{_BACK} SELECT url, queue, place, queue AS turn FROM back",
        "dispatch_batch": f"{_front()}{_BACK} SELECT url, queue, place FROM back ORDER BY place, queue LIMIT 10",
        "frontier_stats": f"""{_front()}{_BACK}, q AS (SELECT 'front' AS side, queue_key::VARCHAR AS queue, count(*) AS urls FROM admitted GROUP BY ALL UNION ALL SELECT 'back', 'b' || queue, count(*) FROM back GROUP BY ALL)
SELECT * FROM q UNION ALL SELECT side, NULL, sum(urls)::BIGINT FROM q GROUP BY side UNION ALL SELECT 'all', NULL, coalesce(sum(urls), 0)::BIGINT FROM q UNION ALL SELECT 'hosts', NULL, count(DISTINCT lower(host)) FROM back""",
        "frontier_empty": f"{_verdicts()} SELECT count(*) = 0 AS empty FROM admitted",
        "frontier_tick": f"""{_front()}, b AS (SELECT * FROM front WHERE visit IS NOT NULL ORDER BY visit LIMIT 50), q AS (SELECT url, host, visit, {_bucket('lower(host)', 10)} AS queue FROM b),
p AS (SELECT url, host, queue, row_number() OVER (PARTITION BY queue ORDER BY visit, url) AS place FROM q) SELECT url, host, queue, place, queue AS turn FROM p ORDER BY place, queue LIMIT 10""",
        "retry_gate": f"SELECT url, CASE WHEN {_RETRY_READY} THEN 'frontier' ELSE 'retry_set' END AS route, count(*) AS messages FROM retry_url_tasks WHERE length({_trim('url')}) > 0 GROUP BY ALL",
        "retry_drain": f"SELECT DISTINCT url FROM retry_url_tasks WHERE length({_trim('url')}) > 0 AND NOT ({_RETRY_READY}) ORDER BY url LIMIT 5",
        "robots_verdict": f"""WITH {_RULES}, x AS (SELECT url, lower({_host('url')}) AS host, {robots_path} AS path FROM {u}),
hit AS (SELECT x.url, arg_min(r.kind, r.o) AS kind FROM x JOIN rules r ON r.host = x.host AND regexp_full_match(x.path, r.re) GROUP BY x.url)
SELECT x.url, coalesce(hit.kind, 3) AS robots, coalesce(d.delay, 2) AS crawl_delay FROM x LEFT JOIN hit USING (url) LEFT JOIN delays d ON d.host = x.host""",
        "seeds_active": "SELECT domain, unnest(seed_urls) AS url FROM domains WHERE coalesce(active, false)",
        "domain_bootstrap": f"SELECT substr(sha256(h), 1, 24) AS id, h AS domain, ['https://' || h] AS seed_urls, NULL::TIMESTAMPTZ AS last_crawled, {_AS_OF} AS create_at, 1 AS priority, true AS active FROM (SELECT DISTINCT trim(v) AS h FROM (VALUES {new_hosts}) t(v)) WHERE h NOT IN (SELECT domain FROM domains)",
        "domain_update": f"WITH {changes} SELECT d.id, d.domain, CASE WHEN c.p = 2 THEN ['https://' || d.domain || '/new'] ELSE d.seed_urls END AS seed_urls, CASE WHEN c.p % 2 = 0 THEN {_AS_OF} ELSE d.last_crawled END AS last_crawled, d.create_at, d.priority, CASE WHEN c.p = 2 THEN false ELSE d.active END AS active FROM domains d LEFT JOIN c USING (domain)",
        "domain_update_strict": f"WITH {changes} SELECT d.domain, CASE WHEN c.p = 2 THEN false WHEN c.domain IS NOT NULL THEN true ELSE d.active END AS active FROM domains d LEFT JOIN c USING (domain)",
        "recrawl_ticks": f"SELECT t.tick, s.url FROM (SELECT unnest(generate_series({_AS_OF} + INTERVAL 90 SECOND, {_AS_OF} + INTERVAL 2 HOUR, INTERVAL 20 MINUTE)) AS tick) t, (SELECT unnest(seed_urls) AS url FROM domains WHERE coalesce(active, false)) s",
        "fetch_outcome": f"WITH {_TYPED} SELECT url, outcome, count(*) AS attempts FROM outcomes GROUP BY ALL",
        "fetch_counters": f"WITH {_TYPED} SELECT lower({_host('url')}) AS host, count(*) FILTER (outcome IN ('home', 'content')) AS fetched, count(*) FILTER (outcome IN ('retry', 'failed', 'too_large')) AS failed FROM outcomes GROUP BY lower({_host('url')})",
        "redirect_resolve": """WITH u AS (SELECT DISTINCT url FROM retry_url_tasks), m AS (SELECT DISTINCT url FROM retry_url_tasks)
SELECT u.url, CASE WHEN m.url IS NULL OR length(u.url) % 3 = 0 THEN u.url WHEN length(u.url) % 3 = 1 THEN u.url || '/2' ELSE u.url || '/1' END AS final_url,
CASE WHEN m.url IS NULL OR length(u.url) % 3 = 0 THEN 0 WHEN length(u.url) % 3 = 1 THEN 2 ELSE 1 END AS hops,
CASE WHEN m.url IS NULL THEN 'ok' WHEN length(u.url) % 3 = 0 THEN 'off_host' WHEN length(u.url) % 3 = 1 AND length(u.url) % 2 = 0 THEN 'too_many' ELSE 'ok' END AS result FROM u LEFT JOIN m ON m.url = u.url""",
        "metadata_fold": f"""WITH a AS (SELECT sha256({_normal('url')}) AS id, {_normal('url')} AS norm, last_attempt AS ts, status_code AS status, raw_html AS html FROM url_metadata WHERE length({_trim('url')}) > 0
  UNION ALL SELECT sha256({_normal('url')}), {_normal('url')}, last_attempt, http_status, NULL FROM retry_url_tasks WHERE length({_trim('url')}) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts NULLS FIRST, coalesce(status, -1)) AS n, dense_rank() OVER (PARTITION BY id ORDER BY ts NULLS FIRST, coalesce(status, -1)) AS k FROM a),
f AS (SELECT id, max(k) FILTER (status = 200) AS good FROM o GROUP BY id)
SELECT o.id, min(norm) AS url, length(arg_min(html, n) FILTER (html IS NOT NULL)) AS html_chars, md5(arg_min(html, n) FILTER (html IS NOT NULL)) AS html_md5, arg_max_null(status, n) AS status_code,
count(*) FILTER (f.good IS NULL OR k > f.good)::INT AS retry_count, max(ts) AS last_attempt FROM o JOIN f USING (id) GROUP BY o.id""",
        "url_allow": _allow(False),
        "url_allow_strict": _allow(True),
        "limiter_window": "WITH w AS (SELECT domain AS key, count(*) OVER (PARTITION BY domain ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM new_url_tasks WHERE domain IS NOT NULL) SELECT key, max(n) AS most_in_window, count(*) FILTER (n > 30) AS held FROM w GROUP BY key",
        "current_url": "SELECT DISTINCT id, nullif(regexp_extract(raw_html, '<link rel=\"canonical\" href=\"([^\"]*)\"', 1), '') AS canonical FROM url_metadata WHERE status_code = 200 AND raw_html IS NOT NULL",
        "missing_selectors": f"SELECT DISTINCT lower({_host('url')}) AS domain FROM url_metadata WHERE {_host('url')} IS NOT NULL AND lower({_host('url')}) NOT IN (SELECT lower(domain) FROM content_css_selector WHERE domain IS NOT NULL)",
        "store_counters": f"SELECT count(DISTINCT url) FILTER ({valid}) AS stored, count(*) FILTER (NOT coalesce({valid}, false)) AS failed FROM contents",
        "content_upsert": f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY received_at, id) AS first, row_number() OVER (PARTITION BY url ORDER BY received_at DESC, id DESC) AS last FROM contents WHERE {valid})
SELECT f.id, l.url, l.title, md5(l.content) AS content_md5, l.author, l.publish_at, true AS is_insert FROM v f JOIN v l ON f.url = l.url AND f.first = 1 AND l.last = 1""",
        "embed_text": f"SELECT id, md5({embed}) AS text_md5, length({embed}) AS chars FROM contents",
        "search_keyword_score": f"WITH {scored} SELECT id, url, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, url, id LIMIT 20",
        "search_indexed": f"WITH {scored} SELECT id, url, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, url, id LIMIT 20",
        "search_semantic": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q.q) + 1, 6) AS score FROM embeddings, q WHERE embedding IS NOT NULL ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.q) DESC, vec_id LIMIT 10",
        "semantic_total": "SELECT count(*) AS total FROM contents WHERE content_embedding IS NOT NULL",
        "frontier_totals": f"{_verdicts()} SELECT count(*) AS scheduled, count(*) FILTER (verdict = 'admitted') AS processed, count(*) FILTER (verdict <> 'admitted') AS rejected FROM judged WHERE verdict <> 'blank'",
        "queues_cleared": "SELECT * FROM (VALUES ('all', NULL::VARCHAR, 0::BIGINT), ('hosts', NULL, 0)) t(side, queue, urls)",
        "already_queued": f"""WITH {_FOUND}, q AS (SELECT DISTINCT url FROM retry_url_tasks WHERE url IS NOT NULL),
v AS (SELECT copies, CASE WHEN f.url IS NULL OR length({_trim('f.url')}) = 0 THEN 'blank' WHEN q.url IS NOT NULL THEN 'queued' WHEN coalesce({_scheme('f.url')} NOT IN ('http', 'https', 'ftp', 'file', 'jar', 'mailto'), true) THEN 'malformed'
  WHEN {_host('f.url')} IS NULL OR {_host('f.url')} NOT IN (SELECT domain FROM domains) THEN 'not_whitelisted' ELSE 'admitted' END AS verdict FROM found f LEFT JOIN q ON q.url = f.url)
SELECT verdict, count(*) AS urls, sum(copies)::BIGINT AS copies FROM v GROUP BY verdict""",
        # the rules of other agents apply to no path, an empty pattern only to an empty path, and the delay is that of the last group by rank
        "robots_strict": f"""WITH rules(host, o, kind, re) AS (VALUES ('tinsangmai.news.example', 1, 1, '/the-thao/ben-.+\\.html'), ('tinsangmai.news.example', 2, 2, '/the-thao/.*'), ('larkhavenledger.news.example', 1, 2, '/culture.*'),
  ('trangnuocbiec.news.example', 1, 2, ''), ('greyholmcourier.example', 1, 2, '/.+/the-.+-ferry.*'), ('greyholmcourier.example', 2, 2, '/science/.+')),
delays(host, delay) AS (VALUES ('tinsangmai.news.example', 1)),
x AS (SELECT url, lower({_host('url')}) AS host, {_path('url')} AS path FROM {u}),
hit AS (SELECT x.url, arg_min(r.kind, r.o) AS kind FROM x JOIN rules r ON r.host = x.host AND regexp_full_match(x.path, r.re) GROUP BY x.url)
SELECT x.url, coalesce(hit.kind, 3) AS robots, coalesce(d.delay, 2) AS crawl_delay FROM x LEFT JOIN hit USING (url) LEFT JOIN delays d ON d.host = x.host""",
        "robots_parse": r"""SELECT host, group_id, agents, type, pattern, regex, length(regex)::INT AS regex_len, delay::DOUBLE AS delay, sitemaps, NULL::VARCHAR AS preferred_host FROM (VALUES
  ('tinsangmai.news.example', 0, ['*'], 2, '/the-thao/', '^\Q/the-thao/\E.*', 1.5, ['https://tinsangmai.news.example/sitemap.xml']), ('tinsangmai.news.example', 0, ['*'], 1, '/the-thao/ben-*.html$', '^\Q/the-thao/ben-\E.+\Q.html\E$', 1.5, ['https://tinsangmai.news.example/sitemap.xml']),
  ('larkhavenledger.news.example', 0, ['millrace'], 2, '/culture', '^\Q/culture\E.*', 4.0, []::VARCHAR[]), ('larkhavenledger.news.example', 1, ['*'], 2, '/', '^\Q/\E.*', NULL, []),
  ('trangnuocbiec.news.example', 0, ['*'], 2, '', '^$', NULL, []), ('greyholmcourier.example', 0, ['otherbot'], 2, '/', '^\Q/\E.*', NULL, []),
  ('greyholmcourier.example', 1, ['*'], 2, '/*/the-*-ferry', '^\Q/\E.+\Q/the-\E.+\Q-ferry\E.*', NULL, []), ('greyholmcourier.example', 1, ['*'], 2, '/science/*$', '^\Q/science/\E.+$', NULL, [])) t(host, group_id, agents, type, pattern, regex, delay, sitemaps)""",
        "robots_gate": r"SELECT * FROM (VALUES ('h0.example', '*', 2, '/x', '^\Q/x\E.*'), ('h1.example', '*', 2, '/y', '^\Q/y\E.*')) t(host, agents, type, pattern, regex)",
        "domain_create": f"SELECT domain, priority, active FROM domains UNION ALL SELECT h, 1, true FROM ({bootstrap})",
        "domain_delete": "SELECT domain FROM domains WHERE coalesce(active, false)",
        "crawl_closure": closure("SELECT unnest(seed_urls) AS url FROM domains WHERE coalesce(active, false)"),
        "crawl_closure_pages": closure("SELECT url FROM url_metadata"),
        "metadata_lookup": "SELECT id, url, status_code FROM url_metadata WHERE id = (SELECT min(id) FROM url_metadata)",
        # each flush is known from the one before: a recursion over a host's fetches in order
        "host_tracker": f"{flushes} SELECT host, make_timestamp(us) AS flushed_at, flushed::INT AS fetches FROM r WHERE flushed > 0",
        # for URLs as they stand in the table: no default ports, no dots in paths, nothing that is encoded
        "url_canonical": f"""WITH a AS (SELECT url, {_trim('url')} AS t FROM {u}), b AS (SELECT *, regexp_extract(t, '^([^#]*)', 1) AS s FROM a)
SELECT url, CASE WHEN regexp_matches(s, '^(?i)(https?|ftp|file|jar|mailto)://[^/?#]+') THEN lower(regexp_extract(s, '^([A-Za-z]+://[^/?#]+)', 1)) || coalesce(nullif(regexp_replace(replace(regexp_extract(s, '^[A-Za-z]+://[^/?#]+([^?]*)', 1), ' ', '%20'), '/+', '/', 'g'), ''), '/')
  || CASE WHEN s LIKE '%?_%' THEN replace(regexp_extract(s, '(\\?.*)$', 1), '/', '%2F') ELSE '' END END AS canonical FROM b""",
        "url_parts": f"""WITH a AS (SELECT url, {_trim('url')} AS t FROM {u}), b AS (SELECT *, CASE WHEN contains(t, '#') THEN regexp_extract(t, '#([\\s\\S]*)$', 1) END AS fragment, nullif(regexp_extract(t, '^(\\p{{L}}[\\p{{L}}\\p{{N}}_.+-]*):', 1), '') AS scheme, {rest} AS r FROM a),
c AS (SELECT *, CASE WHEN r LIKE '//%' THEN CASE WHEN contains(substr(r, 3), '/') THEN regexp_extract(r, '^//([^/]*)', 1) ELSE regexp_extract(r, '^//([^?;]*)', 1) END END AS location FROM b),
d AS (SELECT *, CASE WHEN location IS NULL THEN r ELSE substr(r, length(location) + 3) END AS p FROM c)
SELECT url, scheme, location, nullif(regexp_extract(p, '^([^?;]*)', 1), '') AS path, CASE WHEN regexp_matches(p, '^[^?]*;') THEN regexp_extract(p, '^[^?;]*;([^?]*)', 1) END AS parameters, CASE WHEN contains(p, '?') THEN regexp_extract(p, '\\?(.*)$', 1) END AS query, fragment FROM d""",
        "page_links": f"WITH {_PAGES}, {_links()} SELECT DISTINCT id, url FROM links",
        "nav_links": f"WITH {_PAGES}, {_links(_NAV)} SELECT DISTINCT id, url FROM navs",
        "header_links": f"""WITH {_PAGES}, {_links("'(?s)<header[ >].*?</header>'").replace('FROM sited)', "FROM sited WHERE regexp_matches(raw_html, '(?s)<header[^>]*(class|id)=[^>]*(nav|menu|header)|<header[ >].*(class|id)=[^>]*(nav|menu|header|main|primary|category|section).*</header>'))")} SELECT DISTINCT id, url FROM navs""",
        "sitemap_seeds": f"WITH {_PAGES}, {_links(_NAV)} SELECT id, {base} AS url FROM pages UNION SELECT id, regexp_replace(url, '/$', '') FROM navs WHERE {nav}",
        "new_links": f"{fresh} SELECT id, url FROM fresh",
        "extracted_total": f"{fresh} SELECT count(*) AS extracted FROM fresh",
        "link_frequency": f"""WITH {_PAGES}, every AS (SELECT id, base, md5(raw_html) AS page, {_full('h')} AS url FROM (SELECT *, unnest(regexp_extract_all(raw_html, {_HREF}, 1)) AS h FROM sited)),
n AS (SELECT id, base, page, regexp_replace(url, '/$', '') AS url, count(*) AS n FROM every WHERE {nav} GROUP BY ALL HAVING count(*) >= 2)
SELECT id, url, max(n) AS n FROM n WHERE length({_path('url')}) BETWEEN 2 AND 49 AND len(string_split(rtrim({_path('url')}, '/'), '/')) <= 3 GROUP BY id, url""",
        "p4_found": _instants(),
        "date_parse": f"SELECT id, timezone('UTC', {_date('publish_at')}) AS publish_at FROM contents",
        "search_keyword": f"WITH {dated}, {hits} SELECT id, url, timezone('UTC', moment) AS publish_at FROM hits ORDER BY moment DESC NULLS LAST, url, id LIMIT 5",
        "search_keyword_page": f"WITH {dated}, {hits} SELECT id, url, timezone('UTC', moment) AS publish_at FROM hits ORDER BY moment DESC NULLS LAST, url, id LIMIT 10 OFFSET 20",
        "search_blank": "SELECT id FROM contents WHERE false",
        "content_merge": f"""WITH v AS ({merge_valid}), o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY early DESC, received_at, id) AS first, row_number() OVER (PARTITION BY url ORDER BY early, received_at DESC, id DESC) AS last, bool_or(early) OVER (PARTITION BY url) AS stored FROM v)
SELECT f.id, l.url, l.title, md5(l.content) AS content_md5, NOT l.stored AS is_insert FROM o f JOIN o l ON f.url = l.url AND f.first = 1 AND l.last = 1""",
        "resolve_cases": """SELECT base, href, resolved, coalesce(same_site, resolved) AS same_site FROM (SELECT CASE WHEN href = 'x' THEN 'http://a.example' ELSE 'http://a.example/b/c/d;p?q' END AS base, href, resolved, same_site FROM (VALUES
  ('g', 'http://a.example/b/c/g', NULL), ('./g/', 'http://a.example/b/c/g/', NULL), ('/g', 'http://a.example/g', NULL), ('//g.example/h', 'http://g.example/h', NULL), ('?y', 'http://a.example/b/c/d;p?y', NULL), ('#s', 'http://a.example/b/c/d;p?q#s', NULL),
  ('../../g', 'http://a.example/g', NULL), (';x', 'http://a.example/b/c/d;x', NULL), ('https://o.example/z', 'https://o.example/z', 'http://a.example/b/c/d;p?q'), ('http://a.example/z', 'http://a.example/z', NULL), ('mailto:x@y', 'mailto:x@y', 'http://a.example/b/c/d;p?q'), ('x', 'http://a.example/x', NULL)) t(href, resolved, same_site))""",
        "canonical_cases": r"""SELECT * FROM (VALUES ('HTTP://H.Example:80/a//b/../c?b=2&a=1&b=3#f', 'http://h.example/a/c?b=3&a=1'), ('http://h.example?PHPSESSID=1&x=', 'http://h.example/?x'), ('http://h.example/%7Eme/a b', 'http://h.example/~me/a%20b'),
  ('http://h.example:8080/\x?q=a+b%20c*', 'http://h.example:8080/x?q=a%2Bb%20c%2A'), ('https://h.example:443/../x', 'https://h.example/x'), ('foo://h/x', NULL), ('x', NULL), ('http://h.example/a?=v&&k', 'http://h.example/a?=v&k')) t(url, canonical)""",
        "date_cases": """SELECT text, timezone('UTC', try_cast(instant AS TIMESTAMP)) AS instant FROM (VALUES ('17/02/2024 08:45 GMT+7', '2024-02-17 01:45:00'), ('2024-02-17T08:45:00Z', '2024-02-17 08:45:00'), ('2024-02-17T08:45:00-05:00', '2024-02-17 13:45:00'),
  ('2024-02-17T08:45:00.250+05:30', '2024-02-17 03:15:00.25'), ('17/02/2024 08:45', '2024-02-17 01:45:00'), ('17/02/2024', '2024-02-16 17:00:00'), ('Feb 17, 2024', '2024-02-16 17:00:00'), ('17 Feb 2024 08:45', '2024-02-17 01:45:00'), ('02/17/2024', '2024-02-16 17:00:00'),
  ('31/04/2024', NULL), ('4 days ago', '2026-01-11 00:00:00'), ('1 Hour ago', '2026-01-14 23:00:00'), ('90 minutes ago', '2026-01-14 22:30:00'), ('today', '2026-01-14 17:00:00'), ('Yesterday', '2026-01-13 17:00:00'), ('later', NULL), ('', NULL),
  ('2024/02/17 08:45:09', '2024-02-17 01:45:09'), ('17-02-2024 08:45', '2024-02-17 01:45:00'), ('posted on the page of the town of rivers and bridges and long roads beyond it 5 days ago', '2026-01-10 00:00:00')) t(text, instant)""",
        "reply_cases": "SELECT n::INT AS n, title, content, author, publish_at FROM (VALUES (0, 'h1.t', '.c', NULL, NULL), (1, 'h1', '#main', '.by', 'time'), (2, 'h1', '.content', '.author', '.date'), (3, 'h1', '.content', '.author', '.date')) t(n, title, content, author, publish_at)",
        "article_cases": "SELECT * FROM (VALUES ('1', 'T', 'C c', 'A', NULL::VARCHAR, true, true), ('2', 'T', 'M & m', NULL, NULL, false, true), ('3', 'T', NULL, NULL, NULL, true, false), ('4', NULL, NULL, NULL, NULL, true, false)) t(id, title, content, author, publish_at, is_default, parsed)",
        "sitemap_cases": "SELECT '4' AS id, kind, 'https://d.example/' || path AS url FROM (VALUES ('content', 'm1'), ('prominent', 'h1'), ('prominent', 'p1'), ('breadcrumb', 'b1')) t(kind, path)",
        "header_cases": "SELECT '4' AS id, 'https://d.example/h1' AS url",
        "frequency_cases": "SELECT '4' AS id, 'https://d.example/r1' AS url, 2::BIGINT AS n",
        "prompt_cases": f"SELECT id, domain, kept, true AS fits FROM ({kept})",
        "token_cases": f"SELECT id, (length(page) // 4)::BIGINT AS tokens_before, (length(kept) // 4)::BIGINT AS tokens_after, round((length(page) // 4 - length(kept) // 4) / (length(page) // 4)::DOUBLE * 100, 2) AS reduction, true AS fits FROM ({kept})",
        "parse_counter_cases": "SELECT * FROM (VALUES ('a.example', 1::BIGINT, 0::BIGINT), ('b.example', 1, 0), ('c.example', 0, 1), ('d.example', 0, 1)) t(host, parsed, failed)",
        "metric_samples": "SELECT event_type AS metric, NULL::VARCHAR AS label, date_trunc('second', ts)::TIMESTAMP AS ts, count(*) AS inc FROM events GROUP BY ALL",
        "metric_last": "SELECT event_type AS metric, NULL::VARCHAR AS label, count(*) AS value FROM events GROUP BY ALL",
        "metric_rate": f"""WITH {_SERIES}, g AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY metric ORDER BY ts), 0) AS grown, epoch(ts)::BIGINT AS s FROM series)
SELECT metric, ts::TIMESTAMP AS ts, round((sum(grown) OVER w - first_value(grown) OVER w) / 300.0, 6)::DOUBLE AS rate FROM g WINDOW w AS (PARTITION BY metric ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)""",
        "metric_topk": "SELECT event_type AS metric, user_id::VARCHAR AS label, count(*) AS value FROM events GROUP BY ALL ORDER BY value DESC, metric, label LIMIT 10",
        "metric_sum": "SELECT count(*) AS total FROM events",
        "token_reduction_models": "SELECT model, content, round((b - a) / nullif(b, 0) * 100, 2)::DOUBLE AS reduction FROM (VALUES ('small', 'a', 1000::DOUBLE, 80::DOUBLE), ('large', 'a', 1100, 90), ('small', 'b', 400, 190), ('large', 'b', 0, 0)) t(model, content, b, a)",
        "token_pivot": "SELECT * FROM (VALUES ('a', 80::BIGINT, 90::BIGINT), ('b', 190, 0)) t(content, small, large)",
        "model_matrix": "SELECT * FROM (VALUES ('a', 'title', 'h1', 'h1', 'h1.title'), ('a', 'author', '.author', '.by', '.author'), ('b', 'title', 'h1', NULL, 'h1')) t(content, field, expected, small, large)",
    }
