"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import abuse, frequent_lines, looks, main_body, membership, mixing, names, neighbours, packing
from millrace.sources.tables import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def t(f: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, d: f(*[table(spark, d, name) for name in tables])

    return {
        "p1_found": t(lambda tasks, known: membership.seen_before(tasks, known).where("seen").select("task_id"), "new_url_tasks", "url_metadata"),
        "p1_error_rates": t(membership.error_rates, "new_url_tasks", "url_metadata"),
        "p2_found": t(frequent_lines.frequent_positions, "contents"),
        "p2_cleaned": t(lambda c: frequent_lines.without_frequent_lines(c).select("id", "content", "lines_removed"), "contents"),
        "p3_found": t(main_body.main_paragraphs, "url_metadata", "contents"),
        "p3_paragraphs": t(lambda p, c: main_body.main_paragraphs(p, c, with_text=True), "url_metadata", "contents"),
        "p3_texts": t(main_body.main_texts, "url_metadata"),
        "p5_found": t(names.same_name_pairs, "contents"),
        "p5_entities": t(names.profiles, "contents"),
        "p6_found": t(looks.changed_fields, "contents"),
        "p6_forms": t(looks.normal_forms, "contents"),
        "p7_found": t(neighbours.similar_pairs, "contents"),
        "p7_recall": t(neighbours.recall, "contents"),
        "p8_packing": t(packing.pack, "documents", "container_sizes"),
        "p8_rooms": t(lambda d, c: packing.rooms(packing.pack(d, c)), "documents", "container_sizes"),
        "p9_documents": t(lambda d, m: mixing.repeats(mixing.draw(d, m)), "documents", "mix_targets"),
        "p9_stream": t(mixing.draw, "documents", "mix_targets"),
        "p9_shares": t(lambda d, m: mixing.shares(mixing.draw(d, m), m), "documents", "mix_targets"),
        "p10_found": t(abuse.marked, "documents", "abuse_labels"),
        "p10_scores": t(lambda d, a: abuse.scores(d, a).select("doc_id", F.round("score", 6).alias("score"), "label"), "documents", "abuse_labels"),
        "p10_rates": t(abuse.rates, "documents", "abuse_labels"),
    }


_NORMAL = r"""
CASE WHEN url IS NULL OR length(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) = 0 THEN NULL ELSE
  (SELECT CASE WHEN regexp_matches(s, '^https?://') THEN s ELSE 'http://' || s END FROM (SELECT CASE WHEN length(l) > 1 AND l LIKE '%/' AND NOT regexp_full_match(l, 'https?://[^/]+/') THEN left(l, length(l) - 1) ELSE l END AS s
   FROM (SELECT lower(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS l))) END
"""


# Fixed values, written out here once more, so that an error in the code under test shows: what is taken for ordinary text.
_LIKE = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "ԼᏞ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "Ꮩ", "W": "ԜᏔ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аα", "c": "с", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "t": "τ", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уү",
}
_LIKE_FROM, _LIKE_TO = "".join(_LIKE.values()), "".join(k * len(v) for k, v in _LIKE.items())
_HIDDEN = r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff0}-\x{fff8}\x{1bca0}-\x{1bca3}\x{1d173}-\x{1d17a}\x{e0000}-\x{e0fff}"
_BLANK = r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
_FULL_WIDTH = r"\x{ff01}-\x{ff5e}\x{ffe0}-\x{ffe6}"
_STYLES = r"\x{fb00}-\x{fb06}\x{fe50}-\x{fe6b}\x{1d400}-\x{1d7ff}\x{210a}-\x{2113}\x{2115}\x{2118}-\x{211d}\x{2124}\x{2128}\x{212c}\x{212d}\x{212f}-\x{2134}\x{2139}\x{2145}-\x{2149}\x{1c4}-\x{1cc}\x{132}\x{133}\x{2024}\x{2025}"
_SYMBOL = r"[\p{So}\p{Sk}\p{Sm}#*0-9\x{203c}\x{2049}\x{1f1e6}-\x{1f3ff}\x{20e3}]"


def _bare_of_emoji(x: str) -> str:
    """Text without the invisible characters that belong to emoji, keycaps, flags and scripts that join letters."""
    x = f"regexp_replace({x}, '([0-9#*])\\x{{fe0f}}(\\x{{20e3}})', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '([\\p{{So}}\\p{{Sk}}\\p{{Sm}}\\x{{203c}}\\x{{2049}}\\x{{1f1e6}}-\\x{{1f3ff}}])[\\x{{fe0e}}\\x{{fe0f}}]', '\\1', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '({_SYMBOL})\\x{{200d}}({_SYMBOL})', '\\1\\2', 'g')"
        x = f"regexp_replace({x}, '([\\x{{600}}-\\x{{8ff}}\\x{{900}}-\\x{{dff}}\\x{{f00}}-\\x{{109f}}\\x{{1780}}-\\x{{17ff}}])[\\x{{200c}}\\x{{200d}}]([\\x{{600}}-\\x{{8ff}}\\x{{900}}-\\x{{dff}}\\x{{f00}}-\\x{{109f}}\\x{{1780}}-\\x{{17ff}}])', '\\1\\2', 'g')"
    return f"regexp_replace({x}, '\\x{{1f3f4}}[\\x{{e0020}}-\\x{{e007f}}]+', '', 'g')"


def _disguised(x: str) -> str:
    latin = r"A-Za-z\x{c0}-\x{24f}\x{1e00}-\x{1eff}"
    mixed = rf"[{latin}][\p{{L}}\x{{300}}-\x{{36f}}]*[{_LIKE_FROM}]|[{_LIKE_FROM}][\p{{L}}\x{{300}}-\x{{36f}}]*[{latin}]"
    return f"(nfc_normalize({x}) <> {x} OR regexp_matches({x}, '[{_FULL_WIDTH}{_STYLES}{_BLANK}ɡɑƉ]') OR regexp_matches({_bare_of_emoji(x)}, '[{_HIDDEN}]') OR (contains({x}, 'Ð') AND NOT regexp_matches({x}, '[ðþÞ]')) OR regexp_matches(nfc_normalize({x}), '{mixed}'))"


_SITE = r"nullif(lower(regexp_extract(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '')"


def _line_keys() -> str:
    """CTEs up to ``hit``: lines of contents whose key is frequent on their site. Styled letters go by the order of their blocks."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    chars = lambda first, n: f"array_to_string(list_transform(range({n}), lambda i: chr(({first} + i)::INT)), '')"
    x = f"regexp_replace(content, '[{_HIDDEN}]', '', 'g')"
    for ligature, plain in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬆ", "st")):
        x = f"replace({x}, '{ligature}', '{plain}')"
    x = f"translate({x}, {chars(0xFF01, 94)}, {chars(0x21, 94)})"
    x = f"translate({x}, {chars(0x1D400, 676)}, repeat('{letters}', 13))"
    x = f"translate({x}, {chars(0x1D7CE, 50)}, repeat('0123456789', 5))"
    x = f"translate({x}, 'ɡɑƉÐℎℊℯℴ{_LIKE_FROM}', 'gaĐĐhgeo{_LIKE_TO}')"
    x = f"nfc_normalize({x})"
    key = rf"regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}\n]+', '', 'g'), '\p{{N}}+', '0', 'g')"
    return f"""
WITH c AS (SELECT row_number() OVER () AS r, id, {_SITE} AS site, content, string_split({key}, chr(10)) AS keys, string_split(content, chr(10)) AS texts FROM contents WHERE content IS NOT NULL),
l AS (SELECT r, id, site, unnest(keys) AS k, unnest(texts) AS line, generate_subscripts(keys, 1) AS n FROM c),
f AS (SELECT site, k, count(DISTINCT r) AS m FROM l WHERE k <> '' AND site IS NOT NULL GROUP BY ALL), s AS (SELECT site, count(*) AS rows FROM c GROUP BY site),
hit AS (SELECT l.r, l.id, l.n FROM l JOIN f ON f.site = l.site AND f.k = l.k JOIN s ON s.site = l.site WHERE f.m >= 5 AND f.m * 10 >= s.rows)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{_line_keys()} SELECT DISTINCT id, n::INT AS line_no FROM hit",
        "p2_cleaned": f"""{_line_keys()}
SELECT any_value(l.id) AS id, coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (hit.n IS NULL), '') AS content, count(hit.n)::INT AS lines_removed FROM l LEFT JOIN hit ON hit.r = l.r AND hit.n = l.n GROUP BY l.r""",
        "p6_found": f"SELECT DISTINCT id, 'title' AS field FROM contents WHERE {_disguised('title')} UNION SELECT DISTINCT id, 'content' FROM contents WHERE {_disguised('content')}",
        "p1_found": f"""
WITH t AS (SELECT task_id, {_NORMAL} AS u FROM new_url_tasks), k AS (SELECT DISTINCT {_NORMAL} AS u FROM url_metadata),
     f AS (SELECT u, min(task_id) AS first FROM t WHERE u IS NOT NULL GROUP BY u)
SELECT t.task_id FROM t JOIN f USING (u) WHERE t.task_id > f.first OR t.u IN (SELECT u FROM k WHERE u IS NOT NULL)
""",
        "p7_found": """
WITH v AS (SELECT id, content_embedding::DOUBLE[768] AS v FROM (SELECT DISTINCT id, content_embedding FROM contents
             WHERE len(content_embedding) = 768 AND len(list_filter(content_embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
               AND len(list_filter(content_embedding, lambda x: x <> 0)) > 0)),
     p AS (SELECT a.id AS a, b.id AS b, round(array_cosine_similarity(a.v, b.v), 12) AS s FROM v a JOIN v b ON a.id <> b.id),
     r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n, s FROM p)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 5 AND s >= 0.7
""",
    }
