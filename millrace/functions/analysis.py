"""Text analysis and vectors of the content search, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the letters that they are folded to.
_FOLDED = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåā", "e": "èéẻẽẹêềếểễệëēę", "i": "ìíỉĩịïîī", "o": "òóỏõọôồốổỗộơờớởỡợöøō", "u": "ùúủũụưừứửữựüûū", "y": "ỳýỷỹỵÿ", "d": "đ", "c": "çćč", "n": "ñń", "s": "śš", "z": "źżž", "l": "ł",
}
_FROM = "".join(_FOLDED.values())
_TO = "".join(k * len(v) for k, v in _FOLDED.items())
EMBED_CHARS = 8000


def analysed(text: Column) -> Column:
    """Lower case, accents off, words with single blanks between and around; null for null."""
    bare = F.translate(F.lower(text), _FROM, _TO)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` stand in ``text`` one behind the other; false for null and for a phrase without words."""
    p = analysed(phrase)
    return F.coalesce(F.contains(analysed(text), p) & (F.trim(p) != ""), F.lit(False))


def embedding_text(title: Column, content: Column) -> Column:
    """What is embedded of an article: trimmed title, a blank, the first characters of the trimmed content; blank parts are left out."""
    parts = [F.nullif(F.trim(title), F.lit("")), F.nullif(F.substring(F.trim(content), 1, EMBED_CHARS), F.lit(""))]
    return F.concat_ws(" ", *parts)
