"""Problem 6: one consistent form for text that looks the same.

Two forms of each value. ``form`` is the text for readers: composed (NFC), with disguised characters replaced by those
they are taken for (full-width and mathematical letters, ligatures, look-alikes of Latin letters inside Latin words,
blanks other than the plain one) and invisible characters gone; what a reader tells apart stays (typographic quotes and
dashes, superscripts, unit and number signs, emoji with their joiners, words wholly of another script). ``key`` is for
comparison: the compatibility composed form of ``form``, fully case-folded, blanks made one, default-ignorable characters
removed. A field had to change if its form differs from it.

Each distinct value of a batch is worked on once; plain ASCII is passed through. Null gives null and isn't changed; ''
stays ''. Repeated rows give the same result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Letters of other scripts that look like Latin ones.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԛԜаеѕіјкорсухԁһԛԝӀӏү"
_CYRILLIC_AS = "ABESIJKMHOPCTYXYGqWaesijkopcyxdhqwIly"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχ"
_GREEK_AS = "ABEZHIKMNOPTYXaikvoptux"
_ARMENIAN, _ARMENIAN_AS = "ՍՏՕԼօսհոցզ", "USOLouhngq"
_CHEROKEE, _CHEROKEE_AS = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPSTVWZ"
#: Latin letters of other uses that are taken for plain ones wherever they stand.
_LATIN, _LATIN_AS = "ɡɑƉ", "gaĐ"
LOOKALIKES = dict(zip(map(ord, _CYRILLIC + _GREEK + _ARMENIAN + _CHEROKEE), _CYRILLIC_AS + _GREEK_AS + _ARMENIAN_AS + _CHEROKEE_AS, strict=True))

#: Disguised wherever they stand, as ranges for a regular expression: full-width and small forms, ligatures and digraphs,
#: mathematical and other styled letters, dot leaders. Their compatibility form is ordinary text.
_STYLED = "！-～￠-￦ﬀ-ﬆ﹐-﹫\U0001d400-\U0001d7ffℊ-ℓℕ℘-ℝℤℨℬℭℯ-ℴℹⅅ-ⅉǄ-ǌĲĳ․‥"
#: Default-ignorable characters.
_IGNORED = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
_SPACES = "   -   　"
_MARKS = "̀-ͯ"
_OTHER = "Ͱ-ϿЀ-ԯԱ-֏Ꭰ-Ᏽ"
#: Any character for which the form of a text may differ from it, for texts of Latin script.
SUSPECT = f"[{_STYLED}{_IGNORED}{_SPACES}{_MARKS}{_OTHER}{_LATIN}Ð]"

_SUSPECT = re.compile(SUSPECT)
_STYLED_RUN = re.compile(f"[{_STYLED}]+")
_SPACE = re.compile(f"[{_SPACES}]")
_INVISIBLE = re.compile(f"[{_IGNORED}]+")
_FOREIGN = re.compile(f"[{_OTHER}]")
_WORDS = re.compile(f"(?:[^\\W\\d_][{_MARKS}]*)+")
_PLAIN = re.compile("[A-Za-zÀ-ɏḀ-ỿ]")
#: Letters whose presence makes a capital eth an ordinary one.
_ETH_OR_THORN = re.compile("[ðþÞ]")
_BLANKS = re.compile(r"\s+")
_LATIN_TABLE = dict(zip(map(ord, _LATIN), _LATIN_AS, strict=True))
#: Scripts whose spelling needs joiners.
_JOINING = re.compile("[؀-ࣿऀ-෿ༀ-႟ក-᯿]")
_JOINER, _NON_JOINER, _SELECTORS, _KEYCAP, _FLAG = "‍", "‌", "︎️", "⃣", "\U0001f3f4"


def _is_symbol(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk", "Sm") or c in "#*0123456789‼⁉" or "\U0001f1e6" <= c <= "\U0001f3ff" or c == _KEYCAP


def _kept(text: str, m: re.Match[str]) -> str:
    """Of a run of invisible characters, those that belong to an emoji or to a script that needs them."""
    before, after, run = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1], m[0]
    if not before:
        return ""
    if _is_symbol(before):
        joins = _JOINER if after and _is_symbol(after) else ""
        if run[0] in _SELECTORS and (before not in "0123456789#*" or after == _KEYCAP):
            return run[0] + (joins if run[1:2] == _JOINER else "")
        if run[0] == _JOINER:
            return joins
        if before == _FLAG and all("\U000e0020" <= c <= "\U000e007f" for c in run):
            return run
    return run if run in (_JOINER, _NON_JOINER) and after and _JOINING.match(before) and _JOINING.match(after) else ""


def form(text: str) -> str:
    """The form of a text for readers; the text itself if nothing in it is disguised."""
    if text.isascii():
        return text
    if not _SUSPECT.search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    out = _INVISIBLE.sub(lambda m: _kept(text, m), text)
    out = _STYLED_RUN.sub(lambda m: unicodedata.normalize("NFKC", m[0]), out)
    out = _SPACE.sub(" ", out).translate(_LATIN_TABLE)
    if "Ð" in out and not _ETH_OR_THORN.search(out):
        out = out.replace("Ð", "Đ")
    out = unicodedata.normalize("NFC", out)
    if _FOREIGN.search(out):
        mixed = [m for m in _WORDS.finditer(out) if _FOREIGN.search(m[0])]
        if any(_PLAIN.search(m[0]) for m in mixed):
            # in a text with disguised words, a word of look-alikes only is disguised as well
            parts, at = [], 0
            for m in mixed:
                bare = unicodedata.normalize("NFD", m[0])
                if _PLAIN.search(bare) or all(ord(c) in LOOKALIKES or unicodedata.combining(c) for c in bare) and _neighbour_latin(out, m):
                    parts += [out[at : m.start()], bare.translate(LOOKALIKES)]
                    at = m.end()
            out = unicodedata.normalize("NFC", "".join(parts) + out[at:])
    return out


def plain(text: str) -> str:
    """The form in which all look-alikes are Latin letters, whatever the script of their word: for comparing, not for reading."""
    out = form(text)
    if _FOREIGN.search(out):
        out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", out).translate(LOOKALIKES))
    return out


def _neighbour_latin(text: str, m: re.Match[str]) -> bool:
    return bool(_PLAIN.search(text[max(0, m.start() - 12) : m.start()]) or _PLAIN.search(text[m.end() : m.end() + 12]))


def _compatible(text: str) -> str:
    # most texts are in that form, and asking is cheaper than making it
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def key(text: str) -> str:
    """The form for comparison."""
    if text.isascii():
        return _BLANKS.sub(" ", text.casefold()).strip()
    out = _compatible(_compatible(_INVISIBLE.sub("", form(text))).casefold())
    return _BLANKS.sub(" ", out).strip()


def unaccented(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("ð", "d")) if not unicodedata.combining(c))


def per_distinct(values: pd.Series, f: Callable[[str], object]) -> pd.Series:
    """``f`` of each value, worked out once for each distinct one; null for null."""
    known: dict[str, object] = {}

    def one(v: str | None) -> object:
        if v is None:
            return None
        if v not in known:
            known[v] = f(v)
        return known[v]

    return pd.Series([one(v) for v in values], index=values.index, dtype=object)


@F.pandas_udf(StringType())
def form_udf(values: pd.Series) -> pd.Series:
    return per_distinct(values, form)


@F.pandas_udf(StringType())
def plain_udf(values: pd.Series) -> pd.Series:
    return per_distinct(values, plain)


@F.pandas_udf(StringType())
def key_udf(values: pd.Series) -> pd.Series:
    return per_distinct(values, key)


@F.pandas_udf(BooleanType())
def changes_udf(values: pd.Series) -> pd.Series:
    return per_distinct(values, lambda v: form(v) != v)


_OUTPUTS = {"form": form_udf, "key": key_udf, "changed": changes_udf}


def normal_forms(df: DataFrame, fields: Sequence[str] = ("title", "content"), outputs: Sequence[str] = ("form", "key", "changed")) -> DataFrame:
    """(id, field, then ``outputs``): a row for each id and field; ``changed`` is false for null."""
    parts = []
    for f in fields:
        cols = [F.coalesce(_OUTPUTS[o](F.col(f)), F.lit(False)).alias(o) if o == "changed" else _OUTPUTS[o](F.col(f)).alias(o) for o in outputs]
        parts.append(F.struct(F.lit(f).alias("field"), *cols))
    return df.select("id", F.explode(F.array(*parts)).alias("f")).select("id", "f.*")


def changed_fields(df: DataFrame, fields: Sequence[str] = ("title", "content")) -> DataFrame:
    """(id, field): fields that had to change."""
    return normal_forms(df, fields, ("changed",)).where("changed").select("id", "field").distinct()
