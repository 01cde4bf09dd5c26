"""Problem 5: variant spellings of names typed by people.

Every distinct string is read once: role words off, accents and case folded, parts split, nicknames replaced. Strings
with the same bag of parts are one profile from the start. Then profiles are merged and matched again until nothing
merges any more:

* A shortened string (initials, the first letters with a dot, a family name left out, the letters of an office) looks for
  the full profiles that can be shortened that way. If there is exactly one, or exactly one that writes for the same
  site, it joins it.
* A string with a part that hardly anybody else has, one typing error away from a part that many have, joins the profile
  that has that part instead.

A merged profile has the spellings, initials and sites of all its members and asks with all keys of its fullest
spellings, so it meets strings in the next round that none of its members would have met: the initials of a misspelt name,
a shortened form that only its new site decides. Rounds go on until none merges anything.

Matching is by equal keys and counts per key, so no block is ever compared all with all: a family name that a third of
the authors share costs its size. Only misspelt strings are compared one by one, with the profiles one deletion away.

Null, blank and placeholder names are nobody. Repeated rows count once. The result has strings as they are stored. Two
people of one name aren't told apart, as nothing in the field tells them apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from millrace.functions import urls
from millrace.llm import looks
from millrace.session import cut

#: Names up to so many parts are found by a form with two parts shortened, and by one with one part shortened; longer ones as a whole only.
PAIRED_PARTS, KEYED_PARTS = 12, 40
#: A part of no more bags than this may be misspelt however often its bag was written.
FEW_BAGS = 12
# Role words around names, placeholders, nicknames.
_BEFORE = re.compile(r"^(?:by|written by|text by|reporting by|story by|theo|pv|p\.v\.?|phóng viên|ctv|nhà báo|bài và ảnh|bài, ảnh|tin và ảnh|bài|ảnh|tin|nhóm pv|par|propos recueillis par|texte)\s*[:.]?\s+(?=\S)", re.I)
_AFTER = re.compile(r"\s*(?:[,–-]\s*(?:staff writer|staff reporter|staff|correspondent|reporter|editor|contributor|contributing writer|special correspondent|envoyée? spéciale?|phóng viên|tổng hợp)|\((?:tổng hợp|ghi|lược dịch|biên dịch|dịch|thực hiện|photos?|text|compiled)\))\s*$", re.I)
_NOBODY = frozenset("admin administrator editor user guest root webmaster unknown anonymous anon none null nan na n/a nil tba tbd test staff author updating khuyết danh|ẩn danh|đang cập nhật|không rõ".replace("|", " ").split()) | {"khuyết danh", "ẩn danh", "đang cập nhật", "không rõ", "n/a", "no author", "not available", "chưa rõ"}
NICKNAMES = {
    "al": "albert", "alex": "alexander", "sasha": "alexander", "andy": "andrew", "tony": "anthony", "ben": "benjamin", "cathy": "catherine", "charlie": "charles", "chuck": "charles", "chris": "christopher", "dan": "daniel", "danny": "daniel",
    "dave": "david", "debbie": "deborah", "don": "donald", "dot": "dorothy", "dottie": "dorothy", "ed": "edward", "eddie": "edward", "ted": "edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth",
    "frank": "francis", "fred": "frederick", "greg": "gregory", "harry": "henry", "jim": "james", "jimmy": "james", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "joe": "joseph", "johnny": "john", "jack": "john",
    "jo": "joanna", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "larry": "lawrence", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael",
    "nick": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip", "rick": "richard", "dick": "richard", "rich": "richard", "bob": "robert", "bobby": "robert", "rob": "robert",
    "ron": "ronald", "sam": "samuel", "steve": "stephen", "sue": "susan", "susie": "susan", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "walt": "walter", "will": "william", "bill": "william", "billy": "william",
}
_PART = re.compile(r"(?:[^\W\d_]\.)+(?:[^\W\d_]\b)?|[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")


def parts_of(author: str | None) -> list[str]:
    """Parts of a name in writing order, in lower case with accents; [] for nobody. Initials come one by one with a dot."""
    if author is None:
        return []
    s = " ".join(looks.form(author).split())
    for _ in range(2):
        s = _AFTER.sub("", _BEFORE.sub("", s)).strip()
    if s.lower() in _NOBODY or not any(c.isalpha() for c in s):
        return []
    out: list[str] = []
    for p in _PART.findall(s):
        if p.count(".") and len(p.rstrip(".").replace(".", "")) == p.rstrip(".").count(".") + 1:
            out += [c + "." for c in p.lower() if c.isalpha()]
        else:
            out.append(p.lower().replace("’", "'"))
    return [] if len(out) == 1 and out[0].rstrip(".") in _NOBODY else out


def read(author: str | None) -> dict | None:
    """What is known from one string: ``bag`` (its identity), ``full`` keys by which shortened strings find it, ``part`` keys (in order of trust) by which it looks for full ones; None for nobody."""
    accented = parts_of(author)
    if not accented:
        return None
    folded = [looks.unaccented(p) for p in accented]
    initials = [p[0] for p in folded if len(p) == 2 and p[1] == "."]
    heads = [p for p in folded if len(p) > 2 and p.endswith(".")]
    # an initial between two names only adds to them
    named = [k for k, p in enumerate(folded) if not p.endswith(".")]
    inner = [k for k, p in enumerate(folded) if len(p) == 2 and p[1] == "." and named and named[0] < k < named[-1]]
    if len(named) >= 2 and inner:
        initials = [p[0] for k, p in enumerate(folded) if len(p) == 2 and p[1] == "." and k not in inner]
    whole = [folded[k] for k in named]
    canon = [NICKNAMES.get(p, p) for p in whole]
    full_accents = [accented[k] for k in named]
    rest = " ".join(sorted(canon))
    letters = [p for k, p in enumerate(_PART.findall(" ".join(looks.form(author).split()))) if p.isupper() and 2 <= len(p) <= 5] if len(whole) == 2 else []
    full: set[str] = set()
    part: list[str] = []
    if initials or heads:
        name = f"{rest}|{''.join(sorted(initials))}|{' '.join(sorted(heads))}"
        part.append(name)
        if len(initials) > 1 and not heads and len(whole) == 1 and named[0] == 0:
            part.append(f"{rest}|{initials[0]}|")
    elif len(whole) >= 2:
        name = rest
        if len(whole) <= KEYED_PARTS:
            for n in (1, 2) if len(whole) <= PAIRED_PARTS else (1,):
                for short in combinations(range(len(canon)), n):
                    if len(canon) - n >= 1:
                        for spelling in {tuple(canon), tuple(whole)}:
                            kept = " ".join(sorted(canon[k] for k in range(len(canon)) if k not in short))
                            full.add(f"{kept}|{''.join(sorted(spelling[k][0] for k in short))}|")
            for k in range(len(canon)):
                if len(canon[k]) > 3:
                    full.add(f"{' '.join(sorted(canon[:k] + canon[k + 1:]))}||{canon[k][:3]}.")
            if inner:
                extra = "".join(folded[k][0] for k in inner)
                for k in range(len(canon)):
                    full.add(f"{' '.join(sorted(canon[:k] + canon[k + 1:]))}|{''.join(sorted(canon[k][0] + extra))}|")
        if len(whole) == 3:
            full.add("tail " + " ".join(canon[1:]))
        if len(whole) >= 3:
            for k in (0, len(whole) - 1):
                short = "".join(w[0] for j, w in enumerate(whole) if j != k)
                full.add(f"office {short} {whole[k]}")
        if len(whole) == 2:
            part.append("tail " + " ".join(canon))
            for k in (0, 1):
                if letters and looks.unaccented(letters[0]) == whole[k]:
                    part.append(f"office {whole[k]} {whole[1 - k]}")
    elif whole:
        name = rest
    else:
        name = "||" + "".join(initials)
    return {"bag": name, "complete": not (initials or heads) and len(whole) >= 2, "tokens": sorted(canon) if not (initials or heads) else [], "accents": " ".join(sorted(full_accents)), "full": sorted(full), "part": part}


_READ = "author string, bag string, complete boolean, tokens array<string>, accents string, full array<string>, part array<string>"


def _read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(a, *r.values()) for a in b["author"] if (r := read(a)) is not None]
        yield pd.DataFrame(rows, columns=["author", "bag", "complete", "tokens", "accents", "full", "part"])


def one_error(a: str, b: str) -> bool:
    """Equal but for one letter left out, added or changed, or two neighbours swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[k + 1 :] == short[k:]


def _holes(bags: pd.DataFrame) -> list[tuple]:
    """(bag id, part, key) for each part of a bag: the other parts and the part with at most one letter left out."""
    out = []
    for ident, tokens in zip(bags["cid"], bags["tokens"]):
        tokens = list(tokens)
        for k, t in enumerate(tokens):
            others = " ".join(tokens[:k] + tokens[k + 1 :])
            out += [(ident, t, f"{others}|{v}") for v in {t, *(t[:j] + t[j + 1 :] for j in range(len(t)))}]
    return out


def _join(a: DataFrame, b: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Both sides grow with the number of names, so neither is broadcast."""
    return a.join(b.hint("merge"), on, how)


def profiles(contents: DataFrame) -> DataFrame:
    """(author, entity, name): each author string in use that names somebody, with the number of its journalist or newsroom and the spelling of it that is used most."""
    used = cut(contents.where("author is not null").groupBy("author", urls.site(F.col("url")).alias("site")).agg(F.count("*").alias("n")))
    records = used.select("author").distinct().mapInPandas(_read_all, _READ)
    records = cut(records.withColumn("bag_id", F.xxhash64("bag")))
    asked = F.transform("part", lambda key, trust: F.struct(trust.alias("trust"), key.alias("key")))
    bags = cut(
        records.groupBy("bag_id").agg(
            F.bool_or("complete").alias("complete"), F.first("tokens").alias("tokens"), F.count("*").alias("strings"),
            F.array_distinct(F.flatten(F.collect_set("full"))).alias("full"), F.array_distinct(F.flatten(F.collect_set(asked))).alias("part"), F.max("accents").alias("accents"),
        )
    )
    state = cut(bags.select("bag_id", F.col("bag_id").alias("cid")))
    bag_sites = cut(_join(records.select("author", "bag_id"), used.where("site is not null"), "author").groupBy("bag_id", "site").agg(F.sum("n").alias("n")))
    typing = cut(_typing_errors(bags, bag_sites))
    while True:
        links = cut(_links(bags, bag_sites, typing, state))
        if links.isEmpty():
            break
        # each round merges one profile at least, so this ends
        state = cut(_join(state, links, "cid", "left").select("bag_id", F.coalesce("to", "cid").alias("cid")))
    named = _join(_join(records.select("author", "bag_id"), state, "bag_id"), used.groupBy("author").agg(F.sum("n").alias("n")), "author")
    named = cut(named.select("author", F.col("cid").alias("entity"), "n"))
    best = named.groupBy("entity").agg(F.min(F.struct((-F.col("n")).alias("n"), "author")).alias("b")).select("entity", F.col("b.author").alias("name"))
    return _join(named.select("author", "entity"), best, "entity").select("author", "entity", "name")


def _typing_errors(bags: DataFrame, bag_sites: DataFrame) -> DataFrame:
    """(bag_id, right): bags with a misspelt part, and the one bag that has it right."""
    parts = bags.where("complete").select("bag_id", "strings", F.explode(F.array_distinct("tokens")).alias("token"))
    support = parts.groupBy("token").agg(F.count("*").alias("support"))
    schema = "cid long, token string, key string"

    def holes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(_holes(b), columns=["cid", "token", "key"])

    keyed = bags.where("complete").select(F.col("bag_id").alias("cid"), "tokens").mapInPandas(holes, schema)
    keyed = cut(_join(keyed, support, "token"))
    rows = bag_sites.groupBy(F.col("bag_id").alias("cid")).agg(F.sum("n").alias("rows"))
    more = _join(bags.select(F.col("bag_id").alias("cid"), "strings", "accents"), rows, "cid", "left").fillna(0, ["rows"])
    wrong = cut(_join(keyed, more, "cid").select("cid", "token", "key", "support", "strings", "rows", "accents"))
    right = wrong.select(F.col("cid").alias("right"), F.col("token").alias("right_token"), "key", *[F.col(c).alias(f"right_{c}") for c in ("support", "strings", "rows", "accents")])
    # a hole is shared by few bags: those whose other parts are equal and whose last one is a letter away
    pairs = _join(wrong, right, "key").where((F.col("cid") != F.col("right")) & _likelier()).dropDuplicates(["cid", "right"])

    @F.pandas_udf(IntegerType())
    def closeness(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        """0: one error with their accents, 1: one error where one of them has no accents, 2: more."""
        return pd.Series([_closeness(*v) for v in zip(a, b, x, y)], dtype="int32")

    pairs = cut(pairs.withColumn("far", closeness("token", "right_token", "accents", "right_accents")).where("far < 2"))
    shared = _join(_join(pairs.select("cid", "right"), bag_sites.withColumnRenamed("bag_id", "cid"), "cid"), bag_sites.select(F.col("bag_id").alias("right"), "site", F.col("n").alias("m")), ["right", "site"])
    shared = shared.groupBy("cid", "right").agg(F.sum(F.least("n", "m")).alias("shared"))
    ranked = _join(pairs, shared, ["cid", "right"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    # a common part in an otherwise unknown spelling, an accent's difference away from a well-known one of the same site
    slip = (F.col("far") == 0) & (F.col("shared") > 0)
    ranked = ranked.where(_plainly_likelier() | slip)
    # of each misspelt bag the one right spelling, found by aggregation
    first = F.min(F.struct((F.col("shared") == 0).cast("int").alias("a"), "far", (-F.col("right_support")).alias("b"), (-F.col("shared")).alias("c"), "right")).alias("first")
    return ranked.groupBy("cid").agg(first).select(F.col("cid").alias("bag_id"), F.col("first.right").alias("right"))


def _plainly_likelier() -> Column:
    """Whether the other part of a pair is so much more in use that this one is its misspelling: four times as many bags, or more than a part of two bags has."""
    rare = (F.col("support") <= 2) & (F.struct("right_support", "right_strings", "right_rows") > F.struct("support", "strings", "rows"))
    return (F.col("right_support") >= 4 * F.col("support")) | rare


def _likelier() -> Column:
    """The pairs that are looked at: the part is in few bags, or its bag was written in one way only or in far fewer ways than the other; and the other is plainly likelier, or at least written in three ways."""
    suspect = (F.col("support") <= FEW_BAGS) | (F.col("strings") == 1) | (F.col("right_strings") >= 4 * F.col("strings"))
    return suspect & (_plainly_likelier() | (F.col("strings") == 1) & (F.col("right_strings") >= 3))


def _closeness(a: str, b: str, p: str, q: str) -> int:
    if not one_error(a, b):
        return 2
    if p.isascii() or q.isascii():
        return 1
    x, y = (Counter(unicodedata.normalize("NFC", t).split()) for t in (p, q))
    more, less = list((x - y).elements()), list((y - x).elements())
    return 0 if len(more) == len(less) == 1 and one_error(more[0], less[0]) else 2


def _links(bags: DataFrame, bag_sites: DataFrame, typing: DataFrame, state: DataFrame) -> DataFrame:
    """(cid, to): profiles that join another one in this round; none of those that are joined moves itself."""
    known = _join(bags, state, "bag_id").withColumn("parts", F.when(F.col("complete"), F.size("tokens")).otherwise(0))
    full = known.where("complete").select("cid", F.explode("full").alias("key")).distinct()
    sites = _join(bag_sites, state, "bag_id").groupBy("cid", "site").agg(F.sum("n").alias("n"))
    # a profile asks with the keys of all its spellings that are as full as its fullest; a shorter one was answered when it joined
    most = known.groupBy("cid").agg(F.max("parts").alias("most"))
    asking = _join(known.where(F.size("part") > 0), most, "cid").where("parts = most").select("cid", F.explode("part").alias("p")).select("cid", "p.trust", "p.key").distinct()
    counts = full.groupBy("key").agg(F.count_distinct("cid").alias("n"), F.min("cid").alias("to"))
    found = cut(_join(asking, counts, "key"))
    alone = found.where("n = 1").select("cid", "trust", F.lit(0).alias("way"), "to", F.lit(0).cast("long").alias("weight"))
    crowded = found.where("n > 1").select("cid", "trust", "key")
    by_site = _join(_join(full, crowded.select("key").distinct(), "key"), sites, "cid").groupBy("key", "site").agg(F.count_distinct("cid").alias("n"), F.min("cid").alias("to"), F.sum("n").alias("rows"))
    local = _join(_join(crowded, sites.withColumnRenamed("n", "own"), "cid"), by_site.where("n = 1"), ["key", "site"]).select("cid", "trust", F.lit(1).alias("way"), "to", F.least("own", "rows").alias("weight"))
    typed = _join(_join(typing, state, "bag_id").select("cid", "right"), state.select(F.col("bag_id").alias("right"), F.col("cid").alias("to")), "right")
    typed = typed.select("cid", F.lit(0).alias("trust"), F.lit(-1).alias("way"), "to", F.lit(0).cast("long").alias("weight"))
    offers = alone.unionByName(local).unionByName(typed).where("cid != to")
    best = cut(offers.groupBy("cid").agg(F.min(F.struct("way", "trust", (-F.col("weight")).alias("w"), "to")).alias("b")).select("cid", F.col("b.to").alias("to")))
    # no circles: who is to be joined itself only joins a smaller number; then only those that stay are joined
    joined = best.select(F.col("to").alias("cid"), F.lit(True).alias("joined")).distinct()
    ordered = _join(best, joined, "cid", "left").where(F.col("joined").isNull() | (F.col("cid") > F.col("to"))).select("cid", "to")
    return _join(ordered, ordered.select(F.col("cid").alias("to")), "to", "left_anti").select("cid", "to")


def same_name_pairs(contents: DataFrame) -> DataFrame:
    """(author_a, author_b): different strings that name the same person or newsroom, author_a < author_b; as many as its spellings give, where profiles() gives one row a spelling."""
    p = cut(profiles(contents))
    a, b = p.select(F.col("author").alias("author_a"), "entity"), p.select(F.col("author").alias("author_b"), "entity")
    return _join(a, b, "entity").where("author_a < author_b").select("author_a", "author_b")
