"""Problem 3: the main body of each page, from its HTML and from stored text in which parts of the page were left.

Layout: a tolerant tree with implied tags and visibility rules is rendered to lines, each a visible block with its place
in lists and tables (functions/htmltree.layout). The headline (h1, or the line that repeats the page's title) fixes the
article: its body starts at the first line of prose behind it and ends with the container that holds this line. Inside,
asides, captions, bylines and lines whose class is not that of the prose are left out. What is kept is given as
paragraphs, or written as text (main_texts) with the spacing of blocks, the marks of lists and the columns of tables.

Wording: what a layout cannot tell (a site notice between two line breaks, a stored text without tags) is decided by a
line model. It is trained from the layouts of all fetched pages: blocks inside bodies against blocks of menus, footers,
comments, share bars, bylines and pointers. Its evidence is words and word pairs with digits masked and the site's own
name masked. Lines and features are counted on the executors, over all pages. The model has all features seen more than
once, however many: the weights of the MODEL_FEATURES seen most are broadcast, those of the rarer ones are joined to the
rows that have them.

Results, also for odd input: null, empty or unparsable HTML, pages without a headline or prose give no row; a null text
gives no row; repeated rows give their paragraphs once per id. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from math import sqrt

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import htmltree
from millrace.functions.htmltree import Block, Line, Node
from millrace.llm import looks
from millrace.operators.joins import lookup_join
from millrace.session import cut

#: A line is left out when the evidence against it, per square root of its features, exceeds this.
THRESHOLD = 0.0
#: The same for blocks that the layout has inside the body.
PAGE_THRESHOLD = 0.6
#: Log odds at which an opening ("See also:", ">>") decides alone.
OPENING = 2.5
#: Features of the line model that are broadcast, about; the others are joined, so results don't depend on it.
MODEL_FEATURES = 1_000_000
#: Share of the pages of a site at which a masked body line counts as its notice when the model is trained.
REPEATED = 0.1

_TRANSPARENT = frozenset("p li ul ol blockquote h2 h3 h4 h5 h6 dl dt dd pre center q".split())
_ASIDE_TAGS = frozenset("aside nav footer form figure figcaption caption address header details".split())
# Words in class and id names that name a part of a page, in the usage of web templates.
_OFF = re.compile(r"(?:^|[-_ ])(?:ads?|adv|advert\w*|banner|related|relate|more|share|social|inline|promo|sponsor\w*|box|side\w*|rail|right|left|talk|comments?|cmts?|foot\w*|bottom|cookie\w*|consent|menu|nav\w*|topnav|top|breadcrumbs?|tags?|caption|newsletter|subscribe|popup|widget|recommend\w*|copyright)(?:$|[-_ ])", re.I)
_META = re.compile(r"(?:^|[-_ ])(?:author|byline|by|date|time|published?|publish_at|meta|dateline|info)(?:$|[-_ ])", re.I)
_TALK = re.compile(r"(?:^|[-_ ])(?:talk|comments?|cmts?|foot\w*|bottom|cookie\w*|consent|menu|nav\w*|topnav|top|share|copyright)(?:$|[-_ ])", re.I)
_DATE = re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}:\d{2}|^\d{9,13}$|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w* \d{1,2}, \d{4}|\d{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w* \d{4}|\b(?:ago|trước)$|tháng \d{1,2}, \d{4}|\d{1,2}h\d{2} ngày", re.I)
_SENTENCE_END = re.compile(r"[.!?…:;\"'”’»)\]]\s*$")
_ONLY_DATE = re.compile(r"[\d\s:/.,h+-]*(?:\d{4}|\d:\d\d)[\d\s:/.,+-]*(?:z|[ap]m|gmt|utc|ict)?", re.I)
_BLANKS = re.compile(r"[ \t\r\n]+")
_WORD = re.compile(r"[^\W\d_]+|\d[\d.,]*|[>|·•»~*#-]+|[!?:]")


def _names(node: Node) -> str:
    return f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}" if node.raw else ""


def _off(node: Node) -> bool:
    return node.tag in _ASIDE_TAGS or bool(node.raw and _OFF.search(_names(node)))


def _is_meta(b: Block) -> bool:
    """A byline or date, by its class, its tag or its look."""
    nodes = [b.node, *b.inline]
    if any(n.tag == "time" or n.raw and _META.search(_names(n)) for n in nodes):
        return True
    return len(b.text) < 80 and not b.text.rstrip().endswith((".", "!", "?")) and bool(_DATE.search(b.text)) and len(re.findall(r"[^\W\d_]{2,}", b.text)) <= 6


def _is_prose(b: Block) -> bool:
    return len(b.text) >= 40 and b.linked < 0.6 * len(b.text) or bool(_SENTENCE_END.search(b.text)) and len(b.text) >= 12 and b.linked < 0.6 * len(b.text)


def _title(root: Node) -> str:
    for node in root.descendants():
        if node.tag == "title":
            return " ".join(node.text().split())
        if node.tag == "body":
            break
    return ""


def headline(root: Node, found: list[Block]) -> int | None:
    """Index of the block that is the page's headline."""
    for k, b in enumerate(found):
        if b.node.tag == "h1" or any(n.tag == "h1" for n in b.inline):
            return k
    title = _title(root).casefold()
    for k, b in enumerate(found):
        text = b.text.casefold()
        if len(text) >= 8 and b.linked == 0 and title.startswith(text) and len(title) - len(text) < 80 and title != text:
            return k
    return None


def _container(b: Block) -> Node:
    node = b.node
    while node.tag in _TRANSPARENT and node.parent is not None:
        node = node.parent
    return node


def split_page(root: Node, found: list[Block]) -> tuple[list[Block], list[Block]]:
    """(body, known not to be body): the blocks of a page by its layout alone; other blocks are in neither."""
    off = [b for b in found if any(n.tag in ("nav", "footer") or n.raw and _TALK.search(_names(n)) for n in (b.node, *b.node.ancestors()))]
    top = headline(root, found)
    if top is None:
        return [], off
    first, home, around = None, None, found[top].node.parent
    for k in range(top + 1, len(found)):
        b = found[k]
        if _is_meta(b) or not _is_prose(b):
            continue
        box = _container(b)
        apart = next((n for n in (box, *box.ancestors()) if _off(n)), None)
        if apart is not None:
            if around in (apart, *apart.ancestors()):
                continue  # an inset before the first paragraph
            break
        first, home = k, box
        break
    if first is None:
        return [], off
    inside = [b for b in found[top + 1 :] if home is b.node or home in b.node.ancestors()]
    kept: list[Block] = []
    dropped: list[Block] = []
    for b in inside:
        chain, node = [], b.node
        while node is not home and node is not None:
            chain.append(node)
            node = node.parent
        (dropped if _is_meta(b) or any(_off(n) for n in chain) or b.linked > 0.8 * len(b.text) else kept).append(b)
    weights: Counter[str] = Counter()
    for b in kept:
        if _is_prose(b) and b.node is not home:
            weights[" ".join(b.node.classes)] += len(b.text)
    if weights:
        prose = max(weights, key=lambda c: (weights[c], c == ""))
        dropped += [b for b in kept if b.node is not home and b.node.tag in _TRANSPARENT and " ".join(b.node.classes) not in (prose, "")] if prose else [b for b in kept if b.node is not home and b.node.classes]
        gone = set(map(id, dropped))
        kept = [b for b in kept if id(b) not in gone]
    return kept, off + dropped


def site_names(url: str | None) -> frozenset[str]:
    """The labels of a URL's host by which a site calls itself."""
    m = re.match(r"\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    return frozenset(x for x in m[1].lower().split(".") if len(x) > 3 and x not in ("www", "news", "example")) if m else frozenset()


def masked(line: str, names: frozenset[str]) -> list[str]:
    """The words of a line; numbers and the site's name are masked."""
    return ["#" if w[0].isdigit() else "@site" if w in names else w for w in _WORD.findall(looks.key(line))]


def features(words: list[str]) -> tuple[list[str], int]:
    """Openings, words and word pairs of a masked line, and how many openings."""
    if not words:
        return [], 0
    opening = ["0 " + " ".join(words[:2])]
    if not words[0][0].isalnum() and words[0] != "#":
        opening.append("^ " + words[0])
    if len(words) <= 16:
        opening.append("= " + " ".join(words))
    return opening + sorted(set(words) | {f"{a} {b}" for a, b in zip(words, [*words[1:], "$"])}), len(opening)


class LineModel(dict):
    """The weights of the features that have been seen most; ``rare`` has (x, weight) of all others, if there are others."""

    rare: DataFrame | None = None


class Weights:
    """The weights that are broadcast and those of the rare features of one row."""

    def __init__(self, known: dict[str, float], rare: dict[str, float]) -> None:
        self.known, self.rare = known, rare

    def get(self, x: str, missing: float) -> float:
        w = self.known.get(x)
        return self.rare.get(x, missing) if w is None else w


def rare_weights(rows: DataFrame, key: str, model: LineModel, known: Broadcast, found: Callable[[pd.DataFrame], Iterator[Iterable[str]]]) -> DataFrame | None:
    """(key, rare_x, rare_w): what the model knows of the rows' features beside what is broadcast; none if it is all broadcast.

    ``found`` gives the features of each row of a batch. Rows of one key get the weights of all their features.
    """
    if model.rare is None:
        return None

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(list({(k, x) for k, f in zip(b[key], found(b)) for x in f if x not in known.value}), columns=[key, "x"])

    pairs = rows.mapInPandas(asked, f"{key} long, x string").distinct()
    held = lookup_join(pairs, model.rare, ["x"], "inner").groupBy(key).agg(F.collect_list(F.struct("x", "weight")).alias("rare"))
    return held.select(key, F.col("rare.x").alias("rare_x"), F.col("rare.weight").alias("rare_w"))


def _with_rare(rows: DataFrame, rare: DataFrame | None, key: str) -> DataFrame:
    if rare is None:
        return rows.withColumns({"rare_x": F.lit(None).cast("array<string>"), "rare_w": F.lit(None).cast("array<double>")})
    return rows.join(rare, key, "left")


def _weights(known: Broadcast, b: pd.DataFrame) -> Iterator[dict[str, float] | Weights]:
    """The weights for each row of a batch of _with_rare()."""
    return (known.value if x is None else Weights(known.value, dict(zip(x, w))) for x, w in zip(b["rare_x"], b["rare_w"]))


def evidence(line: str, names: frozenset[str], weights: dict[str, float] | Weights) -> float:
    """Evidence against a line; above THRESHOLD it isn't body. Either all its features speak against it, or one of its openings alone does so strongly."""
    f, n = features(masked(line, names))
    if not f:
        return 9.0
    w = [weights.get(x, 0.0) for x in f]
    return max(sum(w) / sqrt(len(w)), max(w[:n]) - OPENING)


def page_lines(html: str | None, url: str | None) -> list[tuple[str, bool]]:
    """(text, body) of a page's blocks whose part the layout tells."""
    root = htmltree.parse(html)
    body, off = split_page(root, [x.block for x in htmltree.layout(root)])
    return [(b.text, True) for b in body] + [(b.text, False) for b in off]


def page_bodies(pages: DataFrame) -> DataFrame:
    """(id, url, page, body, off): what the layout of each fetched page tells, lines of the body and lines that are none; written once, so that pages are parsed once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            body, off = [], []
            for h, u in zip(b["raw_html"], b["url"]):
                found = page_lines(h, u)
                body.append([t for t, inside in found if inside])
                off.append([t for t, inside in found if not inside])
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "page": b["page"], "body": body, "off": off})

    found = _fetched(pages).select("id", "url", F.xxhash64("id", "url").alias("page"), "raw_html")
    return cut(found.mapInPandas(read, "id string, url string, page long, body array<string>, off array<string>"))


def line_counts(bodies: DataFrame) -> DataFrame:
    """(line, body, off): how often each masked line of all fetched pages counts as body and as none, from page_bodies().

    Layouts without marks leave site notices and pointers inside bodies. So masked lines that recur in the bodies of
    REPEATED of a site's pages, and of four at least, count for the other side.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, u, body, off in zip(batch["page"], batch["url"], batch["body"], batch["off"]):
                if len(body) or len(off):
                    names = site_names(u)
                    site = " ".join(sorted(names))
                    rows.append((page, site, "", False, 1))  # for the number of pages
                    rows += [(page, site, w, inside, n) for (w, inside), n in Counter((" ".join(masked(t, names)), inside) for part, inside in ((body, True), (off, False)) for t in part).items() if w]
            yield pd.DataFrame(rows, columns=["page", "site", "line", "body", "times"])

    found = bodies.select("page", "url", "body", "off").mapInPandas(lines, "page long, site string, line string, body boolean, times long")
    once = found.groupBy("page", "site", "line", "body").agg(F.max("times").alias("times"))  # repeated rows count once
    by_site = cut(once.groupBy("site", "line", "body").agg(F.sum("times").alias("times"), F.count("*").alias("pages")))
    sized = lookup_join(by_site.where("line <> ''"), by_site.where("line = ''").select("site", F.col("pages").alias("size")), ["site"])
    moved = F.when(F.col("body") & (F.col("pages") >= F.greatest(F.lit(4), REPEATED * F.col("size"))), F.col("pages")).otherwise(0)
    split = sized.select("line", F.when(F.col("body"), F.col("times") - moved).otherwise(0).alias("body"), F.when(F.col("body"), moved).otherwise(F.col("times")).alias("off"))
    return cut(split.groupBy("line").agg(F.sum("body").alias("body"), F.sum("off").alias("off")))


def line_model(bodies: DataFrame) -> LineModel:
    """Evidence of each feature against a line being body, from page_bodies(): smoothed log odds, shrunk where a feature is rare; features seen once are left out.

    In a second round lines whose openings speak against them count for the other side. For words, a masked line that
    occurs n times counts as sqrt(n).
    """
    counts = line_counts(bodies).withColumn("key", F.xxhash64("line"))
    model = LineModel()
    for r in range(2):
        known = bodies.sparkSession.sparkContext.broadcast(dict(model))

        def openings(b: pd.DataFrame) -> Iterator[list[str]]:
            for line in b["line"]:
                f, n = features(line.split(" "))
                yield f[:n]

        def feature_counts(batches: Iterator[pd.DataFrame], r: int = r, known: Broadcast = known) -> Iterator[pd.DataFrame]:
            for b in batches:
                sums: dict[tuple[str, bool], list[float]] = {}
                for weights, line, *both in zip(_weights(known, b), b["line"], b["off"], b["body"]):
                    f, n = features(line.split(" "))
                    good = r == 0 or max(weights.get(x, 0.0) for x in f[:n]) <= 1
                    for body, times in enumerate(both):
                        if times > 0:
                            side, damped = int(body and good), sqrt(times)
                            for k, x in enumerate(f):
                                sums.setdefault((x, k < n), [0.0, 0.0])[side] += times if k < n else damped
                            sums.setdefault(("", False), [0.0, 0.0])[side] += damped
                yield pd.DataFrame([(x, o, *v) for (x, o), v in sums.items()], columns=["x", "opening", "off", "body"])

        lines = _with_rare(counts, rare_weights(counts, "key", model, known, openings), "key")
        total = lines.mapInPandas(feature_counts, "x string, opening boolean, off double, body double").groupBy("x", "opening").agg(F.sum("off").alias("off"), F.sum("body").alias("body"))
        model = _weighed(cut(total.where("off + body > 1.2 or x = ''")))
    return model


def _weighed(total: DataFrame) -> LineModel:
    """The model of all features: the MODEL_FEATURES, about, that have been seen most in memory, the others as a table."""
    own = total.where("x = ''").agg(F.sum("off").alias("off"), F.sum("body").alias("body")).first()
    off, body = 2.0 + (own.off or 0.0), 2.0 + (own.body or 0.0)
    o, i = F.col("off") + 0.5, F.col("body") + 0.5
    # words by likelihood; openings, each of which may decide alone, by the odds of the lines that have them
    odds = F.when(F.col("opening"), o / i).otherwise((o / off) / (i / body))
    seen = F.col("off") + F.col("body")
    weighed = total.where("x <> ''").select("x", seen.alias("seen"), (F.log(odds) * (1 - F.exp(-seen / 2))).alias("weight"))
    n = total.count()
    least = weighed.approxQuantile("seen", [1 - MODEL_FEATURES / n], min(0.001, 0.1 * MODEL_FEATURES / n))[0] if n > MODEL_FEATURES else 0.0
    common = weighed.where(F.col("seen") > least).select("x", "weight").toPandas()
    model = LineModel(zip(common["x"], common["weight"]))
    if n > MODEL_FEATURES:
        model.rare = weighed.where(F.col("seen") <= least).select("x", "weight")
    return model


def _fetched(pages: DataFrame) -> DataFrame:
    return pages.where("status_code = 200 and raw_html is not null").select("id", "url", "raw_html")


def _md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def lines_of_page(html: str | None, url: str | None, weights: dict[str, float] | Weights) -> list[Line]:
    """The rendered lines of a page's main body, in order."""
    names = site_names(url)
    root = htmltree.parse(html)
    lines = htmltree.layout(root)
    body, _ = split_page(root, [x.block for x in lines])
    kept = {id(b) for b in body if evidence(b.text, names, weights) <= PAGE_THRESHOLD}
    return [x for x in lines if id(x.block) in kept]


def kept_lines(body: Sequence[str], url: str | None, weights: dict[str, float] | Weights) -> list[str]:
    """The lines of a page's body by its layout that the line model leaves in it."""
    names = site_names(url)
    return [t for t in body if evidence(t, names, weights) <= PAGE_THRESHOLD]


def body_of_page(html: str | None, url: str | None, weights: dict[str, float] | Weights) -> list[str]:
    """The paragraphs of a page's main body, in order."""
    return kept_lines([t for t, inside in page_lines(html, url) if inside], url, weights)


def _text_lines(text: str | None) -> Iterator[str]:
    for line in (text or "").split("\n"):
        line = _BLANKS.sub(" ", line).strip(" ")
        if line:
            yield line


def _features_of(rows: Iterable[tuple[str | None, Iterable[str]]]) -> Iterator[set[str]]:
    """The features of each row's lines, from (url, lines)."""
    for url, lines in rows:
        names = site_names(url)
        yield {x for line in lines for x in features(masked(line, names))[0]}


def _body_features(b: pd.DataFrame) -> Iterator[set[str]]:
    return _features_of(zip(b["url"], b["body"]))


def _text_features(b: pd.DataFrame) -> Iterator[set[str]]:
    return _features_of(zip(b["url"], map(_text_lines, b["content"])))


def body_of_text(text: str | None, url: str | None, title: str | None, author: str | None, weights: dict[str, float] | Weights) -> list[str]:
    """The lines of a stored text that are its main body, in order; the row's title and author are no body."""
    names = site_names(url)
    known = {looks.key(x) for x in (title, author) if x and x.strip()}
    out = []
    for line in _text_lines(text):
        if looks.key(line) not in known and evidence(line, names, weights) <= THRESHOLD and not (len(line) < 40 and _ONLY_DATE.fullmatch(line)):
            out.append(line)
    return out


def main_paragraphs(pages: DataFrame, contents: DataFrame, with_text: bool = False) -> DataFrame:
    """(id, para_md5), with ``with_text`` also position and paragraph: the main body of fetched pages and of stored texts."""
    bodies = page_bodies(pages)
    model = line_model(bodies)
    known = pages.sparkSession.sparkContext.broadcast(dict(model))
    schema = "id string, position int, paragraph string" if with_text else "id string, para_md5 string"
    columns = ["id", "position", "paragraph"] if with_text else ["id", "para_md5"]

    def rows(ident: str, body: list[str]) -> list[tuple]:
        return [(ident, k, p) for k, p in enumerate(body)] if with_text else [(ident, m) for m in dict.fromkeys(map(_md5, body))]

    def of_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for i, u, body, w in zip(b["id"], b["url"], b["body"], _weights(known, b)) for r in rows(i, kept_lines(body, u, w))], columns=columns)

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for i, u, t, a, c, w in zip(b["id"], b["url"], b["title"], b["author"], b["content"], _weights(known, b)) for r in rows(i, body_of_text(c, u, t, a, w))], columns=columns)

    kept = bodies.select("id", "url", "page", "body")
    texts = contents.where("content is not null").select("id", "url", "title", "author", "content", F.xxhash64("url", "content").alias("text"))
    found = _with_rare(kept, rare_weights(kept, "page", model, known, _body_features), "page").mapInPandas(of_pages, schema)
    stored = _with_rare(texts, rare_weights(texts, "text", model, known, _text_features), "text").mapInPandas(of_texts, schema)
    if with_text:
        return found.unionByName(stored).select("*", F.md5("paragraph").alias("para_md5"))
    return found.unionByName(stored).distinct()


def main_texts(pages: DataFrame) -> DataFrame:
    """(id, text): the main body of each fetched page as it is rendered; '' for pages without one. Pages that were saved again give a row for each of their texts."""
    bodies = page_bodies(pages)
    model = line_model(bodies)
    known = pages.sparkSession.sparkContext.broadcast(dict(model))

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [htmltree.write(lines_of_page(h, u, w)) for u, h, w in zip(b["url"], b["raw_html"], _weights(known, b))]})

    rare = rare_weights(bodies.select("url", "page", "body"), "page", model, known, _body_features)
    return _with_rare(_fetched(pages).withColumn("page", F.xxhash64("id", "url")), rare, "page").mapInPandas(rendered, "id string, text string").distinct()
