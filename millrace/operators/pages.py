"""Stored pages: what one pass over their HTML yields, their links, their articles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import classify, urls
from millrace.functions import htmltree as html
from millrace.functions.resolve import resolve
from millrace.operators.joins import lookup_join

# Where navigation, headers, contents, prominent links and breadcrumbs stand, what is noise, the selectors used
# for hosts without their own.
NAVIGATION = (
    "nav, navigation, "
    ".nav, .navigation, .navbar, .menu, .main-menu, .primary-menu, "
    ".header-menu, .top-menu, .site-nav, .main-nav, .menu-nav, .header-nav, .primary-nav, "
    "#nav, #navigation, #navbar, #menu, #main-menu, #primary-menu, #header-menu, #primary-nav, #header-nav, #menu-nav, "
    ".dropdown-menu"
)
HEADER = "header, .header, .site-header, .page-header, .main-header, #header, #site-header, #page-header, #main-header"
CONTENT_AREAS = ".main-content, .content, .site-content, #content, #main-content, .category-list, .section-list, .menu-categories, .topics"
PROMINENT = "a.btn, a.button, a[class*=prominent], a[class*=primary], a[class*=main], a[class*=category], a[class*=section], a[class*=topic]"
BREADCRUMBS = ".breadcrumb a, .breadcrumbs a, [class*=breadcrumb] a, .crumb a, .crumbs a, nav[aria-label*=breadcrumb] a"
NOISE = (
    "script, noscript, style, svg, img, link, "
    "head, footer, nav, [class*='menu'], [class*='nav'], "
    ".ads, .advertisment, .social, .copy-right, #copy-right, "
    "[id*='banner'], [class*='banner'], [class*='comment'], [id*='comment'], [class*='share'], [id*='share']"
)
MORE_NOISE = NOISE + ", [id*='ads'], header:not(:has(h1))"
#: Attributes and the words in them by which a link, or an element around it, is likely navigation.
LINK_MARKS = {"class": ("nav", "menu", "primary", "main", "category", "section"), "id": ("nav", "menu")}
AROUND_MARKS = {"class": ("nav", "menu", "header"), "id": ("nav", "menu", "header")}
DEFAULT_SELECTORS = {"title": "h1", "content": ".content", "author": ".author", "publish_at": ".date"}
#: Characters of HTML a token, and tokens that a selector provider takes at most.
CHARS_PER_TOKEN, TOKEN_LIMIT = 4, 125_000

#: What can be known of a page, by name; all_links has a link as often as the page has it.
FACTS = {
    "base": "string", "canonical": "string", "og_url": "string", "title": "string",
    "nav_links": "array<string>", "header_links": "array<string>", "content_links": "array<string>", "prominent_links": "array<string>", "breadcrumb_links": "array<string>", "page_links": "array<string>", "all_links": "array<string>",
    "kept_html": "string", "html_chars": "long", "kept_chars": "long",
}


def _marked(node: html.Node, marks: dict[str, Sequence[str]]) -> bool:
    return any(w in node.attrs.get(a, "").lower() for a, words in marks.items() for w in words)


def _likely_navigation(link: html.Node) -> bool:
    around = takewhile(lambda n: n.tag != "body", link.ancestors())
    return _marked(link, LINK_MARKS) or any(_marked(n, AROUND_MARKS) for n in around)


def _is_link(node: html.Node) -> bool:
    return node.tag == "a" and "href" in node.attrs


def _followed(href: str) -> bool:
    """Whether a navigation link leads anywhere."""
    return not (href in ("", "#") or href.startswith("javascript:"))


class Page:
    """One page's tree and what is worked out from it on demand. Links are resolved against the page's own address: canonical, else og:url, else the fetched URL."""

    def __init__(self, page: str | None, url: str | None, noise: str = NOISE) -> None:
        self.root, self.noise, self.size = html.parse(page), noise, len(page or "")
        self.canonical = self._address("link[rel=canonical]", "href")
        self.og_url = self._address("meta[property='og:url']", "content")
        self.base = self.canonical or self.og_url or (url.strip() if url and url.strip() else None)

    def _address(self, selector: str, attribute: str) -> str | None:
        found = (n.attrs.get(attribute, "") for n in html.select(self.root, selector))
        return next((v for v in found if v.strip()), None)

    def _resolved(self, hrefs: Iterator[str]) -> list[str]:
        return [] if self.base is None else [resolve(self.base, h, same_site=True) for h in hrefs]

    def _within(self, selector: str, only: Callable[[html.Node], bool] = lambda n: True) -> list[str]:
        links = (a for n in html.select(self.root, selector) for a in n.descendants() if _is_link(a) and only(a))
        return list(dict.fromkeys(self._resolved(a.attrs["href"] for a in links if _followed(a.attrs["href"]))))

    def _selected(self, selector: str) -> list[str]:
        links = (a for a in html.select(self.root, selector) if _is_link(a))
        return list(dict.fromkeys(self._resolved(a.attrs["href"] for a in links if _followed(a.attrs["href"]))))

    def fact(self, name: str) -> object:
        """The fact ``name``; those of the page without noise come last, as the noise is taken out of the tree."""
        if name in ("base", "canonical", "og_url"):
            return getattr(self, name)
        if name == "title":
            return html.first_text(self.root, "h1")
        if name == "nav_links":
            return self._within(NAVIGATION)
        if name == "header_links":
            return self._within(HEADER, _likely_navigation)
        if name == "content_links":
            return self._within(CONTENT_AREAS, _likely_navigation)
        if name == "prominent_links":
            return self._selected(PROMINENT)
        if name == "breadcrumb_links":
            return self._selected(BREADCRUMBS)
        if name in ("page_links", "all_links"):
            every = self._resolved(a.attrs["href"] for a in self.root.descendants() if _is_link(a))
            return every if name == "all_links" else list(dict.fromkeys(every))
        if name == "html_chars":
            return self.size
        html.remove(self.root, self.noise)
        kept = html.to_html(self.root)
        return kept if name == "kept_html" else len(kept)


def facts_of(page: str | None, url: str | None, wanted: Sequence[str], noise: str = NOISE) -> tuple:
    """The facts ``wanted`` of one page, in the order of FACTS, from one tree."""
    p = Page(page, url, noise)
    return tuple(p.fact(name) for name in FACTS if name in wanted)


def page_facts(pages: DataFrame, wanted: Sequence[str], noise: str = NOISE) -> DataFrame:
    """(id, url, then the facts ``wanted``) of (id, url, raw_html); rows without HTML are left out. Each page is parsed once, and nothing that isn't wanted is worked out or leaves Python."""
    unknown = set(wanted) - set(FACTS)
    if unknown:
        raise ValueError(f"facts: {sorted(unknown)}")
    names = [n for n in FACTS if n in wanted]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, u, *facts_of(h, u, names, noise)) for i, u, h in zip(b["id"], b["url"], b["raw_html"])], columns=["id", "url", *names])

    schema = ", ".join(["id string", "url string", *(f"{n} {FACTS[n]}" for n in names)])
    return pages.where("raw_html is not null").select("id", "url", "raw_html").mapInPandas(read, schema)


#: The facts that each operator below reads.
SITEMAP_FACTS = ("base", "nav_links", "header_links")
LINK_FACTS = (*SITEMAP_FACTS, "page_links")
WIDE_FACTS = ("content_links", "prominent_links", "breadcrumb_links", "all_links")


def _valid(links: Column, test: Callable[[Column], Column]) -> Column:
    return F.array_distinct(F.transform(F.filter(links, test), urls.link_form))


def sitemap(facts: DataFrame, with_header: bool = False) -> DataFrame:
    """(id, base, seeds): a home page's own address, then its navigation links, without doubles, in order."""
    nav = _valid(F.col("nav_links"), classify.is_navigation_link)
    more = _valid(F.col("header_links"), classify.is_navigation_link) if with_header else F.array().cast("array<string>")
    return facts.where("base is not null").select("id", "base", F.array_distinct(F.concat(F.array(urls.link_form(F.col("base"))), nav, more)).alias("seeds"))


def new_links(facts: DataFrame) -> DataFrame:
    """(id, url): the section links of each page that aren't in its navigation or header."""
    known = F.concat(F.array(urls.link_form(F.col("base"))), _valid(F.col("nav_links"), classify.is_navigation_link), _valid(F.col("header_links"), classify.is_navigation_link))
    links = F.array_except(_valid(F.col("page_links"), classify.is_section_link), known)
    return facts.where("base is not null").select("id", F.explode(links).alias("url"))


def link_frequency(facts: DataFrame) -> DataFrame:
    """(id, url, n): navigation links that stand at least twice on a page and have a short path; n counts every place of the link, with and without a last slash.

    Counted by what a counter of links is for. The crawler's own one looks its counts up under another key than it stores
    them, so it never passes 1, and nothing calls it.
    """
    counted = facts.select("id", F.explode("all_links").alias("link")).where(classify.is_navigation_link(F.col("link"))).groupBy("id", urls.link_form(F.col("link")).alias("url")).agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= 2) & classify.has_short_path(F.col("url")))


def more_sitemap_links(facts: DataFrame) -> DataFrame:
    """(id, kind, url): links of content areas, prominent links whose URL is likely navigation, and breadcrumbs, each once for its kind, from WIDE_FACTS."""
    kinds = {
        "content": _valid(F.col("content_links"), classify.is_navigation_link),
        "prominent": _valid(F.col("prominent_links"), lambda u: classify.is_navigation_link(u) & classify.is_likely_navigation(u)),
        "breadcrumb": _valid(F.col("breadcrumb_links"), classify.is_navigation_link),
    }
    each = F.array(*[F.struct(F.lit(k).alias("kind"), links.alias("links")) for k, links in kinds.items()])
    return facts.select("id", F.explode(each).alias("k")).select("id", "k.kind", F.explode("k.links").alias("url"))


def token_reduction(facts: DataFrame) -> DataFrame:
    """(id, tokens_before, tokens_after, reduction, fits): estimated tokens of the page and of its HTML without noise, from the facts html_chars and kept_chars."""
    before, after = F.floor(F.col("html_chars") / CHARS_PER_TOKEN), F.floor(F.col("kept_chars") / CHARS_PER_TOKEN)
    return facts.select("id", before.alias("tokens_before"), after.alias("tokens_after"), F.round((before - after) / F.greatest(before, F.lit(1)) * 100, 2).alias("reduction"), fits(after).alias("fits"))


def fits(tokens: Column) -> Column:
    """Whether a selector provider takes a text of so many tokens."""
    return tokens <= TOKEN_LIMIT


def with_selectors(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Pages with the selectors of their host, the default ones where the registry has none; ``is_default`` tells."""
    own = registry.where("domain is not null").groupBy(F.lower("domain").alias("__host")).agg(F.first(F.struct("title", "content", "author", "publish_at")).alias("__s"))
    rows = lookup_join(pages.withColumn("__host", urls.site(F.col("url"))), own, ["__host"])
    default = F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_SELECTORS.items()])
    return rows.withColumn("selectors", F.coalesce("__s", default)).withColumn("is_default", F.col("__s").isNull()).drop("__host", "__s")


def articles(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, url, title, content, author, publish_at, is_default, parsed): the text of the first element that each selector finds, after noise is removed.

    Invalid selectors and missing elements give null; a page without title or content counts as failed.
    """
    schema = "id string, url string, title string, content string, author string, publish_at string, is_default boolean"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, u, h, s, d in zip(b["id"], b["url"], b["raw_html"], b["selectors"], b["is_default"]):
                root = html.parse(h)
                html.remove(root, NOISE)
                rows.append((i, u, *(html.first_text(root, s[k]) for k in DEFAULT_SELECTORS), d))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    chosen = with_selectors(pages.where("status_code = 200 and raw_html is not null").select("id", "url", "raw_html"), registry)
    found = chosen.select("id", "url", "raw_html", "selectors", "is_default").mapInPandas(read, schema)
    full = (F.coalesce(F.length("title"), F.lit(0)) > 0) & (F.coalesce(F.length("content"), F.lit(0)) > 0)
    return found.withColumn("parsed", full)


def parse_counters(parsed: DataFrame) -> DataFrame:
    """(host, parsed, failed) of articles(), by site."""
    return parsed.groupBy(urls.site(F.col("url")).alias("host")).agg(F.count_if("parsed").alias("parsed"), F.count_if(~F.col("parsed")).alias("failed"))


def extracted_total(links: DataFrame) -> DataFrame:
    """(extracted): how many links were found and sent back to the frontier, from new_links()."""
    return links.agg(F.count("*").alias("extracted"))


def parse(pages: DataFrame, kind: str, registry: DataFrame | None = None) -> DataFrame:
    """The strategy for a kind of page: ``home`` gives seeds, ``url`` new links, ``content`` the article."""
    strategies: dict[str, Callable[[], DataFrame]] = {
        "home": lambda: sitemap(page_facts(pages, SITEMAP_FACTS)),
        "url": lambda: new_links(page_facts(pages, LINK_FACTS)),
        "content": lambda: articles(pages, registry),
    }
    if kind not in strategies or kind == "content" and registry is None:
        raise ValueError(f"kind: {kind}")
    return strategies[kind]()


def missing_selectors(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """(domain): hosts of pages that the registry doesn't know, each once, for a selector provider to be asked about."""
    hosts = pages.select(urls.site(F.col("url")).alias("domain")).where("domain is not null").distinct()
    return hosts.join(registry.select(F.lower("domain").alias("domain")), "domain", "left_anti")


# The wording is our own; the keys are those of the selector registry.
PROMPT = "Give the CSS selectors of title, content, author and publication date of the news page below as JSON with the keys title, content, author, publish_at; null where there is none.\n\n"
_REPLY = "struct<title string, content string, author string, publish_at string>"


def prompts(pages: DataFrame) -> DataFrame:
    """(id, domain, prompt, tokens, fits): the question for a selector provider about each page, with its HTML without noise; ``fits`` tells whether it may be asked."""
    facts = page_facts(pages, ("kept_html",))
    text = F.concat(F.lit(PROMPT), F.col("kept_html"))
    tokens = F.floor(F.length(text) / CHARS_PER_TOKEN)
    return facts.select("id", urls.site(F.col("url")).alias("domain"), text.alias("prompt"), tokens.alias("tokens"), fits(tokens).alias("fits"))


def reply_selectors(reply: Column) -> Column:
    """The selectors in a provider's reply: a code fence is taken off, "null" is null, the default ones where it can't be read."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*|\s*```$", "")
    read = F.from_json(bare, _REPLY.replace("struct<", "").rstrip(">"))
    clean = F.struct(*[F.when(~F.lower(read[k]).isin("null", ""), read[k]).alias(k) for k in DEFAULT_SELECTORS])
    default = F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_SELECTORS.items()])
    return F.when(read["title"].isNotNull() | read["content"].isNotNull(), clean).otherwise(default)


def json_block(text: str | None) -> str | None:
    """The outermost ``{…}`` of a text with balanced braces."""
    start = (text or "").find("{")
    while start >= 0:
        depth = 0
        for k in range(start, len(text)):
            depth += (text[k] == "{") - (text[k] == "}")
            if depth == 0:
                return text[start : k + 1]
        start = text.find("{", start + 1)
    return None
