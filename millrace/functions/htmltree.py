"""A small HTML tree: tolerant builder with implied tags, visible text by block, a subset of CSS selectors.

The builder never fails: unknown or stray end tags are dropped, unclosed elements end with their parents, text outside
``body`` is kept. It serves pages as they are found on the web, not the whole HTML standard: formatting elements are not
reopened after a misnested end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape, unescape

# The standard's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style head template noscript title textarea iframe object select svg math audio video canvas".split())
_CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
#: Start tag: the open elements that it ends, and the elements beyond which it doesn't look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_SCOPE = frozenset("td th table caption button".split())

_TAG = re.compile(
    r"<(?:(!--(?:.*?(?:--!?>|\Z)))|([!?][^>]*>)|/([a-zA-Z][^\s/>]*)[^>]*>|([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
#: A tag that closes itself; a slash at the end of an unquoted value is part of the value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_BLANKS = re.compile(r"[ \t\r\n]+")
_ALL_BLANKS = re.compile(r"[ \t\r\n\f\xa0]+")


class Node:
    """An element: its tag in lower case, raw attributes, parent and children (nodes and text)."""

    __slots__ = ("tag", "raw", "parent", "children", "_attrs", "order")

    def __init__(self, tag: str, raw: str, parent: Node | None, order: int) -> None:
        self.tag, self.raw, self.parent, self.children, self._attrs, self.order = tag, raw, parent, [], None, order

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            if self.raw:
                for name, double, single, bare in _ATTR.findall(self.raw):
                    value = double or single or bare
                    self._attrs.setdefault(name.lower(), unescape(value) if "&" in value else value)
        return self._attrs

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def descendants(self) -> Iterator[Node]:
        """All elements below, in document order; no recursion, as pages may nest thousands deep."""
        stack = [c for c in reversed(self.children) if type(c) is Node]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if type(c) is Node)

    def text(self) -> str:
        """All text below without script and style, blanks made one."""
        out, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if type(item) is str:
                out.append(item)
            elif item.tag not in ("script", "style", "template"):
                edge = " " if item.tag in BLOCK or item.tag == "br" else ""
                stack.extend((edge, *reversed(item.children), edge))
        return _ALL_BLANKS.sub(" ", "".join(out)).strip()


def parse(html: str | None) -> Node:
    """The tree of ``html``; of null, an empty root."""
    root = Node("#root", "", None, 0)
    if not html:
        return root
    here, at, order, end = root, 0, 0, len(html)
    match = _TAG.search
    while at < end:
        m = match(html, at)
        if m is None:
            break
        start = m.start()
        if start > at:
            piece = html[at:start]
            here.children.append(unescape(piece) if "&" in piece else piece)
        at = m.end()
        tag = m[4]
        if tag is not None:
            tag, raw = tag.lower(), m[5]
            if tag in _CLOSES_P:
                here = _end(here, {"p"}, _SCOPE) or here
            if tag in IMPLIED:
                ends, stop = IMPLIED[tag]
                while (up := _end(here, ends, stop)) is not None:
                    here = up
            order += 1
            node = Node(tag, raw, here, order)
            here.children.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                inner = html[at : close.start() if close else end]
                if inner:
                    node.children.append(unescape(inner) if tag in ("title", "textarea") else inner)
                at = close.end() if close else end
            elif tag not in VOID and not _CLOSED.search(raw):
                here = node
        elif (tag := m[3]) is not None:
            tag = tag.lower()
            if tag == "br":
                here.children.append(Node("br", "", here, order))
            elif tag not in VOID:
                stop = ("table",) if tag not in ("table", "body", "html") and tag not in ("tr", "td", "th", "tbody") else ()
                here = _end(here, {tag}, stop) or here
    if at < end:
        piece = html[at:]
        here.children.append(unescape(piece) if "&" in piece else piece)
    return root


def _end(here: Node, tags: set[str], stop: frozenset[str] | set[str] | tuple) -> Node | None:
    """The parent of the innermost open element among ``tags``; None if there is none up to one of ``stop``."""
    node = here
    while node.parent is not None:
        if node.tag in tags:
            return node.parent
        if node.tag in stop:
            return None
        node = node.parent
    return None


def is_hidden(node: Node) -> bool:
    if node.tag in HIDDEN:
        return True
    if node.raw and ("hidden" in node.raw or "display" in node.raw or "visibility" in node.raw):
        style = node.attrs.get("style", "").replace(" ", "").lower()
        return "hidden" in node.attrs or node.attrs.get("type") == "hidden" or "display:none" in style or "visibility:hidden" in style
    return False


class Block:
    """Visible text between two boundaries of block elements or line breaks: its block element, the inline elements around all of it, the characters inside links."""

    __slots__ = ("text", "node", "inline", "linked")

    def __init__(self, text: str, node: Node, inline: list[Node], linked: int) -> None:
        self.text, self.node, self.inline, self.linked = text, node, inline, linked


def blocks(root: Node) -> list[Block]:
    """All visible blocks in document order. Runs of blank, tab, CR and LF are one blank; other characters stay."""
    out: list[Block] = []
    parts: list[str] = []
    inline: list[Node] = []
    linked = 0
    links = 0
    around: list[Node] = []
    owner = root

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _BLANKS.sub(" ", "".join(parts)).strip(" ")
            if text:
                out.append(Block(text, owner, list(inline), linked))
            parts.clear()
        inline.clear()
        linked = 0

    # an item is a text, a node to open, or (node,) to close
    stack: list = list(reversed(root.children))
    while stack:
        item = stack.pop()
        kind = type(item)
        if kind is str:
            parts.append(item)
            if links:
                linked += len(item)
            if around and not item.isspace():
                inline.extend(n for n in around if n not in inline)
        elif kind is tuple:
            node = item[0]
            if node.tag in BLOCK:
                flush()
                owner = node.parent
                while owner.parent is not None and owner.tag not in BLOCK:
                    owner = owner.parent
            else:
                around.pop()
                if node.tag == "a":
                    links -= 1
        elif item.tag == "br":
            flush()
        elif not is_hidden(item):
            if item.tag in BLOCK:
                flush()
                owner = item
            else:
                around.append(item)
                if item.tag == "a":
                    links += 1
            stack.append((item,))
            stack.extend(reversed(item.children))
    flush()
    return out


class Line:
    """A rendered line: a visible block and where it stands, which is worked out when it is asked for."""

    __slots__ = ("block", "_chain")

    def __init__(self, block: Block) -> None:
        self.block, self._chain = block, None

    @property
    def chain(self) -> list[Node]:
        """The elements around the block, innermost first."""
        if self._chain is None:
            self._chain = [self.block.node, *self.block.node.ancestors()]
        return self._chain

    def around(self, *tags: str) -> Node | None:
        return next((n for n in self.chain if n.tag in tags), None)

    @property
    def cell(self) -> tuple[Node, Node, Node] | None:
        """Its table, row and cell, if it stands in the cell of a row."""
        cell, row, table = self.around("td", "th"), self.around("tr"), self.around("table")
        return (table, row, cell) if cell is not None and row is not None and table is not None else None

    def written(self) -> str:
        """The text with the indent of the lists around it, and the mark of its list entry if it opens one."""
        lists = [n for n in self.chain if n.tag in ("ul", "ol", "menu")]
        if not lists:
            return self.block.text
        item, indent = self.around("li"), "  " * (len(lists) - 1)
        if item is None or item is not self.block.node:
            return indent + self.block.text
        if lists[0].tag != "ol":
            return f"{indent}- {self.block.text}"
        place = [n for n in lists[0].children if type(n) is Node and n.tag == "li"].index(item) if item in lists[0].children else 0
        return f"{indent}{place + 1}. {self.block.text}"


def layout(root: Node) -> list[Line]:
    """All visible lines of a page, in order."""
    return [Line(b) for b in blocks(root)]


#: A column of a table is aligned up to this width; beyond it cells are only kept apart.
ALIGNED = 60


def _table(cells: list[tuple[tuple[Node, Node, Node], str]]) -> list[str]:
    """The rows of a table with its columns aligned, two blanks apart; several lines of a cell are one."""
    rows: list[tuple[Node, list[tuple[Node, str]]]] = []
    for (_, row, cell), text in cells:
        if not rows or rows[-1][0] is not row:
            rows.append((row, []))
        own = rows[-1][1]
        if own and own[-1][0] is cell:
            own[-1] = (cell, f"{own[-1][1]} {text}")
        else:
            own.append((cell, text))
    widths: list[int] = []
    for _, own in rows:
        for k, (_, text) in enumerate(own):
            if k == len(widths):
                widths.append(0)
            if len(text) <= ALIGNED:
                widths[k] = max(widths[k], len(text))
    return ["  ".join(text.ljust(widths[k]) for k, (_, text) in enumerate(own)).rstrip() for _, own in rows]


def write(lines: list[Line]) -> str:
    """Lines as text: a blank line between blocks, none between the lines of one block or the entries of one list, list entries marked and indented, the cells of tables in aligned columns."""
    out: list[str] = []
    k = 0
    last: Line | None = None
    while k < len(lines):
        line = lines[k]
        cell = line.cell
        if cell is not None:
            end = k
            while end < len(lines) and (c := lines[end].cell) is not None and c[0] is cell[0]:
                end += 1
            if out:
                out.append("")
            out += _table([(x.cell, x.block.text) for x in lines[k:end]])
            last, k = None, end
            if k < len(lines):
                out.append("")
            continue
        listed = last is not None and last.around("ul", "ol", "menu") is not None and line.around("ul", "ol", "menu") is not None
        if last is not None and last.block.node is not line.block.node and not listed:
            out.append("")
        out.append(line.written())
        last, k = line, k + 1
    return "\n".join(out)


def render(root: Node) -> str:
    """The page as text, see write()."""
    return write(layout(root))


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]|:not\(:has\(([\w-]+)\)\)")


@lru_cache(4096)
def compile_selector(selector: str) -> tuple:
    """Alternatives of (combinator, tests) from left to right. Tags, classes, ids, attributes, descendants, ``>`` and commas; anything else raises ValueError."""
    alternatives = []
    for part in _split_commas(selector):
        part = re.sub(r"\s*>\s*", " > ", part.strip())
        steps, combinator = [], " "
        for word in re.findall(r"(?:\[[^\]]*\]|\([^()]*(?:\([^()]*\))?[^()]*\)|[^\s])+", part):
            if word == ">":
                if combinator == ">" or not steps:
                    raise ValueError(f"selector: {selector!r}")
                combinator = ">"
                continue
            tests, at = [], 0
            while at < len(word):
                m = _SIMPLE.match(word, at)
                if m is None or m[1] and at:
                    raise ValueError(f"selector: {selector!r}")
                tests.append((m[1] and m[1].lower(), m[2], m[3], m[4] and m[4].lower(), m[5], m[6] or m[7] or m[8] or "", m[9]))
                at = m.end()
            steps.append((combinator, tuple(tests)))
            combinator = " "
        if not steps or combinator == ">":
            raise ValueError(f"selector: {selector!r}")
        alternatives.append(tuple(steps))
    return tuple(alternatives)


def _split_commas(selector: str) -> list[str]:
    parts = re.split(r",(?![^\[]*\])", selector)
    if any(not p.strip() for p in parts):
        raise ValueError(f"selector: {selector!r}")
    return parts


def _passes(node: Node, tests: tuple) -> bool:
    for tag, cls, ident, attr, op, value, without in tests:
        if tag is not None:
            if tag != "*" and node.tag != tag:
                return False
        elif cls is not None:
            if not node.raw or cls.lower() not in (c.lower() for c in node.classes):
                return False
        elif ident is not None:
            if not node.raw or node.attrs.get("id") != ident:
                return False
        elif attr is not None:
            if not node.raw or attr not in node.attrs:
                return False
            have, want = node.attrs[attr].lower(), value.lower()
            if op and not {"=": have == want, "*=": want in have, "^=": have.startswith(want), "$=": have.endswith(want), "~=": want in have.split(), "|=": have == want or have.startswith(want + "-")}[op]:
                return False
        elif any(n.tag == without for n in node.descendants()):
            return False
    return True


def _matches(node: Node, steps: tuple, root: Node) -> bool:
    if not _passes(node, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    rest, combinator = steps[:-1], steps[-1][0]
    for up in node.ancestors():
        if up.parent is None:
            return False
        if _matches(up, rest, root):
            return True
        if combinator == ">":
            return False
    return False


@lru_cache(4096)
def _plain_selectors(selector: str) -> tuple[frozenset, frozenset, frozenset, tuple]:
    """The alternatives of a selector that are one tag, class or id, as sets, and the others."""
    plain: tuple[set, set, set] = (set(), set(), set())
    others = []
    for steps in compile_selector(selector):
        tests = steps[0][1]
        which = next((k for k in range(3) if len(steps) == 1 and len(tests) == 1 and tests[0][k] is not None and tests[0][0] != "*"), None)
        if which is None:
            others.append(steps)
        else:
            plain[which].add(tests[0][which].lower() if which == 1 else tests[0][which])
    return frozenset(plain[0]), frozenset(plain[1]), frozenset(plain[2]), tuple(others)


def _any(node: Node, selector: str, root: Node) -> bool:
    tags, classes, ids, others = _plain_selectors(selector)
    if node.tag in tags:
        return True
    if node.raw and (classes or ids):
        if ids and node.attrs.get("id") in ids or classes and any(c.lower() in classes for c in node.classes):
            return True
    return any(_matches(node, s, root) for s in others)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that match, in document order."""
    return [n for n in root.descendants() if _any(n, selector, root)]


def first_text(root: Node, selector: str | None) -> str | None:
    """Text of the first match; null without a selector, with an invalid one, or without a match."""
    if not selector or not selector.strip():
        return None
    try:
        compile_selector(selector)
    except ValueError:
        return None
    found = next((n for n in root.descendants() if _any(n, selector, root)), None)
    return None if found is None else found.text()


def remove(root: Node, selector: str) -> None:
    """Take all matches out of the tree."""
    for node in select(root, selector):
        if node.parent is not None and node in node.parent.children:
            node.parent.children.remove(node)


def to_html(root: Node) -> str:
    """The tree as HTML again: attributes as they were written, end tags added, comments gone."""
    out: list[str] = []
    stack: list = list(reversed(root.children))
    while stack:
        item = stack.pop()
        kind = type(item)
        if kind is str:
            out.append(item)
        elif kind is tuple:
            out.append(f"</{item[0]}>")
        elif item.tag in RAW:
            out.append(f"<{item.tag}{item.raw}>{''.join(c for c in item.children if type(c) is str)}</{item.tag}>")
        else:
            out.append(f"<{item.tag}{item.raw}>")
            if item.tag not in VOID:
                stack.append((item.tag,))
                stack.extend(c if type(c) is Node else escape(c, quote=False) for c in reversed(item.children))
    return "".join(out)
