"""Main text of web pages by tree scoring.

A page is read into a tree of its block elements; inline markup only matters for links. Paragraphs pass points for
their length and commas to their ancestors, less with distance; an ancestor's points are discounted by its link density.
The best container is kept, with those of its siblings that score well; a surrounding article or main element is taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = frozenset("script style noscript template title textarea iframe noembed noframes xmp svg math select option datalist canvas audio video object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend button label".split()
)
#: Ancestors that get points of a paragraph.
_ANCESTORS = 12
#: What an opening tag closes, and the elements beyond which it does not look.
_CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tr td th", ("table",))}
_CLOSES_P = _BLOCK - {"html", "body", "head", "button", "label", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
_DROPPED = frozenset("nav footer aside form dialog menu search button label fieldset head".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Whole words of class and id names; a word that only begins like one of them (football, shareholder) is none.
_BAD = re.compile(
    r"(?:^|[-_\s])(?:nav(?:bar|igation|menu)?s?|(?:sub|main|top|site)?nav|(?:sub|main|top|site)?menus?|side-?bars?|foot|(?:page|site)?footers?|comments?|commentlist|disqus\w*|respon[ds]e?|repl(?:y|ies)|ads?|advert(?:s|isement|isements|ising|orial)?|adsense|adv|banners?|promos?|promotions?|promoted|sponsor(?:s|ed|ship)?|cookies?|cookie(?:bar|banner|notice)|consent|gdpr|notices?|alerts?|notifications?|popups?|modals?|overlays?|newsletters?|subscri(?:be|ption|ptions)|signup|login|shares?|sharing|share(?:bar|buttons?|links?)|socials?|social(?:bar|links?|media|share)|related|recommend(?:ed|ations?)|breadcrumbs?|pag(?:er|ination)|widgets?|toolbars?|tags|meta|byline|disclaimer|copyright|legal|skip(?:link|nav)?|hidden|outbrain|taboola)(?=$|[-_\s\d])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[-_\s])(?:(?:page|site|top|global|main|mast)[-_]?head(?:er)?|(?<!entry.)(?<!article.)(?<!post.)(?<!story.)(?<!content.)header|masthead)(?=$|[-_\s\d])", re.I)
#: Names that a paragraph within an article may have and yet be part of it.
_OWN = re.compile(r"(?:^|[-_\s])(?:legal|disclaimer|copyright|alerts?|respon[ds]e?|repl(?:y|ies)|meta)(?=$|[-_\s\d])", re.I)
#: Names of boilerplate that may hold more prose than the article.
_PROSE = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|respon[ds]|repl(?:y|ies)|cookie|consent|gdpr|popup|modal|overlay|newsletter|disclaimer|copyright|legal)", re.I)
#: Share of a page's prose that only an element around its main text holds.
_MOST = 0.8
_GOOD = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
_BASE = {"article": 15, "main": 10, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5}
_PARAGRAPH = frozenset("p pre td blockquote div section article main body li dd".split())


class _Node:
    __slots__ = ("children", "links", "parent", "points", "said", "suspect", "tag", "words")

    def __init__(self, tag: str, parent: _Node | None, said: str = ""):
        self.tag, self.parent, self.said, self.children = tag, parent, said, []
        self.points, self.links, self.words = 0.0, 0, 0
        self.suspect = ""


class _Stack(list):
    """Open elements, with the number of each tag's, so that deep markup is not searched for what it has not."""

    def __init__(self, root: _Node):
        super().__init__([root])
        self.counts: dict[str, int] = {root.tag: 1}

    def push(self, node: _Node) -> None:
        self.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def cut(self, n: int) -> None:
        """Close the elements from the n-th on."""
        while len(self) > n:
            self.counts[self.pop().tag] -= 1

    def has(self, *tags: str) -> bool:
        return any(self.counts.get(t) for t in tags)


def _is_boilerplate(tag: str, found: dict[str, str], inside: bool) -> bool:
    if tag in _DROPPED:
        return True
    if tag == "header":
        return not inside
    if tag in ("html", "body"):
        return False
    if found.get("role", "").lower() in _DROPPED_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    return tag in ("article", "main") and bool(re.search(r"(?:^|[-_\s])comments?(?=$|[-_\s])", f"{found.get('class', '')} {found.get('id', '')}", re.I))


def _suspicion(tag: str, found: dict[str, str], inside: bool) -> str:
    """Class and id of an element that one of them names as boilerplate; headers are none within an article."""
    if tag in ("html", "body", "article", "main", "header"):
        return ""
    names = [unescape(found[k]) for k in ("class", "id") if found.get(k)]
    if inside and tag == "p":
        names = [_OWN.sub(" ", x) for x in names]
    return " ".join(names) if any(_BAD.search(x) or not inside and _HEADER.search(x) for x in names) else ""


def _without_boilerplate(root: _Node) -> _Node:
    """Take out the elements with boilerplate's names, but not those around an article or, on a page without one, most of its prose."""
    order, pending = [], [root]
    while pending:
        node = pending.pop()
        order.append(node)
        pending += [c for c in node.children if isinstance(c, _Node)]
    if not any(n.suspect for n in order):
        return root
    prose, holds = {}, {}
    for node in reversed(order):
        below = [c for c in node.children if isinstance(c, _Node)]
        own = sum(len(c[0].strip()) for c in node.children if isinstance(c, tuple) and not c[1]) if node.tag in _PARAGRAPH else 0
        prose[node] = own + sum(prose[c] for c in below)
        holds[node] = any(c.tag in ("article", "main") or holds[c] for c in below)
    for node in order:
        most = not holds[root] and prose[node] > _MOST * prose[root] and not _PROSE.search(node.suspect)
        if node.suspect and not holds[node] and not most:
            node.parent.children.remove(node)
    return root


def parse(html: str) -> _Node:
    """The tree of block elements; children are nodes and (text, linked) pairs. Boilerplate elements are left out whole."""
    root = _Node("html", None)
    stack, skipped, linked, at = _Stack(root), 0, 0, 0
    dropped: list[str] = []  # open elements within a boilerplate element, from that on

    def text(upto: int) -> None:
        if upto > at and not dropped:
            stack[-1].children.append((html[at:upto], linked > 0))

    for m in iter(lambda: _TOKEN.search(html, skipped), None):
        text(m.start())
        at = skipped = m.end()
        close, tag = m[1], m[2]
        if tag:
            tag = tag.lower()
            if tag in _RAW:
                if not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = skipped = end.end() if end else len(html)
                continue
            if tag == "br" or tag == "hr":
                if not dropped:
                    stack[-1].children.append((" ", linked > 0))
            elif tag in _VOID:
                pass
            elif dropped:
                if tag == "p" and dropped[-1] == "p":
                    dropped.pop()
                if tag in _BLOCK:
                    dropped.append(tag)
            elif tag in _BLOCK:
                if tag in _CLOSES_P:
                    _close(stack, ("p",), ("td", "th", "button", "table"))
                if tag in _CLOSES:
                    names, stop = _CLOSES[tag]
                    _close(stack, names.split(), stop)
                if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
                    stack.cut(len(stack) - 1)
                if tag in ("html", "body"):
                    if tag == "html" or stack.has(tag):
                        continue
                found = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in _ATTRIBUTE.finditer(m[3])} if m[3].strip() else {}
                inside = stack.has("article", "main")
                if _is_boilerplate(tag, found, inside):
                    dropped.append(tag)
                else:
                    node = _Node(tag, stack[-1], m[3])
                    node.suspect = _suspicion(tag, found, inside)
                    stack[-1].children.append(node)
                    stack.push(node)
            elif tag == "a":
                linked = 1
            elif tag == "span" or tag == "ins":
                pass
        elif close:
            close = close.lower()
            if dropped:
                if close in dropped:
                    while dropped.pop() != close:
                        pass
                elif close in ("article", "main", "body", "html") and stack.has(close):
                    dropped.clear()
                    _close(stack, (close,), ())
            elif close == "a":
                linked = 0
            elif close in _BLOCK and close not in ("html", "body"):
                _close(stack, (close,), ())
                if close not in ("p",):
                    linked = 0
    text(len(html))
    return _without_boilerplate(root)


def _close(stack: _Stack, names: tuple | list, stop: tuple) -> None:
    while stack.has(*names):
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].tag in names:
                stack.cut(n)
                break
            if stack[n].tag in stop:
                return
        else:
            return
        if len(names) == 1 or stack[-1].tag not in names:
            return


def _own_text(node: _Node) -> str:
    return " ".join(unescape("".join(c[0] for c in node.children if isinstance(c, tuple))).split())


def _score(root: _Node) -> list[_Node]:
    """Points of all nodes; returns the nodes in page order."""
    order, pending = [], [root]
    while pending:
        node = pending.pop()
        order.append(node)
        pending += [c for c in reversed(node.children) if isinstance(c, _Node)]
    for node in order:
        text = _own_text(node)
        linked = sum(len(c[0].strip()) for c in node.children if isinstance(c, tuple) and c[1])
        node.words += len(text)
        node.links += min(linked, len(text))
        if text and node.tag in _PARAGRAPH:
            points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)
            above, share = (node if node.tag in ("div", "section", "article", "main", "body", "td") else node.parent), 1.0
            level = 0
            while above is not None and level <= _ANCESTORS:
                above.points += points * share
                level += 1
                share = 0.5 if level == 1 else 1 / (level * 3)
                above = above.parent
    for node in reversed(order):
        if node.parent is not None:
            node.parent.words += node.words
            node.parent.links += node.links
    for node in order:
        if node.points:
            node.points += _BASE.get(node.tag, 0) + (10 if _GOOD.search(node.said) else 0)
            node.points *= 1 - node.links / node.words if node.words else 0
    return order


def _render(top: _Node, out: list[str], whole: bool) -> None:
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(text)

    pending: list = [top]
    while pending:
        item = pending.pop()
        if isinstance(item, tuple):
            parts.append(item[0])
            continue
        flush()
        if item is None:  # the end of an element
            continue
        if not whole and item.tag in ("ul", "ol", "table", "div", "section", "dl") and item.words and item.links / item.words > 0.6 and item.links > 20:
            continue  # a list of links
        pending.append(None)
        pending += reversed(item.children)
    flush()


def extract(html: str | None) -> str:
    """The main text: its blocks in page order, joined by one newline; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    order = _score(root)
    best = max((n for n in order if n.points > 0), key=lambda n: n.points, default=None)
    if best is None:
        best = next((n for n in order if n.tag in ("article", "main")), root)
    whole, above = None, best
    while above is not None:
        if above.tag in ("article", "main"):
            whole = above
        above = above.parent
    blocks: list[str] = []
    if whole is not None or best.parent is None:
        _render(whole or best, blocks, whole is not None)
    else:
        least = max(10.0, best.points * 0.2)
        for child in best.parent.children:
            if not isinstance(child, _Node):
                continue
            density = child.links / child.words if child.words else 0
            like_text = child.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and (density < 0.25 and child.words > 80 or density == 0 and child.words > 0)
            if child is best or child.points >= least or like_text:
                _render(child, blocks, False)
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars (code points) of each page's main text; one row for each input row, in a narrow scan.

    Null, empty and text-free pages have an empty text. Ids and urls go through as they are, nulls too; other columns are left
    out. Truncated markup is read as far as it goes. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long")
