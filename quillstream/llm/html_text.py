"""Main text of web pages (op5) by tree scoring.

A tolerant scanner builds the tree of block elements (inline markup only marks link text). Each
paragraph passes points for its length and commas to its ancestors, all to the nearest container
and less further up; a container's points are discounted by its link density and raised where its
tag or name says it holds an article. The best container and those of its siblings that score or look
like text are kept, without the menus, notices, forms, comments and the like inside them; where an
article or main element holds the best container, it is that element that is kept.

A page is one row of one batch, so pages need no shuffle. Open elements are found by tag, so work is linear in the
page's length however deep it is nested (but for a tag with an unfinished quote, which is looked for to the page's end).

A name in class, id or role is boilerplate by itself only as a whole; where an article may use it of its own parts
(`discussion`, `notice-period`), controls, links or brevity must speak against the element too.

Defined results: a null or empty html gives an empty text with 0 characters; markup without any paragraph
gives what text its body has outside boilerplate; an unclosed element ends with its parent; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that end the text block before them. Others are inline.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption head title".split())
#: Elements whose text is never of the article.
DROPPED = frozenset("nav footer aside form search dialog menu select button textarea fieldset head title noscript template svg math iframe object canvas audio video map datalist input label".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LEAVES = HEADINGS | frozenset("p li dd dt pre td th blockquote figcaption caption summary address".split())
#: A start tag of the key's value ends an open element of the key.
ENDS = {"p": BLOCKS - {"option", "optgroup", "head", "title"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: Where a search for an open element to end stops.
SCOPES = frozenset(("table", "ul", "ol", "dl", "td", "th", "div", "section", "article", "main", "body", "html"))
#: Words in class, id or role that mark boilerplate; a container that holds most points may carry one of RARELY.
NEVER = frozenset("ad ads adv advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promotion comment comments commentlist disqus cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager login toast paywall contentinfo navigation".split())
#: Words that an article may use of its own parts too.
UNSURE = frozenset("respond reply replies discussion responses notice notices alert feedback dialog".split())
#: Words beside those of the sets above that say only how an element is laid out.
LAYOUT = frozenset("a area articles bar block bottom box btn button buttons center col container content group header icon icons inline inner item items left link links list main module outer panel post posts right row section slot stories text thread title top unit user users view widget widgets wrap wrapper".split())
CONTROLS = frozenset(("button", "form", "input", "select", "textarea"))
RARELY = frozenset("nav navbar menu sidebar aside complementary footer header masthead banner widget widgets toolbar search form hidden topbar".split())
GOOD = frozenset("article body content entry main page post story text blog hentry articlebody".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PARTS = re.compile(r"[a-z0-9]+")
COMMAS = re.compile("[,،、，;]")
#: Characters from which what has a doubtful name passes for a part of the article.
SECTION = 400


class Node:
    __slots__ = ("bad", "children", "controls", "depth", "doubt", "good", "headed", "inside", "links", "parent", "points", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, bad: int, good: bool, doubt: str = ""):
        self.tag, self.parent, self.bad, self.good, self.doubt = tag, parent, bad, good, doubt
        self.depth = parent.depth + 1 if parent is not None else 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.controls, self.headed = 0, tag in HEADINGS
        self.children: list = []  # nodes, and (text, is link) of inline runs
        self.points, self.text, self.links = 0.0, 0, 0


def _named(name: str) -> str:
    """What one name of a class, id or role says: never, rarely, whole or part (doubtful as a whole, or in part), good, or nothing."""
    parts = NAME_PARTS.findall(name)
    if not parts or parts[0] in ("has", "with", "no", "without"):
        return ""
    plain = [p for p in parts if not p.isdigit()]
    if any(p in NEVER for p in parts):
        return "never" if all(p in NEVER or p in RARELY or p in UNSURE or p in LAYOUT for p in plain) else "part"
    if any(p in UNSURE for p in parts):
        return "whole" if all(p in UNSURE or p in LAYOUT for p in plain) else "part"
    return "rarely" if any(p in RARELY for p in parts) else "good" if any(p in GOOD for p in parts) else ""


def _marks(tag: str, attributes: str) -> tuple[int, bool, str]:
    """(2: boilerplate, 1: boilerplate unless it holds most of the page, 0), whether the name speaks for an article, and doubt: whole, part or none."""
    bad = 2 if tag in DROPPED else 1 if tag == "header" else 0
    if not attributes:
        return bad, False, ""
    said: set[str] = set()
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id", "role"):
            said.update(map(_named, value.split()))
        elif (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (key == "aria-hidden" and value == "true"):
            bad = 2
    if "never" in said or re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attributes)):
        bad = 2
    elif "rarely" in said:
        bad = max(bad, 1)
    if tag in ("html", "body", "main"):
        return 0, "good" in said, ""
    doubt = "whole" if "whole" in said else "part" if "part" in said else ""
    if tag == "article":  # names of an article tell its kind
        return (0 if bad < 2 else bad), True, ""
    return bad, "good" in said and bad == 0, doubt if bad < 2 else ""


class _Open:
    """The elements that are open, found by tag without a climb through all ancestors."""

    def __init__(self, root: Node):
        self.node = root
        self.by: dict[str, list[Node]] = {}
        self.scopes: list[Node] = [root]
        self.walls: list[Node] = [root]  # scopes that an implied end does not pass

    def enter(self, child: Node) -> None:
        self.node = child
        self.by.setdefault(child.tag, []).append(child)
        if child.tag in SCOPES:
            self.scopes.append(child)
            if child.tag not in ("td", "th"):
                self.walls.append(child)

    def leave(self, end: Node) -> None:
        """Closes end and all that is open within it."""
        while True:
            gone = self.node
            self.by[gone.tag].pop()
            for stack in (self.scopes, self.walls):
                if stack[-1] is gone:
                    stack.pop()
            self.node = gone.parent
            if gone is end:
                return

    def to_end(self, tag: str) -> Node | None:
        """The element that an end tag closes."""
        own = self.by.get(tag)
        if not own or (tag in ("p", "li", "dd", "dt") and own[-1].depth < self.scopes[-1].depth):
            return None
        return own[-1]

    def implied(self, tag: str) -> Node | None:
        """The innermost element that a start tag ends."""
        open_ = (self.by[k][-1] for k, ends in ENDS.items() if tag in ends and self.by.get(k))
        found = max(open_, key=lambda x: x.depth, default=None)
        return found if found is not None and found.depth > self.walls[-1].depth else None


def parse(html: str) -> Node:
    """The tree of block elements."""
    root = Node("html", None, 0, False)
    open_ = _Open(root)
    link, at, n = 0, 0, len(html)
    lower = None

    def text(a: int, b: int) -> None:
        if b > a:
            open_.node.children.append((unescape(html[a:b]), link > 0))

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            rest = html.find("<", at)  # an unfinished tag at the very end is markup
            text(at, n if rest < 0 or not re.match(r"<[/a-zA-Z]", html[rest : rest + 2]) else rest)
            break
        text(at, m.start())
        at = m.end()
        close, tag, attributes = m.group(1), m.group(2), m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            if tag == "a":
                link = 0
            elif (end := open_.to_end(tag)) is not None:
                open_.leave(end)
                link = 0
            continue
        if tag in CONTROLS:
            open_.node.controls += 1
        if tag in RAW:
            lower = lower if lower is not None else html.lower()
            if len(lower) != n:  # a few letters change length in lower case
                lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in html)
            end_at = lower.find(f"</{tag}", at)
            at = n if end_at < 0 else html.find(">", end_at) + 1 or n
            continue
        if tag == "br":
            open_.node.children.append((" ", False))
        elif tag == "a":
            link = 1
        if tag in VOID and tag != "hr" or not (tag in BLOCKS or tag in DROPPED):
            continue
        if (end := open_.implied(tag)) is not None:
            open_.leave(end)
            link = 0
        if tag == "hr":
            open_.node.children.append(Node("hr", open_.node, 0, False))
        if tag in ("html", "body", "hr"):
            continue
        child = Node(tag, open_.node, *_marks(tag, attributes))
        open_.node.children.append(child)
        if not attributes.endswith("/"):
            open_.enter(child)
            link = 0
    return root


def _walk(root: Node) -> Iterator[Node]:
    """Nodes in page order, without what is boilerplate for certain."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.bad < 2)


def _runs(node: Node) -> Iterator[tuple[str, int]]:
    """Text blocks that stand directly in a node, with the characters of their links."""
    parts: list[tuple[str, bool]] = []
    for c in [*node.children, None]:
        if isinstance(c, tuple):
            parts.append(c)
        elif parts:
            if t := " ".join("".join(p for p, _ in parts).split()):
                yield t, sum(len(" ".join(p.split())) for p, is_link in parts if is_link)
            parts = []


def _score(root: Node) -> list[Node]:
    nodes = list(_walk(root))
    for node in nodes:
        for t, links in _runs(node):
            node.text += len(t)
            node.links += links
            if len(t) < 25 or links > 0.5 * len(t) or node.tag in HEADINGS:
                continue
            points = 1 + len(COMMAS.findall(t)) + min(len(t) / 100, 3)
            up, level = node.parent if node.tag in LEAVES and node.parent is not None else node, 0
            while up is not None and level < 6:
                up.points += points / (1, 2, 6, 9, 12, 15)[level]
                up, level = up.parent, level + 1
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.links += node.links
            node.parent.controls += node.controls
            node.parent.headed |= node.headed
    for node in nodes:
        if node.doubt:
            _settle(node)
    return nodes


def _settle(node: Node) -> None:
    """A doubtful name alone does not make boilerplate. A part of one needs controls or mostly links beside it; a whole one needs
    them too, or to be short and without a heading, for sections of an article have one."""
    linked = node.links / max(node.text, 1)
    if node.controls or linked > 0.5 or (node.doubt == "whole" and (linked > 0.3 or (not node.headed and node.text < SECTION))):
        node.bad = 2


def _value(node: Node) -> float:
    bonus = 25 * (node.tag in ("article", "main")) + 10 * node.good - 25 * (node.bad > 0)
    return (node.points + (bonus if node.text else 0)) * (1 - node.links / max(node.text, 1))


def _text(node: Node, out: list[str], keep: Node | None = None) -> None:
    """Text blocks below a node in page order, without boilerplate and menus of links."""
    stack: list = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
            continue
        own: list = []
        parts: list[str] = []
        for c in [*top.children, None]:
            if isinstance(c, tuple):
                parts.append(c[0])
                continue
            if parts:
                if t := " ".join("".join(parts).split()):
                    own.append(t)
                parts = []
            if c is None or c.bad == 2 or (c.bad == 1 and not (c.tag == "header" and c.inside)):
                continue
            if c.tag in ("ul", "ol", "div", "section", "table") and c.links > 0.8 * c.text and len(c.children) > 1:
                continue
            own.append(c)
        stack.extend(reversed(own))


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    root = parse(html)
    nodes = _score(root)
    total = sum(n.points for n in nodes) or 1
    held = max((n.points for n in nodes if n.tag in ("article", "main")), default=0)
    for n in nodes:  # a name like `sidebar` on what holds most of the page is layout
        if n.bad == 1 and n.tag != "header" and n.points > 0.3 * total and held <= n.points:
            n.bad = 0
    best = max((n for n in nodes if n.bad < 2), key=_value)
    if _value(best) <= 0:
        best = root
    up = best
    while up is not None:
        if up.tag in ("article", "main") or up.parent is None:
            break
        up = up.parent
    out: list[str] = []
    if up is not None and up.tag in ("article", "main"):
        _text(up, out)
    elif best.parent is None or best.tag in LEAVES:
        _text(root, out)
    else:
        least = max(10, 0.2 * _value(best))
        for c in best.parent.children:
            if c is best:
                _text(c, out)
            elif isinstance(c, Node) and c.bad == 0 and c.links <= 0.33 * c.text and (_value(c) >= least or c.tag in LEAVES):
                _text(c, out)
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column("html")]
            # A lone surrogate (from a reference such as &#xD800;) has no UTF-8 form.
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
