"""Main text of web pages by tree scoring.

A page is parsed into a tree. Paragraphs pass points for their length and commas to their ancestors, less with each
step up; an ancestor's score is discounted by its link density. An article or main that holds the best container
is kept whole, with its sibling articles that score alike, else the container and all from the first to the last of its siblings
that score well, with the headings before and the short sections after them.

What elements are called is weighed. Names that say what an element is for, such as comments or adverts, take it out at any
size. Names of layout, such as sidebar or widget, and forms only lower the score: such an element goes if the best container
lies elsewhere. Names of what a page has or has not say nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, with raw text, that are blocks, and that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
UNWANTED = frozenset("head nav header footer aside button select option input label script style textarea title noscript iframe template svg canvas object dialog menu".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())
#: Closed by the tags on the right; the search goes no higher than SCOPE.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("html body article section main div table ul ol dl td th blockquote nav header footer aside form".split())
#: Words in a class, id or role that say what an element is for, whatever other words stand beside them.
SURE = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted banner cookie cookies consent gdpr popup modal overlay newsletter
subscribe subscription signup paywall nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer share sharing comment comments commentlist disqus
tagcloud contentinfo""".split())
#: Words that say so alone, or beside words of structure alone: ``related-posts`` but not ``related-work``.
UNSURE = frozenset("""promotion notice notices notification alert menu toolbar related recommended recommendations social respond reply replies discussion feedback skip tags
search login complementary""".split())
STRUCTURE = frozenset("""site main top bottom left right primary secondary container wrapper wrap box list area section bar block inner outer item items link links page post posts
article articles story stories body form group global button buttons icon icons panel title message slot thread""".split())
#: Words of layout, and words after which a name says what a page has.
LAYOUT = frozenset("header sidebar side rail widget widgets hidden".split())
HAVING = frozenset("has have no with without is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may follow a heading in a short section, and what a score inside of layout or a form counts.
SECTION, LOWERED = frozenset("p ul ol dl pre blockquote table figure".split()), 0.1

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s\"'/]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "items", "unwanted", "score", "text", "linked", "marked")

    def __init__(self, tag: str, parent: "Node | None", unwanted: bool = False):
        self.tag, self.parent, self.unwanted = tag, parent, unwanted
        self.items: list[Node | str] = []
        self.score, self.text, self.linked, self.marked = 0.0, 0, 0, 0


def _hidden(attrs: str) -> bool:
    return any(name.lower() == "hidden" or (name.lower() == "aria-hidden" and (a or b or c).lower() == "true") for name, a, b, c in _ATTR.findall(attrs))


def _marked(attrs: str) -> int:
    """2 if a name in a class, id or role says that it is no main text, 1 if it is one of layout, else 0."""
    found = 0
    for name, a, b, c in _ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role"):
            for token in (a or b or c).split():
                said = [w.lower() for w in _WORD.findall(token) if not w.isdigit()]
                if any(w in HAVING for w in said):
                    continue
                if any(w in SURE for w in said) or (any(w in UNSURE for w in said) and all(w in UNSURE or w in STRUCTURE or w in LAYOUT for w in said)):
                    return 2
                if any(w in LAYOUT for w in said):
                    found = 1
    return found


def _holders(root: Node) -> set[int]:
    """Elements that are or hold a main or an article that is not marked itself."""
    holds: set[int] = set()
    for node in reversed(_order(root)):
        if node.tag == "main" or (node.tag == "article" and node.marked < 2) or any(id(x) in holds for x in node.items if isinstance(x, Node)):
            holds.add(id(node))
    return holds


class _Open:
    """The open elements of a page, with the places of each tag among them, so that no tag has to climb to find its like."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at this place and all in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags: frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end(self, name: str) -> None:
        """An end tag closes the last element of its name; only one of SCOPE goes beyond elements of SCOPE."""
        at = self.places.get(name)
        if at and (name in SCOPE or at[-1] > self.last(SCOPE)):
            self.cut(at[-1])

    def begin(self, name: str) -> None:
        """A start tag closes the first of the elements that it ends, but for those beyond an element of SCOPE."""
        ends = CLOSES.get(name, frozenset())
        tags = [t for t in (ends | {"p"} if name in BLOCKS else ends) if self.places.get(t)]
        if tags:
            low = self.last(SCOPE - ends)
            found = [at[k] for at in map(self.places.get, tags) if (k := bisect_right(at, low)) < len(at)]
            if found:
                self.cut(min(found))


def _tag_end(html: str, pos: int, failing: set[int]) -> int:
    """Where the > of a tag is whose name ends at ``pos``: the first outside quotes, or, if a quote does not end, the first.
    ``failing`` has the quotes from which an earlier tag has come to one that does not end, so none is followed twice."""
    at, seen = pos, []
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.start()
        if m.start() in failing:
            break
        seen.append(m.start())
        at = html.find(m[0], m.end()) + 1
        if not at:
            break
    failing.update(seen)
    return html.find(">", pos)


def parse(html: str) -> Node:
    """The tree of a page, in time linear in its length. Open elements end with the page; stray ends are ignored."""
    root = Node("html", None)
    open_, pos, n, last, failing = _Open(root), 0, len(html), html.rfind(">"), set()
    while pos < n:
        lt = html.find("<", pos)
        items = open_.nodes[-1].items
        if lt < 0:
            items.append(unescape(html[pos:]))
            break
        if lt > pos:
            items.append(unescape(html[pos:lt]))
        m = _TAG.match(html, lt)
        if not m or (m["name"] and m.end() > last):
            items.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        if not m["name"]:
            if m["cdata"]:
                items.append(m["cdata"])
            continue
        end = _tag_end(html, pos, failing)
        name, attrs, pos = m["name"].lower(), html[pos:end], end + 1
        if m["close"]:
            open_.end(name)
            continue
        if name == "html":
            continue
        open_.begin(name)
        at = open_.nodes[-1]
        titled = name == "header" and bool(open_.places.get("article"))  # an article's own header has its title
        node = Node(name, at, (name in UNWANTED and not titled) or (name != "body" and _hidden(attrs)))
        node.marked = 0 if name == "body" or name in HEADINGS else max(_marked(attrs), int(name == "form"))
        if titled:
            node.marked = 0
        at.items.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else n
        elif name not in VOID and (name in BLOCKS or not attrs.endswith("/")):
            open_.push(node)
    return root


def _order(root: Node) -> list[Node]:
    """Wanted nodes, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.unwanted:
            continue
        out.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return out


def _points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def _score(root: Node) -> tuple[list[Node], dict[int, float]]:
    """Wanted nodes and the worth of each: its score, to which text inside of layout and forms adds less, discounted by its link density."""
    nodes, lowered = _order(root), set()
    for node in nodes:
        if node.marked or (node.parent is not None and id(node.parent) in lowered):
            lowered.add(id(node))
        node.text = node.linked = 0
        node.score = (LOWERED if id(node) in lowered else 1) * {"article": 25.0, "main": 25.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0}.get(node.tag, 0.0)
    for node in reversed(nodes):
        own = [" ".join(x.split()) for x in node.items if isinstance(x, str)]
        node.text += sum(map(len, own))
        if node.tag == "a":
            node.linked = node.text
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
    for node in nodes:
        if node.tag not in PARAGRAPHS:
            continue
        inline = "".join(_inline(node))
        said = " ".join(inline.split())
        if not said:
            continue
        points = _points(said) * (1 - node.linked / max(node.text, 1)) * (LOWERED if id(node) in lowered else 1)
        up, level = (node.parent, 1) if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") or node.tag in HEADINGS else (node, 1)
        while up is not None and level <= 5:
            up.score += points / (1 if level == 1 else 2 if level == 2 else 3 * level)
            up, level = up.parent, level + 1
    return nodes, {id(x): x.score * (1 - x.linked / max(x.text, 1)) for x in nodes}


def _top(nodes: list[Node], worth: dict[int, float]) -> Node | None:
    leaves = ("p", "li", "td", "th", "tr", "tbody", "dd", "dt", "pre", *HEADINGS)
    return max((x for x in nodes if x.tag in BLOCKS and x.tag not in leaves and x.text), key=lambda x: worth[id(x)], default=None)


def best(root: Node) -> list[Node | str]:
    """The nodes to keep, in page order."""
    holds = _holders(root)
    for node in _order(root):
        node.unwanted |= node.marked == 2 and id(node) not in holds
        if id(node) in holds:
            node.marked = 0
    nodes, worth = _score(root)
    top = _top(nodes, worth)
    if any(x.marked for x in nodes):
        around, up = set(), top
        while up is not None:
            around.add(id(up))
            up = up.parent
        for x in nodes:
            x.unwanted |= bool(x.marked) and id(x) not in around
            if id(x) in around:
                x.marked = 0
        nodes, worth = _score(root)
        top = _top(nodes, worth)
    if top is None:
        return [root]
    up = top
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is None and top.parent is None:
        return [top]
    if up is not None and (up.tag == "main" or up.parent is None):
        return [up]
    at = up or top
    siblings = at.parent.items
    least = 0.5 * worth[id(up)] if up is not None else max(10.0, 0.2 * worth[id(top)])
    kept = []
    for k, x in enumerate(siblings):
        if x is at:
            kept.append(k)
        elif isinstance(x, Node) and not x.unwanted and x.text:
            if up is not None:
                if x.tag == "article" and worth[id(x)] >= least:
                    kept.append(k)
            elif (x.tag in BLOCKS and worth[id(x)] >= least) or (x.tag == "p" and x.text > 80 and x.linked < 0.25 * x.text):
                kept.append(k)
    first, last = kept[0], kept[-1]
    if up is None:
        first, last = _with_headings(siblings, first, last)
    return siblings[first : last + 1]


def _with_headings(siblings: list[Node | str], first: int, last: int) -> tuple[int, int]:
    """A range of siblings with the headings right before it, and, after it, each heading with what a short section has."""
    blank = lambda x: isinstance(x, str) and not x.strip() or isinstance(x, Node) and x.unwanted
    k = first - 1
    while k >= 0 and (blank(siblings[k]) or isinstance(siblings[k], Node) and siblings[k].tag in HEADINGS):
        first = k if not blank(siblings[k]) else first
        k -= 1
    k, section = last + 1, False
    while k < len(siblings):
        x = siblings[k]
        if not blank(x):
            section = isinstance(x, Node) and (x.tag in HEADINGS or (section and x.tag in SECTION and x.linked < 0.5 * max(x.text, 1)))
            if not section:
                break
            last = k
        k += 1
    return first, last


def _inline(node: Node) -> Iterator[str]:
    """The text of a node outside its blocks."""
    stack = [*reversed(node.items)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif x.tag == "br":
            yield " "
        elif not x.unwanted and x.tag not in BLOCKS:
            stack.extend(reversed(x.items))


def _blocks(nodes: list[Node | str]) -> list[str]:
    """Blocks of text in page order: each run of inline content between the edges of block elements."""
    out: list[str] = []
    now: list[str] = []
    end = object()
    stack: list = [*reversed(nodes)]

    def flush() -> None:
        if said := " ".join("".join(now).split()):
            out.append(said)
        now.clear()

    while stack:
        x = stack.pop()
        if x is end:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif not x.unwanted:
            if x.tag in BLOCKS:
                flush()
                stack.append(end)
            stack.extend(reversed(x.items))
    flush()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page: blocks with single spaces, joined by an empty line; empty if there is none."""
    if not html or not html.strip():
        return ""
    return "\n\n".join(_blocks(best(parse(html))))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Returns page_id, url, text and n_chars for each row, repeated ones too. Null and empty pages have an empty text;
    null ids and addresses stay null; other columns are ignored. No exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
