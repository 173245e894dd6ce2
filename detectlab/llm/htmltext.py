"""Main text of web pages by tree scoring.

Paragraphs (and loose text of a container, as if it stood in one) earn points for length and commas and pass them to their
ancestors: all to the parent, half to its parent, less above. A container's score is discounted by its link density. The
best container is kept with those siblings that look like more of the article; inside an article or main element, with all
that is not link-dense. Within what is kept, menus, headers, footers, sidebars, notices, adverts, forms and reader comments go,
told by element, role or the words of class and id. A class word alone does not remove text that has neither links nor form fields if
the class says something else as well (``notice-period``). Inside a container that is named as an article, post or content all is
kept as well. A title in the article's own header stays. A form, or an element told by such words, that holds most of the page's text
is unwrapped, unless it is named as reader comments or the page's article or title stands elsewhere.

Blocks are joined by one space; white space within a block is one space; inline elements add none. Nothing is cut off.

Nulls, ties, empties: a null or empty page has the empty text; one without any paragraph has its title; of containers with equal
scores the first on the page is taken; pages are read alone, so repeated rows, null ids and urls and other columns need
nothing of their own. Trees are walked without recursion, so deep nesting is no limit.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import map_texts

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead title tr ul".split()
)
_NEVER = frozenset(
    "head title script style noscript template iframe object embed canvas svg math nav aside header footer form button input"
    " select option textarea dialog menu audio video".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_PARAGRAPHS = frozenset("p pre blockquote td dd li figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the key is ended by the start of one of these.
_CLOSED_BY = {
    "p": _BLOCKS - {"br", "title", "option", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"},
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
#: Where the search for an open element to end stops.
_SCOPES = frozenset("html body table ul ol dl div article section main td th blockquote form aside nav header footer".split())

_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ASIDE_WORDS = frozenset(
    "ad ads adsense adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted nav navbar navigation"
    " menu breadcrumb breadcrumbs footer header masthead sidebar aside rail banner cookie cookies consent gdpr notice alert popup"
    " modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations outbrain"
    " taboola comment comments commentlist respond reply replies disqus discussion pagination pager toolbar widget search form"
    " paywall teaser copyright skip notices disclaimer announcement toast".split()
)
#: Parts of words that say the same when they are written together, as in ``rightsidebar``.
_ASIDE_STEMS = ("sidebar", "sidenav", "navbar", "breadcrumb", "masthead", "comment", "cookie", "advert", "newsletter", "disqus")
_ARTICLE_WORDS = frozenset(["commentary", "commented", "uncommented"])
_COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: Parts of class names that say nothing about what an element holds.
_PLAIN_WORDS = frozenset(
    "container wrapper wrap box block inner outer slot unit bar list item items section area content text main left right top bottom"
    " post posts article articles stories story links link news media policy message info body panel group row col column col title"
    " label button buttons icon icons module zone region field fields page site global sticky fixed small large js no has is the".split()
)
#: Names of containers that are the article.
_CONTENT_WORDS = frozenset("article post entry content story".split())
_LEAST_SIBLING = 0.2
NAMED, CERTAIN = 1, 2


class _Node:
    __slots__ = ("tag", "parent", "items", "gone", "score", "text", "links", "aside", "words")

    def __init__(self, tag: str, parent: _Node | None, gone: bool, aside: int):
        self.tag, self.parent, self.gone, self.aside = tag, parent, gone, aside
        self.items: list[str | _Node] = []
        self.score, self.text, self.links = 0.0, 0, 0
        self.words: frozenset[str] = frozenset()  # of class and id


def _is_aside(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """Told by role (CERTAIN) or by a word of class or id (NAMED; CERTAIN for comments); the page's frame is never one."""
    if tag in ("html", "body"):
        return 0
    found = 0
    for name, value in attrs:
        if name in ("class", "id") and value:
            words = {w.lower() for w in _PARTS.findall(value)}
            if not _ASIDE_WORDS.isdisjoint(words) or any(s in w for w in words - _ARTICLE_WORDS for s in _ASIDE_STEMS):
                comments = not _COMMENT_WORDS.isdisjoint(words) or any("comment" in w for w in words - _ARTICLE_WORDS)
                found = CERTAIN if comments else max(found, NAMED)
        elif name == "role" and value and value.strip().lower() in _ROLES:
            return CERTAIN
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return CERTAIN
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return CERTAIN
    return found


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("html", None, False, 0)
        self.nodes = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = self.open
        if tag in _BLOCKS and tag != "br":
            while at is not self.root and at.tag not in _SCOPES:
                if tag in _CLOSED_BY.get(at.tag, ()):
                    self.open = at.parent
                at = at.parent
            if at.tag in _CLOSED_BY and tag in _CLOSED_BY[at.tag]:
                self.open = at.parent
        if tag in ("html", "body") and self.open is self.root:
            if tag == "html":
                return
        parent = self.open
        node = _Node(tag, parent, tag in _NEVER, _is_aside(tag, attrs))
        named = [v for n, v in attrs if n in ("class", "id") and v]
        if named:
            node.words = frozenset(w.lower() for v in named for w in _PARTS.findall(v))
        parent.items.append(node)
        self.nodes.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open.tag == tag:
            self.open = self.open.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at is not self.root and at.tag != tag:
            # An inline end tag doesn't end the block around it.
            if tag not in _BLOCKS and at.tag in _BLOCKS:
                return
            at = at.parent
        if at is not self.root:
            self.open = at.parent

    def handle_data(self, data: str) -> None:
        if self.open.tag not in ("script", "style"):
            self.open.items.append(data)


def _length(text: str) -> int:
    return len(" ".join(text.split()))


def _own_text(node: _Node) -> str:
    """Text of a node and its inline elements, without the blocks in it."""
    out, stack = [], [iter(node.items)]
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                out.append(item)
            elif item.tag in _BLOCKS:
                out.append(" ")
            elif not item.gone and not item.aside:
                stack.append(iter(item.items))
                break
        else:
            stack.pop()
    return "".join(out)


def _within(node: _Node, other: _Node) -> bool:
    at: _Node | None = node
    while at is not None and at is not other:
        at = at.parent
    return at is not None


def _keep_texts(nodes: list[_Node]) -> None:
    """Elements whose class has an aside's word among words of its own stay if they are text alone; so does an article's own title."""
    some = [n for n in nodes if n.aside == NAMED and n.words - _ASIDE_WORDS - _PLAIN_WORDS and not any(w.isdigit() for w in n.words)]
    if some:
        busy: set[int] = set()
        for node in reversed(nodes):
            if node.tag in ("a", "form", "input", "button", "select", "iframe", "img") or id(node) in busy:
                busy.add(id(node))
                if node.parent is not None:
                    busy.add(id(node.parent))
        for node in some:
            own = node.words - _ASIDE_WORDS - _PLAIN_WORDS
            if id(node) not in busy and not any(s in w for w in own for s in _ASIDE_STEMS):
                node.aside = 0
    for node in nodes:
        if node.tag == "header" and node.gone and not node.aside:
            at = node.parent
            while at is not None and at.tag not in ("article", "main"):
                at = at.parent
            if at is None:
                continue
            titles, stack = [], [node]
            while stack:
                inner = stack.pop()
                if inner.tag == "h1":
                    titles.append(inner)
                elif inner is node or not inner.gone and not inner.aside:
                    stack += [i for i in inner.items if not isinstance(i, str)]
            if titles:
                node.gone, node.items = False, list(reversed(titles))
                for title in titles:
                    title.parent = node


def _unwrap(nodes: list[_Node]) -> None:
    """Forms and elements with an aside's name that hold most of the page's text, without links, are containers like others."""
    if not any(n.tag == "form" or n.aside == NAMED for n in nodes):
        return
    held: dict[int, int] = {}
    for node in reversed(nodes):
        if node.tag == "a" or node.aside == CERTAIN or node.gone and node.tag != "form":
            held[id(node)] = 0
            continue
        total = held[id(node)] = held.get(id(node), 0) + sum(_length(i) for i in node.items if isinstance(i, str))
        if node.parent is not None:
            held[id(node.parent)] = held.get(id(node.parent), 0) + total
    marks = [n for n in nodes if n.tag in ("article", "main", "h1") and held[id(n)]]
    for node in nodes:
        if not (node.tag == "form" or node.aside == NAMED) or node.aside == CERTAIN or 2 * held[id(node)] <= held[id(nodes[0])]:
            continue
        # An article, or a title, that stands elsewhere says that this is none.
        placed = [_within(m, node) or m.tag != "h1" and _within(node, m) for m in marks]
        if all(placed) and (placed or node.tag == "form"):
            node.aside, node.gone = 0, node.gone and node.tag != "form"


def _measure(nodes: list[_Node]) -> None:
    """Text and link lengths, from the leaves up; what is set aside counts nowhere."""
    for node in nodes[1:]:
        node.gone = node.gone or node.parent.gone or node.parent.aside
    for node in reversed(nodes):
        if node.gone or node.aside:
            continue
        node.text += sum(_length(i) for i in node.items if isinstance(i, str))
        if node.tag == "a":
            node.links = node.text
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.links += node.links


def _score(nodes: list[_Node]) -> list[_Node]:
    """Scores of all containers; those with any."""
    scored: dict[int, _Node] = {}
    for node in nodes:
        if node.gone or node.aside or node.tag not in _BLOCKS or node.tag in _HEADINGS or node.tag == "br":
            continue
        own = " ".join(_own_text(node).split())
        if not own:
            continue
        points = 1.0 + own.count(",") + own.count("，") + own.count("、") + min(len(own) / 100, 10.0)
        if node.text:
            points *= 1 - node.links / node.text
        at, share = (node.parent if node.tag in _PARAGRAPHS else node), 1.0
        level = 1
        while at is not None:
            at.score += points * share
            scored[id(at)] = at
            level += 1
            share = 1 / 2 if level == 2 else 1 / (3 * level)
            at = at.parent
    for node in scored.values():
        node.score *= 1 - (node.links / node.text if node.text else 0)
    return list(scored.values())


def _has(node: _Node, tag: str) -> bool:
    stack = [node]
    while stack:
        at = stack.pop()
        if at.tag == tag and not at.gone and not at.aside:
            return True
        stack += [i for i in at.items if not isinstance(i, str)]
    return False


def _drop_linked(best: _Node, around: _Node) -> None:
    """What is mostly links beside the best container, up to the article around it."""
    at = best
    while at is not around:
        for item in at.parent.items:
            if item is not at and not isinstance(item, str) and item.tag in _BLOCKS and 2 * item.links > item.text:
                item.gone = True
        at = at.parent


def _kept(best: _Node) -> list[_Node]:
    """The best container and what belongs to it, in page order."""
    around = None if best.tag in ("article", "main") else best.parent
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None:
        _drop_linked(best, around)
        titled = around.parent is None or _has(around, "h1")
        return [i for i in (around.parent.items if around.parent else [around])
                if i is around or not titled and not isinstance(i, str) and i.tag == "h1"]
    if best.parent is None or best.tag == "body":
        return [best]
    if not best.words & _CONTENT_WORDS:
        at = best.parent
        while at is not None and at.tag != "body" and not at.words & _CONTENT_WORDS:
            at = at.parent
        if at is not None and at.parent is not None and at.tag != "body":
            _drop_linked(best, at)
            return [at]
    least, out, titled = max(10.0, _LEAST_SIBLING * best.score), [], _has(best, "h1")
    for item in best.parent.items:
        if item is best:
            out.append(item)
        elif isinstance(item, str) or item.gone or item.aside:
            continue
        elif item.tag == "h1" and not titled or item.score >= least and item.tag not in ("table", "ul", "ol", "dl"):
            out.append(item)
        elif item.tag in _PARAGRAPHS - {"li"} and (item.text > 80 or best.parent.tag != "body") and item.links * 4 < item.text:
            out.append(item)
    return out


def _text(nodes: list[_Node]) -> str:
    out: list[str] = []
    stack: list = [iter(nodes)]
    tags = [True]
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                out.append(item)
            elif item.gone or item.aside:
                out.append(" " if item.tag in _BLOCKS else "")
            else:
                block = item.tag in _BLOCKS
                out.append(" " if block else "")
                stack.append(iter(item.items))
                tags.append(block)
                break
        else:
            stack.pop()
            out.append(" " if tags.pop() else "")
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    """The article of a page."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _keep_texts(tree.nodes)
    _unwrap(tree.nodes)
    _measure(tree.nodes)
    scored = _score(tree.nodes)
    if not scored:
        # A page of nothing but a title.
        return _text([n for n in tree.nodes if n.tag == "h1" and not n.gone and not n.aside])
    place = {id(n): i for i, n in enumerate(tree.nodes)}
    best = max(scored, key=lambda n: (n.score, -place[id(n)]))
    return _text(_kept(best))


EXTRACT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def _with_length(html: str | None) -> tuple[str, int]:
    text = main_text(html)
    return text, len(text)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    run = map_texts(lambda: _with_length, EXTRACT)
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), run(F.col(html_col)).alias("__r"))
    return found.select("page_id", "url", "__r.text", "__r.n_chars")
