"""Main text of web pages by tree scoring.

A page becomes a tree. Elements that cannot hold article text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, reader comments, hidden parts) are set aside by tag, role, class
and id. Each paragraph left earns points for its length and commas, passed to the containers around
it: whole to the nearest, then half, a third and so on. A container's points are discounted by the share of its
text that is in links. The best container is kept, with those siblings that score near it or read
like prose; its blocks are the main text. Lists that are links alone are menus wherever they stand.
Nothing else is dropped, and texts are never capped. Trees are walked without recursion, so nesting
may be of any depth; work is linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import blocks, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the kinds named, unless a wall stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
WALLS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: Elements set aside whole.
ASIDE = frozenset("nav aside footer form script style noscript template button select option input textarea iframe object embed svg canvas audio video map dialog head title datalist menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in a class or id that mark what is no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup promo promotion promotions sponsor sponsored share sharing social related recommended recommendations widget widgets toolbar pagination pager login search skip".split()
)
#: With one of these in the same name, a header is the article's own.
OWN = frozenset("article entry post content story page-title".split())
#: Articles and the like are set aside for these marks alone.
FOREIGN = frozenset("ad ads advert advertisement comment comments reply sponsored promo related".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a text that are never its container; their points go to what holds them.
PARTS = frozenset("p pre ul ol dl li dt dd table caption thead tbody tfoot tr blockquote figure figcaption h1 h2 h3 h4 h5 h6 hgroup address details summary".split())
BONUS = {"article": 25.0, "main": 10.0, "section": 3.0}
#: A paragraph's points: one, one for each comma, one for each so many characters up to a limit.
POINT_CHARS, POINT_MOST = 100, 3.0
LEVELS = 5

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "kids", "bad", "chars", "linked", "links", "points", "score", "box")

    def __init__(self, tag: str, attributes: str, parent):
        self.tag, self.attributes, self.parent, self.kids = tag, attributes, parent, []
        self.bad, self.chars, self.linked, self.links, self.points, self.score, self.box = False, 0, 0, 0, 0.0, 0.0, None


def parse(page: str) -> Node:
    """The page's tree; texts are kids in place, with character references decoded."""
    root = Node("html", "", None)
    at, here, depth, tag = 0, root, 0, _TAG
    opened: dict[str, list] = {}  # (depth, node) of the open elements of each name, innermost last
    size = len(page)

    def close(node):
        nonlocal here, depth
        while here is not node.parent:
            opened[here.tag].pop()
            here, depth = here.parent, depth - 1

    def innermost(names):
        return max((opened[x][-1] for x in names if opened.get(x)), key=lambda x: x[0], default=(0, None))

    def nearest(tags, walls=frozenset()):
        """The innermost open element of these tags, unless a wall, or a table that they are no part of, stands inside it."""
        found, node = innermost(tags)
        wall, _ = innermost(walls if tags & {"tr", "td", "th", "tbody", "thead", "tfoot"} else walls | {"table"})
        return node if found >= wall else None

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            here.kids.append(unescape(page[at:]))
            break
        if begin > at:
            here.kids.append(unescape(page[at:begin]))
        follow = page[begin + 1 : begin + 2]
        if follow == "!" or follow == "?":
            if page.startswith("<!--", begin):
                # <!--> and <!---> are whole comments
                end = begin + 5 if page.startswith("<!-->", begin) else begin + 6 if page.startswith("<!--->", begin) else None
                if end is None:
                    end = page.find("-->", begin + 4)
                    end = size if end < 0 else end + 3
            else:
                end = page.find(">", begin)
                end = size if end < 0 else end + 1
            at = end
            continue
        m = tag.match(page, begin)
        if m is None and (follow.isascii() and follow.isalpha() or follow == "/"):
            m = _PLAIN_TAG.match(page, begin)
            if m is None:
                if page.find(">", begin) < 0:
                    break  # a tag that never ends
                if follow == "/":
                    at = page.find(">", begin) + 1
                    continue
            else:
                tag = _PLAIN_TAG  # an open quote: do not look for its end again
        if m is None:
            here.kids.append("<")
            at = begin + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "p" and not opened.get("p"):
                here.kids.append(Node("p", "", here))
            elif name == "br":
                here.kids.append(Node("br", "", here))
            elif opened.get(name):
                close(opened[name][-1][1])
            continue
        if name == "html":
            continue
        if name in ENDS_P and opened.get("p"):
            node = nearest({"p"}, {"td", "th", "caption", "button", "object"})
            if node is not None:
                close(node)
        if name in ENDS and any(opened.get(x) for x in ENDS[name]):
            node = nearest(ENDS[name], WALLS.get(name, {"table"}))
            while node is not None:
                close(node)
                node = nearest(ENDS[name], WALLS.get(name, {"table"})) if name in ("tr", "thead", "tbody", "tfoot") else None
        node = Node(name, m[3], here)
        here.kids.append(node)
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                at = size
            else:
                at = page.find(">", end.end())
                at = size if at < 0 else at + 1
            continue
        here, depth = node, depth + 1
        opened.setdefault(name, []).append((depth, node))
    return root


def _marks(value: str) -> bool | set[str]:
    found = set()
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & {"has", "no", "with", "without"}:
            continue
        marks = words & MARKS
        if words & OWN:
            marks -= {"header"}
        found |= marks
    return found


def _set_aside(node: Node, inside: bool) -> bool:
    """Whether a node cannot hold article text; inside: it stands in an article or main element."""
    tag = node.tag
    if tag in ASIDE:
        return True
    if tag == "header" and not inside:
        return True
    if not node.attributes.strip():
        return False
    attributes = {}
    for m in _ATTRIBUTE.finditer(node.attributes):
        attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    marks = _marks(unescape(attributes.get("class", ""))) | _marks(unescape(attributes.get("id", "")))
    return bool(marks & FOREIGN) if tag in ("article", "main") or tag in ("p", "h1", "h2", "span", "a", "b", "i", "em", "strong") and inside else bool(marks)


def _measure(root: Node) -> list[Node]:
    """Nodes that hold article text, parents first, with their own and linked characters."""
    order, stack = [], [(root, False, False)]
    while stack:
        node, inside, link = stack.pop()
        if node is not root and _set_aside(node, inside):
            node.bad = True
            continue
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        link = link or node.tag == "a"
        node.links = int(node.tag == "a")
        for kid in node.kids:
            if isinstance(kid, str):
                n = sum(map(len, kid.split()))
                node.chars += n
                node.linked += n if link else 0
            else:
                stack.append((kid, inside, link))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.links += node.links
    menus, articles = set(), set()
    for node in order:
        if node.tag == "article" or id(node.parent) in articles:
            articles.add(id(node))
        # a list, table or box that is links alone is a menu; in an article it may be a list of sources
        elif node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.links >= 2 and node.chars and node.linked >= 0.9 * node.chars and node.chars < 0.9 * root.chars:
            node.bad = True
            menus.add(id(node))
    for node in order:
        # and a heading that only menus follow is the menu's
        menu = text = False
        for kid in reversed(node.kids):
            if isinstance(kid, str):
                text = text or not kid.isspace()
            elif kid.tag in HEADINGS:
                kid.bad = kid.bad or kid.tag != "h1" and menu and not text
                menu = text = False
            else:
                menu = menu or id(kid) in menus or kid.tag == "nav"
                text = text or not kid.bad and kid.chars > 0
    alive, dead = [], set()
    for node in order:
        if node.bad or id(node.parent) in dead:
            node.bad = True
            dead.add(id(node))
        else:
            alive.append(node)
    return alive


def _flat(node: Node) -> str:
    """All kept text of a node."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.bad:
            if x.tag in BLOCK or x.tag == "br":
                out.append(" ")
            stack.extend(reversed(x.kids))
    return " ".join("".join(out).split())


def _own(node: Node) -> str:
    """Text of a node outside the blocks that it holds."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.bad and x.tag not in BLOCK:
            out.append(" " if x.tag == "br" else "")
            stack.extend(reversed(x.kids))
    return " ".join("".join(out).split())


def _best(root: Node, nodes: list[Node]) -> list[Node]:
    """The best container and the siblings to keep with it, in page order."""
    for node in nodes:  # parents first
        node.box = node if node.tag in BLOCK and node.tag not in PARTS else node.parent.box
        if node.tag not in BLOCK:
            continue
        text = _own(node)
        if not text:
            continue
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / POINT_CHARS, POINT_MOST)
        # bare text in a container counts for the container itself
        above, level = node.box, 1
        while above is not None and level <= LEVELS:
            above.points += points / level
            above, level = above.parent and above.parent.box, level + 1
    best = None
    for node in nodes:
        if node.points:
            density = node.linked / node.chars if node.chars else 0.0
            node.score = (node.points + BONUS.get(node.tag, 0.0)) * (1 - density)
            if best is None or node.score > best.score:
                best = node
    if best is None:
        return [root]
    node = best
    while node.parent is not None and node.tag != "article":
        node = node.parent
    if node.tag == "article":
        best = node  # a part of an article stands for all of it
    if best.parent is None:
        return [best]
    top, chosen, paths = best.parent, {id(best)}, set()
    if best is not node:
        top, chosen, paths = _others(best, nodes)
    return _kept(top, best, chosen, paths)


def _others(best: Node, nodes: list[Node]) -> tuple[Node, set[int], set[int]]:
    """Other containers that score high, near the best: the lowest node that holds all, they, and what leads to them."""
    above, node = [], best.parent
    while node is not None and len(above) < LEVELS:
        above.append(node)
        node = node.parent
    level = {id(x): i for i, x in enumerate(above)}
    chosen, paths, top = {id(best)}, set(), 0
    for node in sorted((x for x in nodes if x.score >= max(10.0, 0.2 * best.score)), key=lambda x: -x.score):
        if id(node) in level or id(node) in paths:
            continue
        way, x = [], node
        while x is not None and id(x) not in level and id(x) not in chosen and len(way) < LEVELS:
            way.append(id(x))
            x = x.parent
        if x is not None and id(x) in level:
            chosen.add(id(node))
            paths.update(way[1:])
            top = max(top, level[id(x)])
    paths.update(id(x) for x in above[:top])
    return above[top], chosen, paths


def _kept(top: Node, best: Node, chosen: set[int], paths: set[int]) -> list[Node]:
    kept, follows = [], False
    for kid in reversed(top.kids):
        if id(kid) in paths:
            kept.extend(reversed(_kept(kid, best, chosen, paths)))
            follows = True
            continue
        if id(kid) in chosen:
            keep = True
        elif isinstance(kid, str) or kid.bad or not kid.chars:
            continue
        else:
            density = kid.linked / kid.chars
            if kid.tag in HEADINGS:
                keep = kid.tag == "h1" or follows and density < 0.5
            else:
                prose = (kid.points or kid.tag in PARTS) and density < 0.25 and (kid.chars > 80 or density == 0 and re.search(r"[.!?。][\"')\]»”]?$", _flat(kid)) is not None)
                keep = prose or kid.score >= max(10.0, 0.2 * best.score)
        follows = keep
        if keep:
            kept.append(kid)
    return kept[::-1]


def _blocks(kept: list[Node]) -> list[str]:
    found, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        if text:
            found.append(text)
        line.clear()

    stack: list = list(reversed(kept))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.bad:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.kids))
    flush()
    return found


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by empty lines; empty for a page that is null or has none."""
    if not page:
        return ""
    root = parse(page)
    return "\n\n".join(_blocks(_best(root, _measure(root))))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page.

    Null and empty pages, and those without article text, give empty texts; null ids and URLs stay
    null; repeated rows are repeated; an empty table gives an empty result; other columns are ignored.
    """
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in blocks(batches, html_column):
            texts = [main_text(p).encode("utf-8", "replace").decode() for p in batch.column(html_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), batch.column(url_column), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_column, url_column, "text", "n_chars"])

    return pages.select(id_column, url_column, html_column).mapInArrow(run, f"`{id_column}` {kind}, `{url_column}` string, text string, n_chars bigint")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
