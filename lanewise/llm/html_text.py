"""HTML extraction by tag-path ratios.

A page's text leaves are grouped by their path of tags from the root.  Each path has a text ratio (characters a leaf)
and a punctuation ratio; both are smoothed over neighbouring paths and fused.  Tags and names that speak for or against
content are a factor of that ratio, no more: where a whole page stands in a form, all of its paths are lowered alike.
Paths whose ratio reaches a threshold, which follows the spread of all ratios, select the content nodes.  The text is what
stands in the element that holds them all (nearly all, if it is named as article), such as headings, short lists and
tables between them, but for paths that are lowered against the selected ones and blocks of links around them.

Every step is linear in the page: paths are numbered, and no step walks up the tree for each leaf.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import adding, through_arrow

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">/]|/(?!>))*+/>"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title|xmp)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|</[^A-Za-z>][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARK = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?。，！？；：、…]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msub msup".split()
)
#: A start tag ends an open element of these names, up to the nearest of the second.
_CLOSES = {
    "p": ({"p"}, {"table", "td", "th", "button", "object"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Block elements that also end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
    "pre section table ul".split()
)
#: Elements that seldom hold the article's text.
NOISE_TAGS = frozenset("head nav footer aside form button select menu dialog input option label legend fieldset annotation".split())
#: Words by which others say so in class, id or role; the weak ones only where the rest of the name says nothing else.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer masthead comment comments disqus cookie cookies gdpr newsletter".split()
)
WEAK_WORDS = frozenset(
    "promotion banner respond replies reply consent notice alert popup modal overlay subscribe subscription signup login "
    "share sharing social related recommended widget toolbar pagination pager search contentinfo complementary skip header".split()
)
NEUTRAL_WORDS = frozenset(
    "area article articles bar block bottom box btn button buttons col container content dialog fixed form global icon icons "
    "inline inner item items left link links list main media message module news only page panel post posts reader right row "
    "section site sr sticky stories story text title to top us user window wrap wrapper".split()
)
#: With these a name tells what a page has beside its content, such as "has-sidebar".
_ABOUT = frozenset("has have no with without".split())
#: Noise only outside an article: there it may hold the title.
PAGE_TAGS = frozenset(["header"])
ROOTS = frozenset(["article", "main"])
ROOT_WORDS = frozenset("article main content post entry story".split())
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_LISTS = frozenset(["a", "ul", "ol", "table"])
#: Factors of a path's ratio for each element that speaks against content, and for the outermost one that speaks for it.
AGAINST, FOR = 1 / 50, 16.0


class _Node:
    __slots__ = ("name", "parent", "path", "prior", "root", "link", "heading", "weight", "place", "listed")

    def __init__(self, name: str, parent: _Node | None, path: int, prior: float, root: bool):
        self.name, self.parent, self.path, self.prior, self.root = name, parent, path, prior, root
        self.link = name == "a" or parent is not None and parent.link
        self.heading = name in _HEADINGS or parent is not None and parent.heading
        self.weight, self.place, self.listed = 0, False, False


def _speaks(name: str, attributes: str, inside: bool) -> tuple[float, bool, str]:
    """(factor, whether it names content, its classes) of an element; the factor is 0 for a hidden one."""
    against, root, marks = name in NOISE_TAGS or name in PAGE_TAGS and not inside, name in ROOTS, ""
    if attributes:
        for key, *values in _MARK.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return 0.0, False, marks
            if key == "aria-hidden" or not value:
                continue
            if key == "class":
                marks = "." + " ".join(sorted(value.lower().split()))
            named = [set(_WORDS.findall(_CAMEL.sub(" ", v).lower())) for v in value.split()]
            words = set().union(*named)
            if not words.isdisjoint(_ABOUT) or name in ("html", "body"):
                continue
            if name in ROOTS:
                against |= not words.isdisjoint({"comment", "comments", "reply", "replies"})
                continue
            for own in named:
                weak = own & WEAK_WORDS - ({"header"} if inside else set())
                against |= not own.isdisjoint(NOISE_WORDS) or bool(weak) and own <= weak | NEUTRAL_WORDS
            root |= name in ("div", "section") and not words.isdisjoint(ROOT_WORDS)
    return AGAINST if against else 1.0, root and not against, marks


def leaves(page: str) -> tuple[list[_Node], list[tuple[_Node, str, bool]]]:
    """All elements, parents first, and the page's text runs in order: (element, text, whether a block begins before it).
    Comments, scripts, styles and hidden elements are left out; unclosed elements end where HTML lets them."""
    base = _Node("", None, 0, 1.0, False)
    nodes, paths = [base], {}
    stack, where, solid = [base], {}, [0]  # open elements; their places by name; the places of those that aren't inline
    out, at, fresh = [], 0, True

    def close(to: int) -> None:
        while len(stack) > to:
            where[stack.pop().name].pop()
        while solid[-1] >= to:
            solid.pop()

    last = lambda names: max((where[x][-1] for x in names if where.get(x)), default=0)
    for m in _TOKEN.finditer(page):
        if m.start() > at and stack[-1].prior:
            out.append((stack[-1], _plain(page[at : m.start()]), fresh))
            fresh = False
        at = m.end()
        closing, name = m.group(2), m.group(3)
        if not name:
            continue
        name = name.lower()
        fresh |= name not in INLINE
        if closing:
            if where.get(name):
                close(where[name][-1])
            continue
        if name in _CLOSES or name in _ENDS_P:
            ends, stops = _CLOSES.get(name) or _CLOSES["p"]
            found = last(ends)
            # A paragraph ends only if nothing but inline elements is open in it; items end whatever they hold.
            if found and (solid[-1] == found if "p" in ends else found > last(stops)):
                close(found)
        if name not in VOID and not (m.group(4) or "").endswith("/"):
            parent = stack[-1]
            factor, root, marks = _speaks(name, m.group(4) or "", parent.root)
            path = paths.setdefault((parent.path, name + marks), len(paths) + 1)
            prior = parent.prior * factor * (FOR if root and not parent.root else 1.0)
            node = _Node(name, parent, path, prior, root or parent.root)
            nodes.append(node)
            where.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                solid.append(len(stack))
            stack.append(node)
    if at < len(page) and stack[-1].prior:
        out.append((stack[-1], _plain(page[at:]), fresh))
    return nodes, out


def _plain(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _smooth(values: list[float]) -> list[float]:
    """A short Gaussian over neighbours."""
    n = len(values)
    at = lambda k: values[min(n - 1, max(0, k))]
    return [0.25 * at(k - 1) + 0.5 * values[k] + 0.25 * at(k + 1) for k in range(n)]


def path_ratios(found: list[tuple[_Node, str, bool]]) -> dict[int, float]:
    """The fused ratio of each path that holds text, in the order in which they appear.  Linked text speaks for a menu."""
    sizes: dict[int, list[float]] = {}
    for node, text, _ in found:
        solid = len(text) - text.count(" ")
        if solid and not text.isspace():
            entry = sizes.setdefault(node.path, [0.0, 0.0, 0.0, node.prior])
            entry[0] += 0 if node.link else solid
            entry[1] += len(_PUNCTUATION.findall(text))
            entry[2] += 1
            entry[3] = max(entry[3], node.prior)
    text = [n / k for n, _, k, _ in sizes.values()]
    punctuation = [p / k for _, p, k, _ in sizes.values()]
    own = [a * (1 + b) for a, b in zip(text, punctuation, strict=True)]
    blurred = [a * (1 + b) for a, b in zip(_smooth(text), _smooth(punctuation), strict=True)]
    return {p: (a * b) ** 0.5 * s[3] for (p, s), a, b in zip(sizes.items(), own, blurred, strict=True)}


def content_paths(ratios: dict[int, float]) -> set[int]:
    """Paths whose ratio passes the threshold, half the spread of all ratios."""
    if not ratios:
        return set()
    mean = sum(ratios.values()) / len(ratios)
    spread = (sum((x - mean) ** 2 for x in ratios.values()) / len(ratios)) ** 0.5
    threshold = min(0.5 * spread, max(ratios.values()))
    return {p for p, x in ratios.items() if x > 0 and x >= threshold}


def main_text(page: str | None) -> str:
    """The main text; blocks and white space become single spaces.  Empty for null, an empty page, or no content."""
    nodes, found = leaves(page or "")
    ratios = path_ratios(found)
    paths = content_paths(ratios)
    if not paths:
        return ""
    # The level of the selected path with the most text; what tags and names lower against it isn't content.
    amount: dict[int, float] = {}
    for node, text, _ in found:
        if node.path in paths:
            amount[node.path] = amount.get(node.path, 0.0) + len(text) * ratios[node.path]
    main = max(amount, key=amount.get)
    level = max(node.prior for node, *_ in found if node.path == main) / 4
    found = [x for x in found if x[0].prior >= level]
    total = named = 0
    for node, text, _ in found:
        if node.path in paths:
            node.weight += len(text)
            total += len(text)
            named += len(text) * node.root
    for node in reversed(nodes[1:]):
        node.parent.weight += node.weight
    # The deepest element that holds all content, in a named one nearly all, but no lone paragraph: its neighbours count too.
    share = 0.85 if 2 * named > total else 1.0
    best = nodes[0]
    for node in nodes:
        if node.weight >= share * total and node.parent is best:
            best = node
    while best.parent is not None and (best.parent.root or best.name in INLINE | {"p", "li", "pre", "blockquote", "td"} or best.heading):
        best = best.parent
    best.place = True
    for node in nodes[1:]:
        if node.parent.place:
            node.place, node.listed = True, node.parent.listed or node.name in _LISTS
    blocks: list[list[tuple[_Node, str]]] = []
    for node, text, fresh in found:
        if node.place:
            if fresh or not blocks:
                blocks.append([])
            blocks[-1].append((node, text))
    chosen = [k for k, block in enumerate(blocks) if any(n.path in paths and not t.isspace() for n, t in block)]
    out = []
    for k, block in enumerate(blocks):
        # Around the content, a block of links is no part of it, and in an element that isn't named as content no list.
        inner = chosen[0] <= k <= chosen[-1]
        linked = sum(len(t) for n, t in block if (n.link if best.root else n.listed) and not n.heading)
        if inner or 2 * linked <= sum(len(t) for _, t in block):
            out.append("".join(t for _, t in block))
    return " ".join(" ".join(out).split())


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """All columns of pages with `text` and its code points `n_chars`.  Null counts as an empty page; so does no text."""
    pages, names, schema = adding(pages, text="string", n_chars="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(names.index(source))]
            columns = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "text", "n_chars"])

    return through_arrow(pages, run, schema)
