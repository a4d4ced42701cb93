"""Main text of web pages by wrapper induction.

Induction. Every page is parsed, and the distinct trees of containers (div,
section, article, nav ...; cells of layout tables) of a host's pages are aligned
one after another, small ones first, by simple tree matching with a template
that grows by the nodes it lacks. A tree that matches no template of its host
well begins another one, so a host may have several layouts. All pages are then
counted on their templates, by sums; those with one longest text are copies and
count as one.

A text block that stands at one template node in CONSTANT of the aligned pages
(at least LEAST_SAME of them) is template; what varies fills slots. For each
template node the mean share of a page's varying text outside links is known.
From the root, the wrapper goes down while one child holds most of that share,
and stops at an article or main element; the subtree it stops at is the slot of
the content. What markup itself calls something else (nav, footer, aside, form,
a header outside the article, and by role, class or id) counts with FLAGGED of
its share, so it wins only if nearly all varying text is there. Left-behind
siblings stay content if they hold a varying heading.

Extraction. A page is aligned with its host's templates, by tree matching
again; the best one gives each of its containers a role. Containers that the
template lacks are content if the one around them is and they are not flagged.
Constant blocks go, but a heading with varying text after it stays, as the
label of a slot. A page that no template matches is its own template: then nothing is known to be constant and the shares are that
page's own.

Blocks are runs of text between elements that break lines. Rows: null html is
empty, with empty text. A null URL has host "". Broken or cut markup is read as
far as it goes; "<" that begins no tag is text; elements nested deeper than
DEEPEST belong to the one at that depth. Repeated pages are answered each. An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, stored, table
from .urls import host_and_path

LEAST_SAME = 3
CONSTANT = 0.8
FLAGGED = 0.1
PREFERRED = 2.0
MOSTLY = 0.5
#: A page belongs to a template if it shares so much of both trees.
ALIKE = 0.5
#: Siblings of one name from so many on are one list; with a class, from three.
LIST_FROM = 8
LONG_TEXT = 120
#: Elements below so many others open none of their own, as in browsers.
DEEPEST = 512
CACHED = 20_000
#: Sums that a task holds before it sends them on.
HELD = 200_000
#: Shares are added up in these parts, so that their order changes no sum.
WHOLE = 1 << 30

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(script|style|noscript|template|svg|iframe|textarea|select|object|math|canvas)\b[^<>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>|[!?][^<>]*+>)",
    re.S | re.I,
)
#: A tag that the end of the page cuts off.
_CUT = re.compile(r"<(?:/?[a-zA-Z][^\s<>]*+(?:\s++[\w:-]++\s*+=\s*+(?:\"[^\"<>]*+\"?|'[^'<>]*+'?|[^\s<>\"']*+))*+\s*+|[!/]?)\Z")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"[0-9]+")

# Elements that hold nothing, break a line, hold others, and what is no article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = frozenset("html body main article section div nav header footer aside form fieldset dialog details menu center".split())
_BLOCK = _CONTAINER | frozenset(
    "address blockquote caption dd dir dl dt figcaption figure h1 h2 h3 h4 h5 h6 head hgroup hr legend li ol optgroup option p pre summary table tbody td tfoot th thead title tr ul".split()
)
_NOT_P = _BLOCK - {"p"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEVER = frozenset("head title button label legend option".split())
_OTHER = frozenset("nav footer aside form dialog menu fieldset".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_OTHER_NAMES = re.compile(
    r"(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|cookiebar|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscribe|"
    r"sidebar|sidenav|menu|nav|navbar|navigation|topbar|breadcrumb|breadcrumbs|footer|masthead|comment|comments|disqus|reply|replies|respond|share|sharing|social|related|recommended|widget|login|signup|search|pagination|pager)"
)
_NO_NAMES = frozenset("has no not with without is".split())
#: An element of the key ends where one of these begins.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSE_WITHIN = frozenset("ul ol dl table tbody thead tfoot select".split())


def _other_by_name(value: str) -> bool:
    """Whether a class or id names something that is no article, with one of
    its words; has-sidebar and the like only tell of it."""
    for name in value.lower().split():
        words = re.split(r"[-_]+", name)
        if _NO_NAMES.isdisjoint(words) and any(map(_OTHER_NAMES.fullmatch, words)):
            return True
    return False


class Node:
    """A container: its name (tag and first class), children (containers, and
    blocks as (element, text, characters in links)), and what its markup says."""

    __slots__ = ("children", "flagged", "gone", "name", "tag")

    def __init__(self, tag: str, name: str, flagged: bool = False, gone: bool = False):
        self.tag, self.name, self.flagged, self.gone = tag, name, flagged, gone
        self.children: list = []

    def containers(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def blocks(self) -> list[tuple[str, str, int]]:
        return [c for c in self.children if not isinstance(c, Node)]


def _says(raw: str, tag: str) -> tuple[str, bool, bool]:
    """The first class, and whether attributes flag or hide the element."""
    first, flagged, gone = "", False, False
    for key, a, b, c in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), a or b or c
        if key == "class":
            first = value.split()[0] if value.split() else ""
        if key in ("class", "id"):
            flagged = flagged or tag not in ("html", "body", "main", "article") and tag not in _HEADINGS and _other_by_name(value)
        elif key == "role":
            flagged = flagged or value.lower() in _OTHER_ROLES
        elif key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true":
            gone = True
    return first, flagged, gone


_SAID: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def parse(html: str) -> Node:
    """The containers of a page with their blocks, in page order."""
    root = Node("#root", "#root")
    # open elements: (tag, container or None, whether its text is shown, whether it is a link)
    stack: list[tuple[str, Node | None, bool, bool]] = [("#root", root, True, False)]
    inside = [root]
    held: list[str] = []
    linked, links, hidden, headed = 0, 0, 0, [""]
    opened: Counter = Counter()

    def flush():
        nonlocal linked
        if held:
            line = " ".join("".join(held).split())
            held.clear()
            if line:
                inside[-1].children.append((headed[-1], line, min(linked, len(line))))
        linked = 0

    def add(raw: str):
        nonlocal linked
        if hidden:
            return
        text = unescape(raw) if "&" in raw else raw
        if links:
            linked += len(text.strip())
        held.append(text)

    def pop():
        nonlocal links, hidden
        tag, node, shown, link = stack.pop()
        opened[tag] -= 1
        if tag in _BLOCK:
            flush()
        if node is not None:
            inside.pop()
        if not shown:
            hidden -= 1
        if link:
            links -= 1
        if tag in _HEADINGS:
            headed.pop()

    def close(names, until=()):
        if not any(opened[tag] for tag in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k][0]
            if tag in names:
                while len(stack) > k:
                    pop()
                return
            if tag in until:
                return

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            close((tag,), () if tag in _BLOCK else _BLOCK)
            continue
        if tag in _BLOCK:
            close(("p",), _NOT_P)
            if tag in _CLOSES:
                close(_CLOSES[tag], _CLOSE_WITHIN)
            flush()
        if tag == "br":
            held.append(" ")
        if tag in _VOID:
            continue
        raw = m[4]
        said = ("", False, False)
        if raw and tag != "a":
            said = _SAID.get((tag, raw)) or _says(raw, tag)
            if len(_SAID) < CACHED:
                _SAID[(tag, raw)] = said
        first, flagged, gone = said
        if raw.endswith("/") and tag not in _BLOCK or len(stack) > DEEPEST:
            continue
        node = None
        if tag in _CONTAINER or (flagged or gone) or tag in ("td", "th"):
            flagged = flagged or tag in _OTHER
            node = Node(tag, f"{tag}.{_DIGITS.sub('', first)}" if first else tag, flagged, gone)
            flush()
            inside[-1].children.append(node)
            inside.append(node)
        shown = not (gone or tag in _NEVER)
        hidden += not shown
        links += tag == "a"
        if tag in _HEADINGS:
            headed.append(tag)
        stack.append((tag, node, shown, tag == "a"))
        opened[tag] += 1
    tail = html[at:]
    add(_CUT.sub("", tail) if "<" in tail else tail)
    while len(stack) > 1:
        pop()
    flush()
    _plain_cells(root)
    _headers(root)
    return root


def walk(root: Node):
    """All containers below and with ``root``, parents first, in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.containers())


def _plain_cells(root: Node) -> None:
    """Cells of data tables are no containers: their blocks move up, a cell a
    block. A cell that holds containers, or several blocks, lays out the page."""
    for node in reversed(list(walk(root))):
        if any(isinstance(c, Node) and c.tag in ("td", "th") for c in node.children):
            new: list = []
            for c in node.children:
                if isinstance(c, Node) and c.tag in ("td", "th") and not c.flagged and not c.gone and not c.containers() and len(c.children) < 3:
                    new += c.children
                else:
                    new.append(c)
            node.children = new


def _headers(root: Node) -> None:
    """A header is the page's, and so flagged, unless an article is around it."""
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        if node.tag == "header" and not within:
            node.flagged = True
        within = within or node.tag in ("article", "main")
        todo += [(c, within) for c in node.containers()]


class Shape:
    """A tree to match: names of containers; lists of like siblings are one."""

    __slots__ = ("children", "held", "name", "of")

    def __init__(self, name: str):
        self.name = name
        self.children: list[Shape] = []
        self.of: list[Node] = []
        self.held = None


def shape(root: Node) -> Shape:
    """The page's shape; each part knows the containers it stands for."""
    top = Shape(root.name)
    top.of = [root]
    todo = [top]
    while todo:
        part = todo.pop()
        every = [c for node in part.of for c in node.containers() if not c.gone]
        often = Counter(c.name for c in every)
        lists: dict[str, Shape] = {}
        for c in every:
            if often[c.name] >= (3 if "." in c.name else LIST_FROM) or len(part.of) > 1:
                if c.name not in lists:
                    lists[c.name] = Shape(c.name)
                    part.children.append(lists[c.name])
                lists[c.name].of.append(c)
            else:
                own = Shape(c.name)
                own.of.append(c)
                part.children.append(own)
        todo += part.children
    return top


def matched(a, b) -> list[tuple]:
    """Simple tree matching: the pairs of the largest matching of two trees
    (name, children) that keeps names, order and parents. No recursion: pairs
    of one name and depth are listed top-down and weighed bottom-up."""
    if a.name != b.name:
        return []
    pairs, of = [(a, b)], {(id(a), id(b)): 0}
    below: list[list[tuple[int, int, int]]] = []
    for k, (x, y) in enumerate(pairs):
        places: dict[str, list[int]] = {}
        for j, c in enumerate(y.children):
            places.setdefault(c.name, []).append(j)
        own = []
        for i, c in enumerate(x.children):
            for j in places.get(c.name, ()):
                of[(id(c), id(y.children[j]))] = len(pairs)
                own.append((i, j, len(pairs)))
                pairs.append((c, y.children[j]))
        below.append(own)
    weight, best = [1] * len(pairs), [None] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        x, y = pairs[k]
        if below[k]:
            m, n = len(x.children), len(y.children)
            if m == n == 1:
                weight[k] += weight[below[k][0][2]]
                continue
            gain = np.zeros((m, n), np.int64)
            for i, j, p in below[k]:
                gain[i, j] = weight[p]
            table_ = np.zeros((m + 1, n + 1), np.int64)
            for i in range(m):
                np.maximum.accumulate(np.maximum(table_[i, 1:], table_[i, :-1] + gain[i]), out=table_[i + 1, 1:])
            best[k] = table_
            weight[k] += int(table_[m, n])
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        x, y = pairs[k]
        out.append((x, y))
        if not below[k]:
            continue
        if best[k] is None:
            todo.append(below[k][0][2])
            continue
        table_, i, j = best[k], len(x.children), len(y.children)
        while i and j:
            if table_[i, j] == table_[i - 1, j]:
                i -= 1
            elif table_[i, j] == table_[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append(of[(id(x.children[i]), id(y.children[j]))])
    return out


def parts_of(top) -> list:
    out = [top]
    for part in out:
        out += part.children
    return out


class Template:
    """A node of a template tree."""

    __slots__ = ("children", "flagged", "kept", "name", "pages", "place", "role", "share", "tag", "texts")

    def __init__(self, name: str, tag: str, flagged: bool):
        self.name, self.tag, self.flagged = name, tag, flagged
        self.children: list[Template] = []
        self.pages, self.share, self.place = 0, 0.0, -1
        self.texts: Counter = Counter()
        self.role, self.kept = "out", frozenset()


def text_hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _likeness(pairs: list, a, b) -> float:
    return 2 * len(pairs) / (len(parts_of(a)) + len(parts_of(b)))


def _grow(template: Template | None, page: Shape) -> tuple[Template, list[tuple[Template, Shape]]]:
    """The template with the page's missing nodes, and the page's pairs."""
    def made(part: Shape) -> Template:
        return Template(part.name, part.of[0].tag, part.of[0].flagged)

    template = made(page) if template is None else template
    pairs = matched(template, page)
    at = {id(s): t for t, s in pairs}
    todo = [page]
    while todo:
        part = todo.pop()
        own, last = at[id(part)], 0
        for child in part.children:
            t = at.get(id(child))
            if t is None:
                t = at[id(child)] = made(child)
                own.children.insert(last, t)
                pairs.append((t, child))
            last = own.children.index(t) + 1
            todo.append(child)
    return template, pairs


def _blocks(part: Shape) -> list[tuple[str, str, int]]:
    return [b for node in part.of for b in node.blocks()]


class Layouts:
    """The templates of a host, grown by one page's shape after another."""

    def __init__(self):
        self.found: list[Template] = []
        self._names: list[Counter] = []

    def add(self, page: Shape) -> tuple[int, list[tuple[Template, Shape]]]:
        """The shape's template, grown by what it lacks, and the pairs. New
        nodes are numbered as they come."""
        names = Counter(part.name for part in parts_of(page))
        size, best = names.total(), None
        for k, template in enumerate(self.found):
            both = size + self._names[k].total()
            # no matching has more pairs than the names in common
            if 2 * (names & self._names[k]).total() / both < (ALIKE if best is None else best[0]):
                continue
            like = 2 * len(matched(template, page)) / both
            if like >= ALIKE and (best is None or like > best[0]):
                best = (like, k)
            if like == 1:
                break
        if best is None:
            best = (0.0, len(self.found))
            self.found.append(None)
            self._names.append(Counter())
        k = best[1]
        self.found[k], pairs = _grow(self.found[k], page)
        for t, _ in pairs:
            if t.place < 0:
                t.place = self._names[k].total()
                self._names[k][t.name] += 1
        return k, pairs


def _longest(root: Node) -> str:
    """The longest text outside what the markup flags."""
    return max((b[1] for node in walk(root) if not node.flagged for b in node.blocks()), key=len, default="")


def induce(pages: list[str]) -> list[Template]:
    """The templates of a host from its pages, with roles decided."""
    layouts, longest = Layouts(), set()
    every: list[list] = []
    for html in pages:
        root = parse(html)
        text = _longest(root)
        if len(text) >= LONG_TEXT and text in longest:
            continue
        longest.add(text)
        k, pairs = layouts.add(shape(root))
        every += [[] for _ in range(k + 1 - len(every))]
        every[k].append(pairs)
    return [decide(template, own) for template, own in zip(layouts.found, every)]


def decide(template: Template, every: list[list[tuple[Template, Shape]]]) -> Template:
    """Constant texts, shares of varying text, and the role of each node."""
    n = len(every)
    for pairs in every:
        for t, part in pairs:
            t.pages += 1
            t.texts.update({text_hash(b[1]) for b in _blocks(part)})
    parts = parts_of(template)
    for t in parts:
        t.kept = frozenset(x for x, c in t.texts.items() if c >= max(LEAST_SAME, CONSTANT * t.pages))
        t.texts.clear()
    headed = set()
    for pairs in every:
        own = {id(t): [0, 0] for t in parts}
        for t, part in pairs:
            for element, text, links in _blocks(part):
                if text_hash(text) not in t.kept:
                    own[id(t)][0] += max(0, len(text) - links)
                    own[id(t)][1] += element in _HEADINGS
        for t in reversed(parts):
            for c in t.children:
                own[id(t)][0] += own[id(c)][0]
                own[id(t)][1] += own[id(c)][1]
        whole = own[id(template)][0]
        for t in parts:
            t.share += own[id(t)][0] / whole / n if whole else 0.0
            if own[id(t)][1]:
                headed.add(id(t))
    return assign(template, headed)


def assign(template: Template, headed: set[int]) -> Template:
    """The role of each node from the shares; ``headed`` has the ids of those
    with a varying heading."""
    parts = parts_of(template)
    # down to the content's slot
    at = template
    at.role = "way"
    while at.children and at.tag != "article":
        weigh = lambda t: t.share * (FLAGGED if t.flagged else PREFERRED if t.tag in ("article", "main") else 1.0)
        own = max(0.0, at.share - sum(t.share for t in at.children))
        first = max(at.children, key=weigh)
        rest = own + sum(weigh(t) for t in at.children if t is not first)
        if not weigh(first) or weigh(first) < MOSTLY * (weigh(first) + rest) or at.tag == "main" and first.tag != "article":
            break
        if first.flagged and any(t.tag in ("article", "main") and not t.flagged for c in at.children if c is not first for t in parts_of(c)):
            break
        for t in at.children:
            if t is not first and not t.flagged and id(t) in headed and t.share > 0:
                t.role = "content"
        first.role = "way"
        at = first
    at.role = "content"
    # an article among articles is one of several parts
    for t in parts:
        if t.role == "content":
            for c in t.children:
                if c.role == "out" and not c.flagged:
                    c.role = "content"
        elif t.role == "way":
            for c in t.children:
                if c.role == "out" and c.tag == "article" and not c.flagged and c.share > 0:
                    c.role = "content"
    return template


def roles(templates: list[Template], page: Shape) -> tuple[bool, list[tuple[Shape, str, frozenset]]]:
    """Whether a template matches, and (part, role, constant texts) of the
    page's parts from the best one, or from the page itself."""
    best = None
    for template in templates:
        pairs = matched(template, page)
        like = _likeness(pairs, template, page)
        # a page that lacks optional parts is as good: what counts is how much of it is known
        known = len(pairs) / len(parts_of(page))
        if max(like, known) >= ALIKE and any(t.role == "content" for t, _ in pairs) and (best is None or like > best[0]):
            best = (like, pairs)
    if best is None:
        template, pairs = _grow(None, page)
        decide(template, [pairs])
    else:
        pairs = best[1]
    at = {id(s): t for t, s in pairs}
    out, todo = [], [(page, "out")]
    while todo:
        part, around = todo.pop()
        t = at.get(id(part))
        if t is not None:
            role, constant = t.role, t.kept
        else:
            role, constant = "content" if around == "content" and not part.of[0].flagged else "out", frozenset()
        out.append((part, role, constant))
        todo += [(c, role) for c in part.children]
    return best is not None, out


def content(html: str, templates: list[Template] = (), known: dict | None = None) -> str:
    """The article's blocks, joined by newlines.

    ``known`` keeps the roles of page shapes already met with these templates."""
    root = parse(html)
    page = shape(root)
    key = own = None
    if known is not None and templates:
        key = tuple((p.name, len(p.children), p.of[0].flagged) for p in parts_of(page))
        own = known.get(key)
    parts = parts_of(page)
    if own is None:
        fits, every = roles(list(templates), page)
        told = {id(p): (role, constant) for p, role, constant in every}
        own = [told[id(p)] for p in parts]
        if fits and key is not None and len(known) < CACHED:
            known[key] = own
    role_of = {id(node): told for part, told in zip(parts, own) for node in part.of}
    lines: list[str] = []
    same = lambda text, constant: bool(constant) and text_hash(text) in constant
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            lines.append(item)
            continue
        role, constant = role_of.get(id(item), ("out", frozenset()))
        children = item.children
        mine: list = []
        for k, c in enumerate(children):
            if isinstance(c, Node):
                mine.append(c)
            elif same(c[1], constant):
                after = children[k + 1] if k + 1 < len(children) else None
                if role == "content" and c[0] in _HEADINGS and after is not None and (isinstance(after, Node) or not same(after[1], constant)):
                    mine.append(c[1])
            elif role == "content" or role == "way" and c[0] == "h1":
                mine.append(c[1])
        todo += reversed(mine)
    return "\n".join(lines)


def described(pages: DataFrame) -> DataFrame:
    """host, key (pages with one longest text have one), h (of the page), sig
    (hash of its shape), shape, blocks for each row of ``pages`` with html.

    ``shape`` lists the parts in order, ``blocks`` (two longs each) the texts'
    hashes and then part << 33 | heading << 32 | characters outside links."""
    import json

    def work(batches):
        for batch in batches:
            rows = []
            for h, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                root = parse(html)
                text = _longest(root)
                parts = parts_of(shape(root))
                told = json.dumps([(p.name, p.of[0].tag, p.of[0].flagged, len(p.children)) for p in parts])
                every = [(k, b) for k, p in enumerate(parts) for b in _blocks(p)]
                both = [text_hash(b[1]) for _, b in every] + [k << 33 | (b[0] in _HEADINGS) << 32 | max(0, len(b[1]) - b[2]) for k, b in every]
                rows.append((text_hash(text) if len(text) >= LONG_TEXT else h, text_hash(told), told, np.array(both, np.int64).tobytes()))
            key, sig, told, blocks = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(key, pa.int64()), batch.column(1), pa.array(sig, pa.int64()), pa.array(told, pa.string()), pa.array(blocks, pa.binary())],
                ["host", "key", "h", "sig", "shape", "blocks"],
            )

    host = host_and_path(pages["url"].cast("string"))[0]
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(host.alias("host"), F.xxhash64(html).alias("h"), html.alias("html")).where("html <> ''")
    return rows.mapInArrow(work, "host string, key long, h long, sig long, shape string, blocks binary")


def _read_shape(told: str) -> Shape:
    import json

    parts = []
    for name, tag, flagged, n in json.loads(told):
        part = Shape(name)
        part.of = [Node(tag, name, flagged)]
        parts.append((part, n))
    at = 1
    for part, n in parts:
        part.children = [c for c, _ in parts[at : at + n]]
        at += n
    return parts[0][0]


def grown(rows: DataFrame) -> DataFrame:
    """host, sig, k, told: the template k of each shape, with the template
    nodes of its parts and the parts around them; sig null: all templates."""
    import pickle
    from itertools import groupby

    def work(batches):
        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def found():
            for host, own in groupby(each(), key=lambda r: r[0]):
                layouts = Layouts()
                for _, sig, told in own:
                    page = _read_shape(told)
                    k, pairs = layouts.add(page)
                    node = {id(part): t.place for t, part in pairs}
                    parts = parts_of(page)
                    place = {id(c): i for i, part in enumerate(parts) for c in part.children}
                    yield host, sig, k, np.array([[node[id(part)] for part in parts], [place.get(id(part), -1) for part in parts]], np.int32).tobytes()
                trees = []
                for template in layouts.found:
                    nodes = sorted(parts_of(template), key=lambda t: t.place)
                    trees.append([(t.name, t.tag, t.flagged, [c.place for c in t.children]) for t in nodes])
                yield host, None, len(trees), pickle.dumps(trees)

        yield from _sent(found(), ["host string", "sig long", "k int", "told binary"])

    shapes = rows.groupBy("host", "sig").agg(F.min("shape").alias("shape"))
    return shapes.repartition("host").sortWithinPartitions("host", F.length("shape"), "shape").select("host", "sig", "shape").mapInArrow(work, "host string, sig long, k int, told binary")


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _sent(rows, fields: list[str], most: int = 5000):
    """Batches of tuples."""
    from itertools import islice

    names, kinds = zip(*(f.split() for f in fields))
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, kind in zip(zip(*part), kinds)], list(names))


def _opened(blocks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks' text hashes, parts, characters and whether they head."""
    texts, told = np.frombuffer(blocks, np.int64).reshape(2, -1)
    return texts, told >> 33, told & 0xFFFFFFFF, told >> 32 & 1


def node_counts(rows: DataFrame) -> DataFrame:
    """host, k, node, text, n: the pages that have a template's node (text
    null), and that have a text there."""

    def work(batches):
        held: Counter = Counter()
        for batch in batches:
            for host, k, told, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(told, np.int32).reshape(2, -1)[0]
                texts, part, _, _ = _opened(blocks)
                held.update((host, k, node, None) for node in at.tolist())
                held.update((host, k, node, text) for node, text in set(zip(at[part].tolist(), texts.tolist())))
            if len(held) > HELD:
                yield from sent(held)
                held = Counter()
        yield from sent(held)

    def sent(held):
        return _sent(((*of, n) for of, n in held.items()), ["host string", "k int", "node int", "text long", "n long"])

    return rows.select("host", "k", "told", "blocks").mapInArrow(work, "host string, k int, node int, text long, n long").groupBy("host", "k", "node", "text").agg(F.sum("n").alias("n"))


def node_shares(rows: DataFrame) -> DataFrame:
    """host, k, node, share (sum over the pages, in parts of WHOLE), headed:
    what varies at and below a template's node; ``rows`` have kept, the
    template's constant texts as (node, text)."""

    def work(batches):
        held: dict[tuple[str, int, int], list[int]] = {}
        constant: dict[tuple[str, int], frozenset] = {}
        for batch in batches:
            kept = batch.column(4)
            for i, (host, k, told, blocks) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                if (host, k) not in constant:
                    if len(constant) > 1000:
                        constant.clear()
                    constant[(host, k)] = frozenset((x["node"], x["text"]) for x in kept[i].as_py() or ())
                same = constant[(host, k)]
                at, around = np.frombuffer(told, np.int32).reshape(2, -1)
                texts, part, size, heads = _opened(blocks)
                varies = np.array([x not in same for x in zip(at[part].tolist(), texts.tolist())], bool)
                own = np.bincount(part[varies], size[varies], len(at)).astype(np.int64).tolist()
                headed = np.bincount(part[varies], heads[varies], len(at)).astype(np.int64).tolist()
                for j in range(len(own) - 1, 0, -1):
                    own[around[j]] += own[j]
                    headed[around[j]] += headed[j]
                for node, x, y in zip(at.tolist(), own, headed):
                    if x or y:
                        sums = held.setdefault((host, k, node), [0, 0])
                        sums[0] += x * WHOLE // own[0] if own[0] else 0
                        sums[1] |= y > 0
            if len(held) > HELD:
                yield from sent(held)
                held = {}
        yield from sent(held)

    def sent(held):
        return _sent(((*of, *sums) for of, sums in held.items()), ["host string", "k int", "node int", "share long", "headed int"])

    sums = rows.select("host", "k", "told", "blocks", "kept").mapInArrow(work, "host string, k int, node int, share long, headed int")
    return sums.groupBy("host", "k", "node").agg(F.sum("share").alias("share"), F.max("headed").alias("headed"))


def _decided(trees: list, stats: list, kept: list) -> list[Template]:
    """Templates with roles from (k, node, pages, share, headed) and (k, node, text)."""
    out, every = [], []
    for tree in trees:
        nodes = [Template(name, tag, flagged) for name, tag, flagged, _ in tree]
        for t, (*_, children) in zip(nodes, tree):
            t.children = [nodes[c] for c in children]
        every.append(nodes)
    headed: set[int] = set()
    for k, node, n, share, heads in stats:
        t = every[k][node]
        t.pages, t.share = n, share / WHOLE
        if heads:
            headed.add(id(t))
    texts: dict[tuple[int, int], set] = {}
    for k, node, text in kept:
        texts.setdefault((k, node), set()).add(text)
    for (k, node), own in texts.items():
        every[k][node].kept = frozenset(own)
    for nodes in every:
        for t in reversed(nodes):
            t.share /= max(1, nodes[0].pages)
        out.append(assign(nodes[0], headed))
    return out


def _packed(templates: list[Template]) -> bytes:
    import pickle

    rows = []
    for top in templates:
        parts = parts_of(top)
        place = {id(t): k for k, t in enumerate(parts)}
        rows.append([(t.name, t.tag, t.flagged, t.role, sorted(t.kept) if t.role != "out" else [], [place[id(c)] for c in t.children]) for t in parts])
    return pickle.dumps(rows)


def _unpacked(raw: bytes) -> list[Template]:
    import pickle

    out = []
    for rows in pickle.loads(raw):
        parts = [Template(name, tag, flagged) for name, tag, flagged, *_ in rows]
        for t, (_, _, _, role, kept, children) in zip(parts, rows):
            t.role, t.kept, t.children = role, frozenset(kept), [parts[c] for c in children]
        out.append(parts[0])
    return out


def templates(pages: DataFrame) -> DataFrame:
    """host, wrapper: each host's templates, packed."""
    import pickle

    rows = stored(described(pages), "pages")
    layouts = stored(grown(rows), "layouts")
    of = layouts.where("sig is not null").select(F.col("host").alias("of"), F.col("sig").alias("of_sig"), "k", "told")
    # of pages with one key, the one of the least hash
    one = rows.groupBy("host", "key").agg(F.min(F.struct("h", "sig", "blocks")).alias("p")).select("host", "p.sig", "p.blocks")
    counted = stored(one.join(of, (F.col("host") == F.col("of")) & (F.col("sig") == F.col("of_sig"))).select("host", "k", "told", "blocks"), "counted")
    counts = stored(node_counts(counted).where(f"text is null or n >= {LEAST_SAME}"), "node-counts")
    on = ["host", "k", "node"]
    n_pages = counts.where("text is null").select(*on, F.col("n").alias("pages"))
    kept = counts.where("text is not null").join(n_pages, on).where(F.col("n") >= F.greatest(F.lit(float(LEAST_SAME)), CONSTANT * F.col("pages"))).select(*on, "text")
    kept = stored(kept, "constants")
    of_template = kept.groupBy("host", "k").agg(F.collect_list(F.struct("node", "text")).alias("kept"))
    shares = node_shares(counted.join(of_template, ["host", "k"], "left"))
    stats = n_pages.join(shares, on, "left").groupBy("host").agg(F.collect_list(F.struct("k", "node", "pages", F.coalesce("share", F.lit(0)).alias("share"), F.coalesce("headed", F.lit(0)).alias("headed"))).alias("stats"))
    texts = kept.groupBy("host").agg(F.collect_list(F.struct("k", "node", "text")).alias("kept"))
    every = layouts.where("sig is null").select("host", "told").join(stats, "host", "left").join(texts, "host", "left").select("host", "told", "stats", "kept")

    def work(batches):
        for batch in batches:
            packed = []
            for told, own, same in zip(*(c.to_pylist() for c in batch.columns[1:])):
                packed.append(_packed(_decided(pickle.loads(told), [tuple(x.values()) for x in own or ()], [tuple(x.values()) for x in same or ()])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["host", "wrapper"])

    return every.mapInArrow(work, "host string, wrapper binary")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    of = stored(templates(pages), "wrappers").withColumnRenamed("host", "of")
    host = host_and_path(pages["url"].cast("string"))[0]
    rows = pages.select(long_id(pages, "page_id").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"), host.alias("host"))
    rows = rows.join(of, rows["host"] == of["of"], "left").select("page_id", "url", "html", "host", "wrapper")

    def work(batches):
        met: dict[str, tuple[list[Template], dict]] = {}
        for batch in batches:
            texts, wrapper = [], batch.column(4)
            for k, (html, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if host not in met:
                    if len(met) > 1000:
                        met.clear()
                    raw = wrapper[k].as_py()
                    met[host] = (_unpacked(raw) if raw else [], {})
                texts.append(content(html or "", *met[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
