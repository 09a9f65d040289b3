"""A small DOM: parsing, simple tree matching, and the main text of a page."""

from __future__ import annotations

import bisect
import re
import sys
from collections import Counter, defaultdict
from html import unescape

import numpy as np

# Fixed values of HTML: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "caption", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "optgroup": {"select"}, "p": {"table", "button", "td", "th"}}
# Chosen words: elements, roles and words of class and id attributes that aren't the article's own text.
UNWANTED = frozenset("head script style noscript template iframe object embed applet svg math canvas audio video form button input select textarea datalist nav aside menu dialog footer title".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar note status".split())
UNWANTED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay "
    "newsletter subscribe subscription signup signin login register sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus reply replies respond discussion social share sharing "
    "related recommended recommendations widget widgets toolbar pagination pager copyright searchbox searchform form".split()
)
HEADERS = frozenset(("header", "masthead", "banner"))
COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())

#: Trees may nest this deep; Python's own frames don't use the stack of the process.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element (``text`` is None) or a text (``tag`` is '#')."""

    __slots__ = ("drop", "kids", "label", "on_way", "parent", "tag", "text", "words")

    def __init__(self, tag: str, parent: Node | None, text: str | None = None):
        self.tag, self.parent, self.text, self.kids, self.label, self.drop, self.words = tag, parent, text, [], tag, False, frozenset()


def _attributes(node: Node, raw: str) -> None:
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    node.label = f"{node.tag}.{found.get('class', '')}" if found.get("class") else node.tag
    node.words = frozenset(w.lower() for w in _WORD.findall(names))
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    node.drop = hidden or found.get("role", "").lower() in UNWANTED_ROLES


def parse(html: str) -> Node:
    """The tree of any text: unclosed, crossed and stray tags are tolerated."""
    root = Node("#root", None)
    stack, at, n = [root], 0, len(html)
    #: How many elements of a tag are open, so that a stray end tag isn't sought in a deep stack.
    standing: dict[str, int] = defaultdict(int)

    def cut(i: int) -> None:
        for x in stack[i:]:
            standing[x.tag] -= 1
        del stack[i:]

    def add_text(raw: str) -> None:
        if raw:
            text = " ".join(unescape(raw).split())
            edge = (raw[0].isspace(), raw[-1].isspace())
            node = Node("#", stack[-1], (" " if edge[0] else "") + text + (" " if edge[1] and text else ""))
            stack[-1].kids.append(node)

    def close(tags, scope) -> None:
        if not any(standing[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut(i)
                return
            if stack[i].tag in scope:
                return

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add_text(html[at:])
            break
        add_text(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if standing[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut(i)
            continue
        name = m[2] or m[4]
        if not name:
            continue
        tag = name.lower()
        if standing["p"] and tag in CLOSES_P:
            close(("p",), SCOPE["p"])
        if tag in SAME_LEVEL:
            close(SAME_LEVEL[tag], SCOPE[tag])
        node = Node(tag, stack[-1])
        raw = m[3] or m[5] or ""
        if raw and not raw.isspace():
            _attributes(node, raw)
        stack[-1].kids.append(node)
        if tag in RAW and not raw.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not (raw.endswith("/") and tag not in BLOCK):
            stack.append(node)
            standing[tag] += 1
    return root


# --- simple tree matching ---------------------------------------------------------------------------------------


#: Child lists with a larger product of lengths are first cut at equal subtrees, as the table would take too much memory.
CELLS = 1 << 23
#: Smaller tables are filled by a plain loop, which is faster there.
LOOP_CELLS = 200


def _codes(x: list[Node], y: list[Node], key) -> tuple[np.ndarray, np.ndarray]:
    known: dict = {}
    return tuple(np.fromiter((known.setdefault(key(n), len(known)) for n in z), np.int64, len(z)) for z in (x, y))


def _table(x: list[Node], y: list[Node], kept: dict):
    """Best scores of all prefixes of two child lists, matched in order. In a large table a row is one vectorised step."""
    if len(x) * len(y) <= LOOP_CELLS:
        rows = [[0.0] * (len(y) + 1)]
        for p in x:
            last, row, best, label = rows[-1], [0.0], 0.0, p.label
            for j, q in enumerate(y):
                up = last[j + 1]
                if label == q.label:
                    s = last[j] + ((2 if p.text == q.text else 1) if label == "#" else _score(p, q, kept))
                    if s > up:
                        up = s
                if up > best:
                    best = up
                row.append(best)
            rows.append(row)
        return rows
    label_x, label_y = _codes(x, y, lambda n: n.label)
    # Texts, and elements with one text: one more point if they are equal, else as many as the nodes that match.
    simple = lambda n: n.tag == "#" or (len(n.kids) == 1 and n.kids[0].tag == "#")
    simple_x, simple_y = (np.fromiter(map(simple, z), bool, len(z)) for z in (x, y))
    text_x, text_y = _codes(x, y, lambda n: n.text if n.tag == "#" else n.kids[0].text if simple(n) else id(n))
    size_x = np.fromiter((1.0 if n.tag == "#" else 2.0 for n in x), float, len(x))
    other = np.flatnonzero(~simple_y)
    rows = np.zeros((len(x) + 1, len(y) + 1), np.float32)
    for i, p in enumerate(x):
        same = label_y == label_x[i]
        if simple_x[i]:
            s = np.where(same & simple_y, size_x[i] + (text_y == text_x[i]), 0.0)
            rest = other[same[other]]
        else:
            s, rest = np.zeros(len(y)), np.flatnonzero(same)
        for j in rest:
            s[j] = _score(p, y[j], kept)
        last = rows[i]
        now = np.maximum(last[1:], np.where(s > 0, last[:-1] + s, 0))
        rows[i + 1, 1:] = np.maximum.accumulate(now)
    return rows


def _pairs_by_anchors(x: list[Node], y: list[Node]) -> list[tuple[list[Node], list[Node]]]:
    """Parts of two very long lists: between the subtrees of the longest run that is equal and in order, and those themselves."""
    places: dict = {}
    key = lambda n: (n.label, " ".join(t.text for t in texts(n)))
    for j, q in enumerate(y):
        places.setdefault(key(q), []).append(j)
    used: dict = {}
    tails, tops, chain = [], [], []  # patience sorting
    for i, p in enumerate(x):
        k = key(p)
        at = used.get(k, 0)
        if at >= len(places.get(k, ())):
            continue
        used[k], j = at + 1, places[k][at]
        t = bisect.bisect_left(tops, j)
        tops[t : t + 1], tails[t : t + 1] = [j], [len(chain)]
        chain.append((i, j, tails[t - 1] if t else -1))
    anchors, at = [], tails[-1] if tails else -1
    while at >= 0:
        i, j, at = chain[at]
        anchors.append((i, j))
    out, a, b = [], 0, 0
    for i, j in [*reversed(anchors), (len(x), len(y))]:
        u, v = x[a:i], y[b:j]
        while u and v:  # without a common subtree: equal lengths at a time
            out.append((u[:2048], v[:2048]))
            u, v = u[2048:], v[2048:]
        if i < len(x):
            out.append(([x[i]], [y[j]]))
        a, b = i + 1, j + 1
    return out


def _parts(x: list[Node], y: list[Node]) -> list[tuple[list[Node], list[Node]]]:
    return [(x, y)] if len(x) * len(y) <= CELLS else _pairs_by_anchors(x, y)


def _score(a: Node, b: Node, kept: dict) -> float:
    """Size of the largest top-down matching that keeps order; equal texts count for two."""
    if a.label != b.label:
        return 0
    if a.tag == "#":
        return 2 if a.text == b.text else 1
    if len(a.kids) == 1 == len(b.kids) and a.kids[0].tag == "#" == b.kids[0].tag:
        return 3 if a.kids[0].text == b.kids[0].text else 2
    known = kept.get((id(a), id(b)))
    if known is None:
        known = kept[id(a), id(b)] = [(x, y, _table(x, y, kept)) for x, y in _parts(a.kids, b.kids)] if a.kids and b.kids else []
    return 1 + sum(float(rows[-1][-1]) for _, _, rows in known)


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Matched nodes of two trees by simple tree matching."""
    kept: dict = {}
    _score(a, b, kept)
    out, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        if p.label != q.label:
            continue
        out.append((p, q))
        if p.tag == "#" or not p.kids or not q.kids:
            continue
        if len(p.kids) == 1 == len(q.kids):
            todo.append((p.kids[0], q.kids[0]))
            continue
        if (id(p), id(q)) not in kept:
            _score(p, q, kept)
        for x, y, rows in kept[id(p), id(q)]:
            i, j = len(x), len(y)
            while i and j:
                if rows[i][j] == rows[i][j - 1]:
                    j -= 1
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((x[i], y[j]))
    return out


# --- wrappers ---------------------------------------------------------------------------------------------------


def texts(node: Node):
    """The texts of a tree in page order."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == "#":
            yield x
        todo.extend(reversed(x.kids))


def elements(node: Node):
    """The elements of a tree in page order."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag != "#":
            yield x
            todo.extend(reversed(x.kids))


def _words(root: Node) -> set[str]:
    return {t.text for t in texts(root) if t.text.strip()}


#: A text is template if so large a share of the unlike pages of a host has it.
SHARE = 0.9
#: Elements that hold text of their own rather than blocks: a slot isn't sought inside them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote address caption figcaption a span b i em strong tr tbody thead ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def weights(root: Node, constant: frozenset[int] | set[int] = frozenset()) -> dict[int, int]:
    """Characters of text below each element, by its identity: without links, marked elements and the texts ``constant``."""
    out: dict[int, int] = {}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        x, done = todo.pop()
        if done:
            out[id(x)] = sum((0 if id(k) in constant else len(k.text.strip())) if k.tag == "#" else out[id(k)] for k in x.kids)
        elif x.drop or x.tag == "a":
            out[id(x)] = 0
        else:
            todo.append((x, True))
            todo.extend((k, False) for k in x.kids if k.tag != "#")
    return out


def supported(seed: Node, page: Node, alike: float = 0.5) -> tuple[list[int], dict[int, int]] | None:
    """Of a page aligned with a seed: the seed's texts that it has in the same place, and the characters of varying
    text below each of the seed's elements that it has, both by their index; None if the page is a copy of the seed.

    Copies of a page say nothing about its template, so a page that shares more than half of its texts is passed over.
    """
    a, b = _words(seed), _words(page)
    if not a or not b or len(a & b) > alike * min(len(a), len(b)):
        return None
    _mark(page, False)
    pairs = align(seed, page)
    alike_ = [(p, q) for p, q in pairs if p.tag == "#" and p.text == q.text]
    equal, size = {id(p) for p, _ in alike_}, weights(page, {id(q) for _, q in alike_})
    found = {id(p): size.get(id(q), 0) for p, q in pairs if p.tag != "#" and (p.tag not in LEAVES or p.tag in HEADINGS)}
    index = {id(e): i for i, e in enumerate(elements(seed))}
    return [i for i, t in enumerate(texts(seed)) if id(t) in equal and t.text.strip()], {index[k]: n for k, n in found.items()}


#: The way to a slot ends where so small a share of its varying text isn't below the next element but in blocks beside it.
BESIDE = 0.02


def _slot(seed: Node, found: dict[int, tuple[int, int]], others: int) -> list[Node] | None:
    """Elements of the seed from the root to the slot that holds the article: where most of the varying text lies.

    ``found``: index of an element -> (pages that have it, characters of varying text below it on them). The way down ends
    where no element that half of the pages have holds half of the text, and where varying text stands in blocks or
    headings beside the next element, as an article's own do. Names of tags don't decide.
    """
    order = {id(e): i for i, e in enumerate(elements(seed))}
    at = lambda e: found.get(order[id(e)], (0, 0))
    here, path = seed, []
    while True:
        kids = [k for k in here.kids if k.tag != "#" and k.tag not in LEAVES]
        best = max(kids, key=lambda k: at(k)[1], default=None)
        if best is None:
            break
        pages, size = at(best)
        if 2 * pages < others or size <= 0 or 2 * size < at(here)[1]:
            break
        if here.tag not in ("#root", "html", "body"):
            beside = at(here)[1] - sum(at(k)[1] for k in kids)
            inner = {id(e) for e in elements(best)}
            if beside > BESIDE * at(here)[1] or any(e.tag in HEADINGS and id(e) not in inner and 2 * at(e)[0] >= others and at(e)[1] > 0 for e in elements(here)):
                break
        here = best
        path.append(here)
    return path if here.tag not in ("#root", "html", "body") else None


def wrapper_of(seed: Node, counts: dict[int, int], found: dict[int, tuple[int, int]], others: int) -> tuple[int, list | None, list[str] | None] | None:
    """Wrapper: (number of unlike pages, template tree, slot) from what the pages other than the seed have of it.

    The template keeps the texts of at least ``SHARE`` of the pages, the seed among them, what is above them, and the way
    to the slot, as nested [label, text, children, labels of the seed's children if it is on the way]; slot: labels of the
    way. None without other pages.
    """
    if not others:
        return None
    constant = {id(t) for i, t in enumerate(texts(seed)) if counts.get(i, 0) and counts[i] + 1 >= SHARE * (others + 1)}
    way = _slot(seed, found, others)
    on = {id(e) for e in way or ()}
    below: dict[int, list] = {}
    for e in reversed(list(elements(seed))):  # children before their parents
        kids = [["#", k.text, [], None] if k.tag == "#" else below.pop(id(k), None) for k in e.kids if k.tag != "#" or id(k) in constant]
        kids = [k for k in kids if k]
        if kids or id(e) in on:
            below[id(e)] = [e.label, None, kids, sorted({k.label for k in e.kids if k.tag != "#"}) if id(e) in on else None]
    return others + 1, below.get(id(seed)), [e.label for e in way] if way else None


def induce(pages: list[Node]) -> tuple[int, list | None, list[str] | None] | None:
    """Wrapper of same-host pages, with the first as the seed."""
    found = [x for x in (supported(pages[0], p) for p in pages[1:]) if x is not None]
    pages_, size = Counter(i for _, x in found for i in x), Counter()
    for _, x in found:
        size.update(x)
    return wrapper_of(pages[0], Counter(i for x, _ in found for i in x), {i: (pages_[i], size[i]) for i in pages_}, len(found))


def _template(node: list) -> Node:
    out = Node("#" if node[0] == "#" else "template", None, node[1])
    out.label, out.on_way = node[0], None if node[3] is None else frozenset(node[3])
    out.kids = [_template(k) for k in node[2]]
    return out


def placed(root: Node, tree: list) -> tuple[set[int], Node | None]:
    """(template texts of a marked page, the element in the slot or None), by aligning the page with the template.

    Down the way to the slot, the next element is one of the children with its label that aren't partners of another part of
    the template: the one with the most text that is neither template nor a link, times how far its children's labels are
    those of the seed's. Where the template has no text below the way, order alone can't tell the article from an advert.
    """
    template = _template(tree)
    pairs = align(template, root)
    constant = {id(q) for p, q in pairs if p.tag == "#" and p.text == q.text}
    holds = {}  # elements of the page under which template texts lie, but on the way
    for p, q in reversed(pairs):  # children before their parents
        if id(q) in constant or any(holds.get(id(k)) for k in q.kids):
            holds[id(q)] = p.on_way is None
    size = weights(root, constant)
    here, now = template, root
    while (nxt := next((k for k in here.kids if k.on_way is not None), None)) is not None:
        able = [k for k in now.kids if k.tag != "#" and k.label == nxt.label and not k.drop and not holds.get(id(k))]
        if not able:
            return constant, None
        like = lambda k: 0.1 + len(nxt.on_way & {c.label for c in k.kids}) / max(1, len(nxt.on_way))  # noqa: B023, E731
        here, now = nxt, max(able, key=lambda k: like(k) * (size[id(k)] + 1))
    return constant, now if here is not template else None


# --- main text --------------------------------------------------------------------------------------------------


def _mark(node: Node, inside: bool) -> bool:
    """Set ``drop`` for what isn't article text; true if an article or main element is below (or is the node)."""
    tag, words = node.tag, node.words
    own = tag in ("article", "main") and not words & COMMENT_WORDS
    inside = inside or own
    holds = own
    for k in node.kids:
        if k.tag != "#":
            holds |= _mark(k, inside)
    if tag in UNWANTED:
        node.drop = True
    elif tag == "header":
        node.drop |= not inside
    elif tag in ("html", "body", "#root") or own:
        node.drop = False
    elif not holds:
        bad = words & UNWANTED_WORDS
        node.drop |= bool(bad - HEADERS) or bool(bad and not inside)
    return holds and not node.drop


def _regions(node: Node, out: list[Node]) -> None:
    if node.drop:
        return
    if node.tag == "article" and not node.words & COMMENT_WORDS:
        out.append(node)
        return
    for k in node.kids:
        _regions(k, out)


def _first(node: Node, tag: str) -> Node | None:
    if node.drop:
        return None
    if node.tag == tag:
        return node
    for k in node.kids:
        if (f := _first(k, tag)) is not None:
            return f
    return None


def blocks(node: Node, template: set[int]) -> list[str]:
    """Texts of the blocks in page order; dropped elements and template texts are left out."""
    out, now = [], []

    def flush() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    def walk(x: Node) -> None:
        if x.tag == "#":
            if id(x) not in template:
                now.append(x.text)
            return
        if x.drop and x is not node:
            return
        if x.tag == "br":
            now.append(" ")
        block = x.tag in BLOCK
        if block:
            flush()
        for k in x.kids:
            walk(k)
        if block:
            flush()

    walk(node)
    flush()
    return out


def _densest(root: Node, template: set[int]) -> Node:
    """Of a page without article or main: the element around the bulk of its unlinked, varying text."""
    weight: dict[int, float] = {}
    total: dict[int, float] = {}
    nodes: dict[int, Node] = {}

    def walk(x: Node, linked: bool) -> None:
        if x.drop:
            return
        for k in x.kids:
            if k.tag == "#":
                n = len(k.text.strip())
                if n and id(k) not in template:
                    p, share = x, 1.0
                    while p is not None and p.tag not in BLOCK:
                        p = p.parent
                    p = p.parent if p is not None and p.parent is not None and p.tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td") else p
                    if p is not None and not linked:
                        for up in (p, p.parent):
                            if up is not None:
                                weight[id(up)] = weight.get(id(up), 0) + share * n
                                nodes[id(up)] = up
                                share /= 3
                    up = x
                    while up is not None:
                        total[id(up)] = total.get(id(up), 0) + n
                        up = up.parent
            else:
                walk(k, linked or k.tag == "a")

    walk(root, False)
    if not weight:
        return root
    best = nodes[max(weight, key=lambda i: weight[i])]
    while best.parent is not None and best.parent.tag not in ("body", "html", "#root") and total[id(best.parent)] <= 1.3 * total[id(best)]:
        best = best.parent
    return best


def _beside(slot: Node) -> list[Node]:
    """The slot; of an article, all articles beside it in page order."""
    if slot.tag != "article" or slot.parent is None:
        return [slot]
    return [k for k in slot.parent.kids if k.label == slot.label and not k.drop]


def main_text(root: Node, wrapper: tuple[int, list | None, list[str] | None] | None = None) -> str:
    """The article of a parsed page.

    ``wrapper``, of its host if there is one, names the slot that varies and the template texts to leave out. Without
    it, or where the page lacks the slot, the page's own structure decides: its articles, its main element, or the
    element around the bulk of its text.
    """
    _mark(root, False)
    template: set[int] = set()
    found: list[Node] = []
    if wrapper:
        tree = wrapper[1]
        if tree:
            template, slot = placed(root, tree)
            found = [] if slot is None else _beside(slot)
    if not found:
        _regions(root, found)
    if not found:
        only = _first(root, "main")
        found = [_densest(root, template) if only is None else only]
    return "\n".join(x for region in found for x in blocks(region, template))
