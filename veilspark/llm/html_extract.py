"""Main text of web pages by wrapper induction: pages of a host are aligned by simple tree matching.

A page becomes a skeleton: its block elements, where siblings of the same label are one repeated slot. The most frequent
skeleton of each layout of a host is a reference; every page is aligned with the reference most like it by simple tree matching
(Yang, 1991). A text that most pages have in the same slot is template, also inside a declared article; the other texts of a slot,
repeated or not, can be content.
What varies and still is no article (menus, adverts, notices, comments) is told by the roles that elements declare, by standing
outside the declared article, and by the share of linked text.
"""

from __future__ import annotations

import functools
import html as htmllib
import itertools
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted, maybe_broadcast

#: A text in a slot is template when it is on so large a share of the pages aligned to the slot, and on so many different pages: two may be
#: copies of each other in part.
CONSTANT_SHARE, CONSTANT_PAGES = 0.6, 3
#: Skeletons with so large a share of common nodes are one layout.
SAME_LAYOUT = 0.7
#: Outside a declared article, a block is a menu when so much of its text is linked; in a main element so many in a row, linked whole.
LINKED, MENU = 0.5, 3

#: The skeletons of a host are first reduced to layouts in so many parts.
PARTS = 64

_TAG_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([A-Za-z_:@][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_NAME = re.compile(r"[a-z]+")
#: Leading zeros of a character's number, and numbers beyond all characters.
_ZEROS, _TOO_LARGE = re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
#: Headings over readers' comments, in the languages of the pages.
_TALK = re.compile(
    r"(?:(?:[0-9]+|leave a|leave your|post a|add a|write a|join the|reader|readers'?|user|customer|visitor|all|latest|recent|your|no) )*(?:comments?|replies|kommentare?|commentaires?|comentarios?)(?: ?[(:].{0,20})?"
    r"|(?:reader|user|customer|visitor|guest)s?'? reviews?(?: ?[(:].{0,20})?",
    re.I,
)
#: Up to so many characters, attributes and skeletons are remembered in caches.
CACHED = 4096

_RAW = frozenset("script style noscript template iframe svg math title textarea object canvas audio video head select".split())
#: Controls that stand in a text: left out with what they hold, if they are closed.
_CONTROLS = frozenset("button label datalist output meter progress".split())
_BLOCK = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre section article main aside nav header footer form fieldset figure figcaption address details summary dialog hr center menu hgroup".split()
)
_NOT_CONTENT_TAGS = frozenset("nav footer aside form menu dialog".split())
_NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NOT_CONTENT_NAMES = frozenset(
    "nav navbar navigation menu sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond footer breadcrumb breadcrumbs pagination pager search toolbar widget masthead copyright skip".split()
)
#: Names made of two words, as in site-nav or cookie-notice: a class is one name as a whole, so has-sidebar is none of these.
_PLACES = "site page main top bottom left right primary secondary global mobile header footer post entry article user".split()
_PLACED = "nav navbar navigation menu sidebar footer banner breadcrumb breadcrumbs comments share sharing pagination search newsletter".split()
_THINGS = "cookie cookies gdpr consent ad ads advert sponsor promo newsletter subscribe signup login share sharing social related comment comments search nav menu sidebar popup modal".split()
_PARTS = "count notice banner bar box container list links link form widget popup modal overlay posts articles items item section area block buttons icons slot unit message consent".split()
_NOT_CONTENT_NAMES |= {a + b for first, second in ((_PLACES, _PLACED), (_THINGS, _PARTS)) for a in first for b in second}
#: Who talks, and how: reader-comments and user-reviews are names of comments, and so is what follows in comments-list.
_AUDIENCE = "reader readers user users customer customers visitor visitors guest guests viewer viewers community public".split()
_TALKS = "comment comments review reviews reply replies response responses discussion discussions feedback rating ratings".split()
_NOT_CONTENT_NAMES |= {a + t + p for a in _AUDIENCE for t in _TALKS for p in ("", *_PARTS)}
_MAIN_NAMES = frozenset("articlebody entrycontent postcontent articlecontent maincontent storybody".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY_BLOCK = "p"
_SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "thead", "tbody", "tfoot")}


class _Markup:
    """Reads markup once, from left to right.

    What is looked for ahead is remembered, and so are places from which no end of a tag was found: markup that is opened again and again
    and never closed costs one search, not one for each time.
    """

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self.ahead: dict[str, int] = {}
        self.last = {quote: html.rfind(quote) for quote in "\"'"}
        self.endless: set[int] = set()
        self.closers: dict[str, int] = {}

    def find(self, what: str, start: int) -> int:
        """The next place of ``what``; starts never go back."""
        at = self.ahead.get(what)
        if at is None or -1 < at < start:
            at = self.ahead[what] = self.html.find(what, start)
        return at

    def tag_end(self, start: int) -> int:
        """The ">" that ends a tag: the first one outside quotes, or the first of all where a quote is never closed. There is one."""
        first = self.find(">", start)
        at, passed = start, []
        while True:
            m = _QUOTE_OR_END.search(self.html, at)
            if m is None or (m[0] != ">" and m.end() > self.last[m[0]]):
                break
            if m[0] == ">":
                return m.start()
            at = self.html.find(m[0], m.end()) + 1
            if at in self.endless:
                break
            passed.append(at)
        self.endless.update(passed)
        return first

    def past(self, name: str) -> int:
        """The place after the next closing tag of an element, or -1."""
        known = self.closers.get(name)
        if known is None or -1 < known < self.at:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I | re.A).search(self.html, self.at)
            known = self.closers[name] = m.end() if m else -1
        if known < 0:
            return -1
        end = self.find(">", known)
        return len(self.html) if end < 0 else end + 1

    def body(self) -> int:
        """The place of the next body tag, or -1."""
        known = self.closers.get("<body")
        if known is None or -1 < known < self.at:
            m = re.compile(r"<body\b", re.I | re.A).search(self.html, self.at)
            known = self.closers["<body"] = m.start() if m else -1
        return known

    def pieces(self) -> Iterator[tuple[str, str, str]]:
        """Texts ("", text, ""), tags ("<" or "</", name, attributes) and literal texts ("=", text, "")."""
        html, end = self.html, len(self.html)
        while self.at < end:
            start = self.at
            begin = self.find("<", start)
            if begin < 0:
                self.at = end
                yield "", html[start:], ""
                return
            if begin > start:
                yield "", html[start:begin], ""
            if html.startswith("<!--", begin):
                close = self.find("-->", begin + 4)
                self.at = end if close < 0 else close + 3
                continue
            if html.startswith("<![CDATA[", begin):
                close = self.find("]]>", begin + 9)
                if close >= 0:
                    self.at = close + 3
                    yield "=", html[begin + 9 : close], ""
                    continue
            if html[begin + 1 : begin + 2] in ("!", "?"):
                close = self.find(">", begin)
                self.at = begin + 1 if close < 0 else close + 1
                if close < 0:
                    yield "", "<", ""
                continue
            m = _TAG_NAME.match(html, begin + 1) if self.find(">", begin) >= 0 else None
            if m is None:
                self.at = begin + 1
                yield "", "<", ""
                continue
            close = self.tag_end(m.end())
            self.at = close + 1
            yield "<" + m[1], m[2].lower(), html[m.end() : close]


def _plain(text: str) -> str:
    """Character references decoded, white space as one space, trimmed."""
    if "&" in text:
        text = htmllib.unescape(_TOO_LARGE.sub("�", _ZEROS.sub(r"\1", text)))
    return " ".join(text.split())


class Block(NamedTuple):
    """A piece of text: its slot, how many of its characters are linked, its rank as a heading (0: none), the number of its article
    (negative: in an article inside that one; 0: none) and whether it follows a heading over readers' comments."""

    slot: int
    text: str
    linked: int
    rank: int
    article: int
    talk: bool


class Page:
    """A parsed page: the skeleton's labels, parents and kinds of elements, and blocks in page order."""

    def __init__(self, html: str):
        self.labels, self.parents, self.kinds = ["#"], [-1], [""]
        self.children: list[dict[str, int]] = [{}]
        self.blocks: list[Block] = []
        stack: list[tuple[str, int, int]] = [("#", 0, 0)]
        open_: dict[str, list[int]] = {}
        text: list[str] = []
        links = linked = articles = 0
        talk: tuple[int, int] | None = None  # place in the stack of what holds the comments, rank of their heading

        def flush() -> None:
            nonlocal linked, talk
            if text:
                name, slot, article = stack[-1]
                joined = _plain("".join(text))
                text.clear()
                if joined:
                    rank = int(name[1]) if name in _HEADINGS else 0
                    if rank and talk and rank <= talk[1]:
                        talk = None
                    if rank > 1 and talk is None and len(joined) <= 60 and _TALK.fullmatch(joined):
                        talk = len(stack) - 2, rank
                    self.blocks.append(Block(slot, joined, min(linked, len(joined)), rank, article, talk is not None))
            linked = 0

        def shut(i: int) -> None:
            nonlocal talk
            for name, _, _ in stack[i:]:
                open_[name].pop()
            del stack[i:]
            if talk and i <= talk[0]:
                talk = None

        def innermost(*names: str) -> int:
            return max((open_[n][-1] for n in names if open_.get(n)), default=0)

        markup = _Markup(html)
        for sign, name, attributes in markup.pieces():
            if sign in ("", "="):
                text.append(name if not sign else name.replace("&", "&amp;").replace("<", "&lt;"))
                if links:
                    linked += len(name)
            elif sign == "</":
                if name == "a":
                    links = max(0, links - 1)
                elif name in _BLOCK:
                    flush()
                    if i := innermost(name):
                        shut(i)
                        links = 0
                elif name in ("td", "th"):
                    text.append(" ")
            elif name in _RAW:
                # Only foreign elements can close themselves; the slash of <script src=//x/> is part of its address.
                if name not in ("svg", "math") or not attributes.endswith("/"):
                    past = markup.past(name)
                    if past < 0 and name == "head":
                        past = max(markup.body(), markup.at)
                    markup.at = past if past >= 0 else len(html)
            elif name in _CONTROLS:
                text.append(" ")
                markup.at = max(markup.past(name), markup.at)
            elif name in ("br", "td", "th"):
                text.append(" ")
            elif name == "a":
                links += 1
            elif name in _BLOCK:
                flush()
                links = 0
                if name == "hr":
                    continue
                if stack[-1][0] == _CLOSED_BY_BLOCK or stack[-1][0] in _HEADINGS:
                    shut(len(stack) - 1)
                if name in _SAME_CLOSES:
                    same = innermost("dt", "dd") if name in ("dt", "dd") else innermost(name)
                    if same > innermost(*_SAME_CLOSES[name]):
                        shut(same)
                if name in ("html", "body") and open_.get(name):
                    continue
                inside = stack[-1][2]
                if name == "article":
                    articles += inside == 0
                    inside = articles if inside == 0 else -abs(inside)
                open_.setdefault(name, []).append(len(stack))
                stack.append((name, self._slot(stack[-1][1], name, attributes), inside))
        flush()

    def _slot(self, parent: int, tag: str, attributes: str) -> int:
        label, kind = (_described if len(attributes) <= CACHED else _described.__wrapped__)(tag, attributes)
        found = self.children[parent].get(label)
        if found is None:
            found = self.children[parent][label] = len(self.labels)
            self.labels.append(label)
            self.parents.append(parent)
            self.kinds.append(kind)
            self.children.append({})
        return found

    def skeleton(self) -> tuple[str, list[int]]:
        """The skeleton in preorder as lines "depth label", and each slot's line number."""
        lines, number, todo = [], [0] * len(self.labels), [(0, 0)]
        while todo:
            slot, depth = todo.pop()
            number[slot] = len(lines)
            lines.append(f"{depth} {self.labels[slot]}")
            todo += [(c, depth + 1) for c in reversed(self.children[slot].values())]
        return "\n".join(lines), number

    def slot_digests(self) -> list[tuple[int, int]]:
        """Every slot with the digest of each different text in it: a repeated slot can hold template and content side by side."""
        return list(dict.fromkeys((b.slot, _digest(b.text)) for b in self.blocks))


def _kind(tag: str) -> str:
    return "x" if tag in _NOT_CONTENT_TAGS else "m" if tag in ("article", "main") else "h" if tag == "header" else ""


@functools.lru_cache(maxsize=20_000)
def _described(tag: str, attributes: str) -> tuple[str, str]:
    """The label of an element, and its kind: "x" not content, "n" not content by its names alone, "m" main content, "w" main
    content with such names, "h" a header, "" other."""
    if not attributes.strip("/ "):
        return tag, _kind(tag)
    given = {m[1].lower(): htmllib.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{given.get('id', '')} {given.get('class', '')}"
    words, role = set(_NAME.findall(names)), given.get("role", "")
    joined = {"".join(_NAME.findall(x)) for x in names.split()}
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""))
    main = tag in ("article", "main") or role in ("main", "article") or given.get("itemprop") == "articlebody" or bool(joined & _MAIN_NAMES)
    named = bool(joined & _NOT_CONTENT_NAMES) and tag not in ("html", "body")
    if hidden or tag in _NOT_CONTENT_TAGS or role in _NOT_CONTENT_ROLES:
        kind = "x"
    elif main or named:
        kind = ("w" if named else "m") if main else "n"
    else:
        kind = "h" if tag == "header" or "header" in words and tag not in ("html", "body") else ""
    label = f"{tag}.{'.'.join(sorted(words))}" if words and tag not in ("html", "body") else tag
    return label if kind == _kind(tag) else f"{label}!{kind}", kind


def _tree(skeleton: str) -> tuple[list[str], list[list[int]]]:
    labels, children, path = [], [], []
    for i, line in enumerate(skeleton.split("\n")):
        depth, _, label = line.partition(" ")
        labels.append(label)
        children.append([])
        del path[int(depth) :]
        if path:
            children[path[-1]].append(i)
        path.append(i)
    return labels, children


def _heaviest(pairs: list[tuple[int, int, int]]) -> tuple[int, list[int]]:
    """Of (weight, place on the other side, item) in order, the heaviest ones whose places rise, and their weight: best sums by place in a Fenwick tree."""
    places = {y: i + 1 for i, y in enumerate(sorted(y for _, y, _ in pairs))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)
    before = []
    for n, (weight, y, _) in enumerate(pairs):
        at, top = places[y] - 1, (0, -1)
        while at:
            top, at = max(top, best[at]), at & (at - 1)
        before.append(top[1])
        at, own = places[y], (top[0] + weight, n)
        while at <= len(places):
            best[at], at = max(best[at], own), at + (at & -at)
    at, top = len(places), (0, -1)
    while at:
        top, at = max(top, best[at]), at & (at - 1)
    chosen, n = [], top[1]
    while n >= 0:
        chosen.append(pairs[n][2])
        n = before[n]
    return top[0], chosen


def align(one: str, other: str) -> dict[int, int]:
    """Simple tree matching of two skeletons: the nodes of ``one`` with their partners in ``other``.

    No two siblings have the same label, so a node has one partner at most under a given pair of parents, and the best matching
    of two lists of children is their heaviest common subsequence.
    """
    return (_aligned_trees if len(one) + len(other) <= CACHED else _aligned_trees.__wrapped__)(one, other)


@functools.lru_cache(maxsize=4096)
def _aligned_trees(one: str, other: str) -> dict[int, int]:
    (la, ca), (lb, cb) = _tree(one), _tree(other)
    pairs, below = [(0, 0)], []
    for i, j in pairs:  # grows while it is read: parents before children
        named = {lb[y]: (n, y) for n, y in enumerate(cb[j])}
        met = [(x, *named[la[x]]) for x in ca[i] if la[x] in named]
        below.append([(n, len(pairs) + k) for k, (_, n, _) in enumerate(met)])
        pairs += [(x, y) for x, _, y in met]
    weights, chosen = [0] * len(pairs), [[]] * len(pairs)
    for p in range(len(pairs) - 1, -1, -1):
        total, chosen[p] = _heaviest([(weights[q], n, q) for n, q in below[p]])
        weights[p] = total + 1
    found, todo = {}, [0]
    while todo:
        p = todo.pop()
        found[pairs[p][0]] = pairs[p][1]
        todo += chosen[p]
    return found


def _digest(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _regions(page: Page) -> tuple[list[bool], list[bool], list[bool]]:
    """Of every slot, whether it is excluded, in the declared article, in a header that stands outside of it.

    Names are the weakest sign. An article or main element with the name of something else is the declared article where no other
    is, and where a declared article stands in an element excluded by its names alone, that element is not excluded.
    """

    def spread(main: str, lifted: set[int]) -> tuple[list[bool], list[bool], list[bool]]:
        n = len(page.labels)
        skip, inside, header = [False] * n, [False] * n, [False] * n
        for slot in range(1, n):  # parents come before their children
            up, kind = page.parents[slot], page.kinds[slot]
            skip[slot] = skip[up] or kind == "x" or (kind == "n" and slot not in lifted)
            opens = kind != "" and kind in main and not skip[slot]
            inside[slot] = inside[up] or opens
            header[slot] = (header[up] and not opens) or (kind == "h" and not inside[slot])
        return skip, inside, header

    def holders() -> set[int]:
        found: set[int] = set()
        for slot, kind in enumerate(page.kinds):
            while kind in ("m", "w") and slot > 0 and slot not in found:
                found.add(slot)
                slot = page.parents[slot]
        return found

    for main, lift in (("m", False), ("mw", False), ("mw", True)):
        regions = skip, inside, _ = spread(main, holders() if lift else set())
        if any(inside[b.slot] and not skip[b.slot] for b in page.blocks):
            return regions
    return spread("", set())


def _article(blocks: list[Block]) -> list[Block]:
    """Of the blocks in declared articles and main elements, the article's.

    Articles inside an article with text of its own are comments, and so are articles without a heading after one that has one. In
    what stands outside all articles, a row of blocks that are links and nothing else is a menu.
    """
    own = {b.article for b in blocks if b.article > 0}
    headed = {b.article for b in blocks if b.article > 0 and 0 < b.rank <= 3}
    first = min(headed, default=0)
    chosen = {a for a in own if a in headed or not headed or a < first}
    kept: list[Block] = []
    for linked, row in itertools.groupby(blocks, lambda b: b.article == 0 and b.linked >= len(b.text)):
        found = list(row)
        if not linked or len(found) < MENU:
            kept += [b for b in found if b.article == 0 or b.article in chosen or (b.article < 0 and -b.article not in own)]
    return [b for b in kept if not b.talk] or kept


class Wrapper:
    """The wrappers of a host: a skeleton for each layout, and the (slot, digest) of template texts by layout."""

    def __init__(self, references: Sequence[str], constant: Iterable[Mapping]):
        self.references, self.constant = tuple(references), [set() for _ in references]
        for c in constant:
            self.constant[c["layout"]].add((c["slot"], c["digest"]))

    def template(self, page: Page) -> set[tuple[int, str]]:
        skeleton, number = page.skeleton()
        layout = nearest(skeleton, self.references)
        partner, known = align(skeleton, self.references[layout]), self.constant[layout]
        return {(b.slot, b.text) for b in page.blocks if (partner.get(number[b.slot], -1), _digest(b.text)) in known}


def main_text(html: str | None, wrapper: Wrapper | None = None) -> str:
    """The article of a page, with the wrapper of its host if it has one."""
    if not html:
        return ""
    page = Page(html)
    skip, inside, header = _regions(page)
    template = wrapper.template(page) if wrapper else set()
    shown = [b for b in page.blocks if not skip[b.slot] and not header[b.slot]]
    declared = _article([b for b in shown if inside[b.slot]])
    # The wrapper takes template out of a declared article too; where nothing else is in it, its pages are copies and keep it.
    kept = [b.text for b in declared if b[:2] not in template] or [b.text for b in declared]
    if not any(inside[b.slot] and not skip[b.slot] for b in page.blocks):
        kept = [b.text for b in shown if b[:2] not in template and b.linked <= LINKED * len(b.text) and not b.talk]
    return "\n".join(kept)


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for url, html in zip(pdf["url"], pdf["html"], strict=True):
            if html:
                page = Page(html)
                skeleton, number = page.skeleton()
                found = page.slot_digests()
                whole = _digest("\n".join(b.text for b in page.blocks))
                rows.append((host_of(url), whole, skeleton, [number[s] for s, _ in found], [d for _, d in found]))
        yield pd.DataFrame(rows, columns=["host", "page", "skeleton", "slots", "digests"])


def _paths(skeleton: str) -> frozenset[int]:
    """The nodes of a skeleton, each told by the labels from the root to it; no two siblings have the same label."""
    return (_path_set if len(skeleton) <= CACHED else _path_set.__wrapped__)(skeleton)


@functools.lru_cache(maxsize=4096)
def _path_set(skeleton: str) -> frozenset[int]:
    found, path = [], []
    for line in skeleton.split("\n"):
        depth, _, label = line.partition(" ")
        del path[int(depth) :]
        path.append(hash((path[-1] if path else 0, label)))
        found.append(path[-1])
    return frozenset(found)


def _likeness(one: str, other: str) -> float:
    a, b = _paths(one), _paths(other)
    return 2 * len(a & b) / (len(a) + len(b))


def nearest(skeleton: str, references: tuple[str, ...]) -> int:
    """The layout of a skeleton: the number of the reference most like it, the first one of equals."""
    if len(references) == 1:
        return 0
    return max(range(len(references)), key=lambda i: (_likeness(skeleton, references[i]), -i))


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, list[tuple[str, int]]]]:
    """For each key in turn the skeletons unlike all before them, with the number of pages most like each. Rows come by key, the most frequent first."""
    at, found, sizes = None, [], []
    for pdf in batches:
        for *own, skeleton, n in zip(*(pdf[k] for k in (*key, "skeleton", "n")), strict=True):
            if own != at:
                if at is not None:
                    yield tuple(at), list(zip(found, sizes, strict=True))
                at, found, sizes = own, [], []
            best = nearest(skeleton, tuple(found)) if found else 0
            if not found or _likeness(skeleton, found[best]) < SAME_LAYOUT:
                best = len(found)
                found.append(skeleton)
                sizes.append(0)
            sizes[best] += n
    if at is not None:
        yield tuple(at), list(zip(found, sizes, strict=True))


def _part_leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The layouts among a part of a host's skeletons."""
    for (host, _), leaders in _groups(batches, ["host", "part"]):
        yield pd.DataFrame([(host, s, n) for s, n in leaders], columns=["host", "skeleton", "n"])


def _leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The references of each host from the layouts of its parts. References met by too few pages go, but for the first one of a host
    with enough pages altogether."""
    for (host,), leaders in _groups(batches, ["host"]):
        if sum(n for _, n in leaders) >= CONSTANT_PAGES:
            kept = [r for r, n in leaders if n >= CONSTANT_PAGES] or [leaders[0][0]]
            yield pd.DataFrame([(host, kept)], columns=["host", "references"])


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for host, skeleton, references, n in zip(pdf["host"], pdf["skeleton"], pdf["references"], pdf["n"], strict=True):
            layout = nearest(skeleton, tuple(references))
            rows += [(host, layout, slot, n) for slot in align(skeleton, references[layout]).values()]
        yield pd.DataFrame(rows, columns=["host", "layout", "slot", "pages"])


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for host, skeleton, references, slots, digests in zip(pdf["host"], pdf["skeleton"], pdf["references"], pdf["slots"], pdf["digests"], strict=True):
            layout = nearest(skeleton, tuple(references))
            partner = align(skeleton, references[layout])
            rows += [(host, layout, partner[s], d) for s, d in zip(slots, digests, strict=True) if s in partner]
        yield pd.DataFrame(rows, columns=["host", "layout", "slot", "digest"])


def induce(pages: DataFrame) -> DataFrame:
    """The wrappers of every host: ``host, references``, a skeleton for each layout, and ``constant``, the digests of template texts
    with their layout and slot.

    All pages of a host count, but pages with the same text once, so that copies do not make an article template. Counts are taken
    before rows move, so a host with a third of all pages is a few rows; the template texts of a layout are at most 1 / CONSTANT_SHARE times as many
    as a page has texts on average, so a host's row is bounded by its layouts.
    """
    key = ["host", "layout", "slot"]
    shapes = durable(pages.select("url", "html").mapInPandas(_skeletons, "host string, page long, skeleton string, slots array<int>, digests array<long>").dropDuplicates(["host", "page"]))
    counts = durable(shapes.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n")))
    order = ["host", F.desc("n"), "skeleton"]
    parted = counts.withColumn("part", F.pmod(F.xxhash64("skeleton"), F.lit(PARTS))).repartition("host", "part").sortWithinPartitions("host", "part", *order[1:])
    layouts = parted.mapInPandas(_part_leaders, "host string, skeleton string, n long")
    hosts = durable(layouts.repartition("host").sortWithinPartitions(*order).mapInPandas(_leaders, "host string, references array<string>"))
    known = maybe_broadcast(hosts)
    nodes = counts.join(known, "host").mapInPandas(_nodes, "host string, layout int, slot int, pages long").groupBy(key).agg(F.sum("pages").alias("pages"))
    seen = shapes.join(known, "host").mapInPandas(_aligned, "host string, layout int, slot int, digest long")
    agreed = seen.groupBy(*key, "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CONSTANT_PAGES)
    constant = agreed.join(nodes.where(F.col("pages") >= CONSTANT_PAGES), key).where(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    return hosts.join(constant.groupBy("host").agg(F.collect_list(F.struct("layout", "slot", "digest")).alias("constant")), "host")


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``.

    pages needs page_id, url and html; other columns are ignored. A null or empty html gives an empty text; a page without a
    usable url belongs to the host "". Repeated rows are repeated in the result, an empty table gives no rows. Malformed markup
    is read as far as it goes, in time that is linear in its length: open elements end where their parents do, a "<" that starts no tag is text,
    a comment that is never closed ends with the page, and a quote that is never closed is none.
    """
    wrappers = durable(induce(pages))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit("")).alias("host"))
    # Wrappers that are small are brought to the tasks, once. Else pages and wrappers meet by host, but for hosts with a large share of all pages.
    if maybe_broadcast(wrappers) is wrappers:
        sizes = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
        met = join_counted(keyed, durable(wrappers.join(sizes, "host")), "host", "_pages").select("page_id", "url", "html", "references", "constant")

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _texts(pdf, (None if r is None else Wrapper(r, c) for r, c in zip(pdf["references"], pdf["constant"], strict=True)))

    else:
        met = keyed.select("page_id", "url", "html", "host")
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["references"], [c.asDict() for c in r["constant"]]) for r in wrappers.collect()})

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made = functools.lru_cache(maxsize=None)(lambda host: Wrapper(*known.value[host]) if host in known.value else None)
            for pdf in batches:
                yield _texts(pdf, map(made, pdf["host"]))

    return met.mapInPandas(read, "page_id long, url string, text string, n_chars long")


def _texts(pdf: pd.DataFrame, wrappers: Iterable[Wrapper | None]) -> pd.DataFrame:
    texts = [main_text(h, w) for h, w in zip(pdf["html"], wrappers, strict=True)]
    return pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})
