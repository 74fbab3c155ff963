"""Main text of web pages by equivalence-class template deduction.

Pages of a host are dealt with in groups. A token is a tag or a word together with the path
of elements around it. Tokens that share an occurrence vector (how often each occurs on each
page of the group) form an equivalence class, valid if its tokens keep one order. The class
of tokens that occur once on a page is the template's root. Between two root tokens the
classes of repeated tokens (records, such as a list's items or an article's paragraphs) are
nested, each inside the record that holds it. The text between template tokens stands in slots; slots
are the same places on all pages, so what a slot is (links, a menu, the article) is decided
once from what all pages of the group have there. The article is what is left in the slots
of the main container, without blocks that are template words throughout.

Names of elements and classes only choose among what is left: a name closes an element unless
that is the one that holds most of the page's text that is no link, whatever it is called.

Pages of hosts with fewer than ``LEAST`` distinct pages, or with copies of one article only,
have no template; for them names, overruled in the same way, and the page's own text decide.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of a host that are deduced together, about; from so many on a template is deduced.
GROUP, LEAST = 150, 3
#: Characters of the pages that are deduced together, about.
GROUP_CHARS = 32 << 20
#: A whole name does not hold if it closes so many characters and leaves less than this share of them open.
MUCH, LEFT = 140, 0.1
#: Pages whose text that no name or link closes is in blocks that nearly all of them have, to this share, are copies of one article.
SAME = 0.95
#: Share of the pages that must show the root's tokens; least tokens of a class, and pages that show a nested one.
SUPPORT, CLASS, NESTED = 0.9, 2, 3
#: Share of the text that the main container holds.
MOST = 0.7
#: Hosts with more than GROUP pages whose sizes may be broadcast.
BROADCAST_HOSTS = 100_000

# Element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NOT_TEXT = frozenset("nav footer aside form menu dialog button select head title fieldset datalist input label".split())
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies search pagination pager copyright legal disclaimer skip".split()
)
#: Words of wrappers that are named after what stands in them (such as "with-sidebar").
AROUND = frozenset("with has no".split())
#: Words that say where or what kind of box an element is; with one of the words above they make a name (such as "site-footer").
PLACES = frozenset("site page main global primary secondary top bottom left right upper lower inner outer list area box bar wrap wrapper container section block item items link links group row col column holder panel content article entry story post posts reader readers user users form field button icon icons text title head header body fixed sticky mobile desktop first last".split())
#: How sure a name is: a part of a name that also has words of its own, a whole name, and what never holds text for readers.
WEAK, WHOLE, NEVER = 1, 2, 3
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = frozenset("article main content articlebody entry post story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|textarea)\b[^>]*>|"
    r"(</?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/a-zA-Z][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|(?<=[\s\"']))(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_ENDS: dict[str, re.Pattern] = {}
_INLINE = frozenset("b i em strong span a font u".split())
#: No main container, and what holds no text for readers whatever its name.
_LEAVES, _NEVER = frozenset("p b i em strong span li br".split()), frozenset("head title".split())
#: A new element of the first kind ends an open one of these.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _named(value: str) -> int:
    """How sure a class or id says that an element is no article."""
    found = 0
    for name in value.split():
        words = set(_WORD.findall(name))
        if words & CHROME and not words & AROUND:
            found = max(found, WHOLE if words <= CHROME | PLACES else WEAK)
    return found


_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})\b", re.I)


def _kind(name: str, attributes: str) -> tuple[str, int, bool]:
    """An element's signature, how sure its names say that it holds no article text, and whether it may be the main container."""
    signature, level, main = name, NEVER if name in _NEVER else WHOLE if name in NOT_TEXT else 0, name in ("article", "main")
    whole = False
    if attributes and "=" in attributes or "hidden" in attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "role":
                level = max(level, WHOLE if value in ROLES else 0)
                main |= value in ("main", "article")
            elif key in ("class", "id"):
                signature += f".{value}" if not re.search(r"\d", value) else ""
                if name not in ("body", "html", "main", "article"):
                    level = max(level, _named(value))
                if name in ("div", "section", "td"):
                    main |= bool(set(_WORD.findall(value)) & MAIN)
                    whole |= any(set(_WORD.findall(n)) & MAIN and not set(_WORD.findall(n)) & CHROME for n in value.split())
            elif key == "itemprop":
                main |= value == "articlebody"
            elif key == "style":
                level = max(level, WHOLE if "display:none" in value.replace(" ", "") else 0)
            else:
                level = max(level, WHOLE if key == "hidden" and not value or value == "true" else 0)
    if level == WEAK and whole:  # called an article by a name of its own
        level = 0
    return signature, level, main


class Paths:
    """Numbers for paths of elements: a path is the one above it and an element's signature."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.up: list[int] = []
        self.name: list[str] = []
        self.level: list[int] = []  # how sure its own name is
        self.chrome: list[bool] = []  # by its name or that of an element above
        self.marked: list[bool] = []  # may be the main container, by its name
        self.inside: list[bool] = []  # itself or an element above is marked
        self.kinds: dict[tuple[str, str], tuple[str, int, bool]] = {}

    def number(self, up: int, name: str, attributes: str) -> int:
        kind = self.kinds.get((name, attributes))
        if kind is None:
            kind = _kind(name, attributes)
            if len(attributes) < 200:
                self.kinds[(name, attributes)] = kind
        key = (up, *kind)
        found = self.known.get(key)
        if found is None:
            _, level, main = kind
            inside = up >= 0 and self.inside[up]
            if name == "header" and not inside:
                level = max(level, WHOLE)
            chrome = level > 0 or up >= 0 and self.chrome[up]
            found = self.known[key] = len(self.up)
            self.up.append(up)
            self.name.append(name)
            self.level.append(level)
            self.chrome.append(chrome)
            self.marked.append(main and not chrome)
            self.inside.append(inside or main and not chrome)
        return found


def _raw_end(html: str, start: re.Match, unclosed: set[str]) -> int:
    """Where an element without text for readers ends; one that is never closed ends before the next block.

    ``unclosed`` are names without an end tag from here on, so that a page is searched once for each.
    """
    name = start.group(1).lower()
    if name == "svg" and start.group().endswith("/>"):
        return start.end()
    if name not in unclosed:
        if name not in _RAW_ENDS:
            _RAW_ENDS[name] = re.compile(rf"</{name}\s*>", re.I)
        end = _RAW_ENDS[name].search(html, start.end())
        if end:
            return end.end()
        unclosed.add(name)
    end = _BLOCK_TAG.search(html, start.end())
    return end.start() if end else len(html)


class Page:
    """Elements of a page (path, and the element above), its tags in order, and its blocks of text.

    A tag is its path's number, an end tag that number's complement. A block is its words,
    its element, the characters of its links and the number of tags before it.
    """

    def __init__(self, html: str, paths: Paths):
        self.tags: list[int] = []
        self.path: list[int] = []
        self.above: list[int] = []
        self.blocks: list[tuple[list[str], int, int, int]] = []
        stack: list[tuple[str, int]] = []  # name, element
        open_: Counter = Counter()
        text: list[str] = []
        links = 0

        def flush() -> None:
            nonlocal links
            if text:
                words = entities.unescape("".join(text)).split()
                if words:
                    self.blocks.append((words, stack[-1][1] if stack else -1, links, len(self.tags)))
                text.clear()
            links = 0

        at, unclosed = 0, set()
        while m := _TOKEN.match(html, at):
            at = m.end()
            run = m.group(5)
            if run is not None:
                text.append(run)
                if any(s[0] == "a" for s in stack[-4:]):
                    links += len(run)
                continue
            name = m.group(3)
            if name is None:
                if text:
                    text.append(" ")
                if m.group(1):
                    at = _raw_end(html, m, unclosed)
                continue
            name = name.lower()
            if m.group(2) == "</":
                if name in BLOCK:
                    flush()
                if open_[name]:
                    depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                    self.tags.append(~self.path[stack[depth][1]])
                    for n, _ in stack[depth:]:
                        open_[n] -= 1
                    del stack[depth:]
                continue
            attributes = m.group(4) or ""
            if name in BLOCK:
                flush()
                enders = _ENDS.get(name, ())
                while enders and stack and (stack[-1][0] in enders or stack[-1][0] in _INLINE and any(open_[e] for e in enders)):
                    open_[stack.pop()[0]] -= 1
            elif name == "br":
                text.append(" ")
            above = stack[-1][1] if stack else -1
            path = paths.number(self.path[above] if above >= 0 else -1, name, attributes)
            self.tags.append(path)
            if name not in VOID and not attributes.endswith("/"):
                self.path.append(path)
                self.above.append(above)
                stack.append((name, len(self.path) - 1))
                open_[name] += 1
        flush()

    def events(self):
        """Tags and blocks in page order: (tag, None) or (None, number of the block)."""
        k = 0
        for i, tag in enumerate(self.tags):
            while k < len(self.blocks) and self.blocks[k][3] <= i:
                yield None, k
                k += 1
            yield tag, None
        while k < len(self.blocks):
            yield None, k
            k += 1

    def path_of(self, block: int) -> int:
        element = self.blocks[block][1]
        return self.path[element] if element >= 0 else -1

    def closed_by_name(self, paths: Paths, counts: list[bool]) -> list[bool]:
        """For each block whether a name closes it; ``counts`` are the blocks whose text counts.

        The largest element with a weak name is opened if it holds more than all that no name
        closes, one with a whole name if hardly anything else is left.
        """
        level = [paths.level[p] for p in self.path]
        own = [0] * len(level)
        outside = 0
        for (words, e, links, _), counted in zip(self.blocks, counts):
            size = max(0, _size(words) - links) if counted else 0
            if e >= 0:
                own[e] += size
            else:
                outside += size
        total = list(own)
        for e in range(len(level) - 1, -1, -1):
            if self.above[e] >= 0:
                total[self.above[e]] += total[e]
        while True:
            under = [0] * len(level)  # the level that closes the element, its own or that of the outermost above
            free, best = outside, {}
            for e, up in enumerate(self.above):
                if up >= 0 and under[up]:
                    under[e] = under[up]
                elif level[e]:
                    under[e] = level[e]
                    if level[e] not in best or total[e] > total[best[level[e]]]:
                        best[level[e]] = e
                else:
                    free += own[e]
            weak, whole = best.get(WEAK), best.get(WHOLE)
            opened = weak if weak is not None and total[weak] > free else whole if whole is not None and total[whole] >= MUCH and free < LEFT * total[whole] else None
            if opened is None:
                return [e >= 0 and under[e] > 0 for _, e, _, _ in self.blocks]
            level[opened] = 0
            inner = {opened}
            for e in range(opened + 1, len(level)):
                if self.above[e] in inner:
                    inner.add(e)
                    if paths.name[self.path[e]] == "header" and level[e] == WHOLE:
                        level[e] = 0  # of the article, as it stands in it


def _increasing(values: list[int]) -> set[int]:
    """The values of a longest increasing subsequence."""
    tails: list[int] = []
    places: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(places[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            places.append(i)
        else:
            tails[k], places[k] = v, i
    out, i = set(), places[-1] if places else -1
    while i >= 0:
        out.add(values[i])
        i = back[i]
    return out


class Template:
    """The nested classes of a group of pages.

    ``root`` numbers the root's tokens in order. ``records`` names for each pair of a gap of the root
    and a tag in it the record (nested class) of the tag, and the tag's number in the record; ``sizes`` are
    the records' numbers of tags and ``parents`` the slots they stand in. ``words`` are the template words of each slot.
    """

    def __init__(self, pages: list[Page]):
        self.root: dict = {}
        self.records: dict[tuple[int, int], tuple[int, int]] = {}
        self.sizes: list[int] = []
        self.parents: list[tuple] = []
        self.words: set = set()
        self._texts: set[str] = set()
        self._known: dict[int, list[tuple]] = {}
        n = len(pages)
        if n >= LEAST:
            self._root(pages, SUPPORT * n)
            self._nest(pages)
            self._parents(pages)
            self._record_words(pages, SUPPORT * n)

    def _root(self, pages: list[Page], least: float) -> None:
        held: Counter = Counter()
        for p in pages:
            held.update({*p.tags, *((p.path_of(i), w) for i, b in enumerate(p.blocks) for w in b[0])})
        often = {t for t, c in held.items() if c >= least}
        once, rows = set(often), []
        words = {t[1] for t in often if not isinstance(t, int)}
        for p in pages:
            row = [t for tag, k in p.events() for t in ([tag] if k is None else [(p.path_of(k), w) for w in p.blocks[k][0] if w in words]) if t in often]
            once -= {t for t, c in Counter(row).items() if c > 1}
            rows.append(row)
        self._often = often - once
        longest = max(rows, key=lambda r: sum(t in once for t in r))
        order = {t: i for i, t in enumerate(t for t in longest if t in once)}
        keep = set(order.values())
        for row in rows:
            places = [order[t] for t in row if t in order]
            keep -= set(places) - _increasing(places)
        kept = [t for t, i in order.items() if i in keep]
        # An element is in the root with both its tags, or with the first if its end is left out on all pages.
        lost = {t for t in kept if isinstance(t, int) and t >= 0 and ~t in held and ~t not in order} | {t for t in kept if isinstance(t, int) and t < 0 and ~t not in order}
        kept = [t for t in kept if t not in lost]
        if sum(isinstance(t, int) for t in kept) >= CLASS:
            self.root = {t: i for i, t in enumerate(kept)}
            self.words = {t for t in kept if not isinstance(t, int)}
            self._texts = {t[1] for t in self.words}

    def _gaps(self, page: Page) -> list[tuple]:
        """Events outside the root with the root token before them: (gap, tag, block)."""
        known = self._known.get(id(page))
        if known is None:
            known = self._known[id(page)] = list(self._walk(page))
        return known

    def _walk(self, page: Page):
        gap, texts = -1, self._texts
        for tag, k in page.events():
            if k is None:
                if tag in self.root:
                    gap = self.root[tag]
                else:
                    yield gap, tag, None
            else:
                yield gap, None, k
                if not texts.isdisjoint(page.blocks[k][0]):
                    for w in page.blocks[k][0]:
                        gap = self.root.get((page.path_of(k), w), gap)

    def _nest(self, pages: list[Page]) -> None:
        """Tags of a gap with equal vectors, repeated in one order, are a record."""
        vectors: dict = defaultdict(Counter)
        orders: list[dict[int, list[int]]] = []
        for i, p in enumerate(pages):
            seen: dict[int, list[int]] = defaultdict(list)
            for gap, tag, _ in self._gaps(p):
                if tag is not None:
                    vectors[(gap, tag)][i] += 1
                    seen[gap].append(tag)
            orders.append(seen)
        classes: dict = defaultdict(list)
        for (gap, tag), vector in vectors.items():
            if len(vector) >= NESTED:
                classes[(gap, tuple(sorted(vector.items())))].append(tag)
        for (gap, vector), tags in classes.items():
            if len(tags) < CLASS:
                continue
            members, period = set(tags), None
            for i, count in vector:
                row = [t for t in orders[i][gap] if t in members]
                period = period or row[: len(tags)]
                if row != period * count:
                    break
            else:
                for k, tag in enumerate(period):
                    self.records[(gap, tag)] = (len(self.sizes), k)
                self.sizes.append(len(period))

    def slots(self, page: Page) -> list[tuple]:
        """The slot of each block: the gap of the root, and the innermost record around it with the tag before it there."""
        out: list[tuple] = [()] * len(page.blocks)
        open_: list[tuple[int, int]] = []
        last = None
        for gap, tag, k in self._gaps(page):
            if gap != last:
                open_, last = [], gap
            if tag is not None:
                if (at := self.records.get((gap, tag))) is not None:
                    while any(r == at[0] for r, _ in open_):  # what stands inside ends with the record's next tag
                        open_.pop()
                    if at[1] + 1 < self.sizes[at[0]]:
                        open_.append(at)
            else:
                out[k] = (gap, *(open_[-1] if open_ else (-1, -1)))
        return out

    def _parents(self, pages: list[Page]) -> None:
        found: list[Counter] = [Counter() for _ in self.sizes]
        for p in pages:
            open_, last = [], None
            for gap, tag, _ in self._gaps(p):
                if gap != last:
                    open_, last = [], gap
                if tag is not None and (at := self.records.get((gap, tag))) is not None:
                    while any(r == at[0] for r, _ in open_):
                        open_.pop()
                    if at[1] == 0:
                        found[at[0]][(gap, *(open_[-1] if open_ else (-1, -1)))] += 1
                    if at[1] + 1 < self.sizes[at[0]]:
                        open_.append(at)
        self.parents = [c.most_common(1)[0][0] if c else () for c in found]

    def _record_words(self, pages: list[Page], least: float) -> None:
        """Words that occur in a record's slot as often as the record, on all pages that have it."""
        slots = [self.slots(p) for p in pages]
        often = {t[1] for t in self._often if not isinstance(t, int)}
        times: dict = defaultdict(Counter)
        records: dict = defaultdict(Counter)
        for i, p in enumerate(pages):
            for gap, tag, _ in self._gaps(p):
                if tag is not None and self.records.get((gap, tag), (0, 1))[1] == 0:
                    records[self.records[(gap, tag)][0]][i] += 1
            for k, s in enumerate(slots[i]):
                if s[1] >= 0 and not often.isdisjoint(p.blocks[k][0]):
                    for w in p.blocks[k][0]:
                        if w in often and (p.path_of(k), w) in self._often:
                            times[(s, w)][i] += 1
        found = {key for key, vector in times.items() if vector == records[key[0][1]]}
        self.words |= found
        self._texts |= {w for _, w in found}

    def constant(self, page: Page, k: int, slot: tuple) -> bool:
        """Whether a block is template words throughout."""
        path = page.path_of(k)
        if not self._texts.issuperset(page.blocks[k][0]):
            return False
        return all((path, w) in self.words or (slot, w) in self.words for w in page.blocks[k][0])


def _sums(up: list[int], own: dict[int, int]) -> list[int]:
    """What each path holds with the paths below it; paths above come first."""
    out = [own.get(i, 0) for i in range(len(up))]
    for i in range(len(up) - 1, -1, -1):
        if up[i] >= 0:
            out[up[i]] += out[i]
    return out


def _size(words: list[str]) -> int:
    return sum(map(len, words)) + 1


def _container(paths: Paths, own: dict[int, int], marks: bool) -> set[int]:
    """The path of the main container: the marked one with most text, else the deepest with most of it.

    Several marked paths without one that holds most of their text are all containers. -1 is the page itself.
    """
    total = _sums(paths.up, own)
    marked = [i for i, m in enumerate(paths.marked) if m and total[i]] if marks else []
    if marked:
        best = max(marked, key=lambda i: (total[i], i))
        outer = [i for i in marked if paths.up[i] < 0 or not paths.inside[paths.up[i]]]
        return {best} if total[best] >= 0.6 * sum(total[i] for i in outer) else set(outer)
    most, depth = sum(own.values()), []
    for up in paths.up:
        depth.append(depth[up] + 1 if up >= 0 else 0)
    best = max((i for i, t in enumerate(total) if t and t >= MOST * most), key=lambda i: (depth[i], total[i]), default=-1)
    while best >= 0 and paths.name[best] in _LEAVES:
        best = paths.up[best]
    return {best}


def _inside(page: Page, live: list[int], main: set[int]) -> list[int]:
    """The live blocks inside elements of the main paths; if one such element holds most of them, only its own."""
    if -1 in main:
        return live
    holder: list[int] = []
    for e, path in enumerate(page.path):
        above = page.above[e]
        held = holder[above] if above >= 0 else -1
        holder.append(e if held < 0 and path in main else held)
    of = {k: holder[page.blocks[k][1]] if page.blocks[k][1] >= 0 else -1 for k in live}
    held: Counter = Counter()
    for k, e in of.items():
        if e >= 0:
            held[e] += _size(page.blocks[k][0])
    if not held:
        return []
    best, most = held.most_common(1)[0]
    return [k for k in live if (of[k] == best if most >= 0.6 * held.total() else of[k] >= 0)]


def extract(htmls: list[str | None], template: type = Template, names: bool = True) -> list[list[str]]:
    """The article's blocks of each page of one group; without ``names`` those of elements and classes tell nothing."""
    paths = Paths()
    pages = [Page(h or "", paths) for h in htmls]
    if not names:
        paths.level = [NEVER * (n in _NEVER) for n in paths.name]
    distinct = list({tuple(tuple(b[0]) for b in p.blocks): p for p in pages if p.blocks}.values())
    found = template(distinct)
    if not found.root:
        return [[" ".join(p.blocks[k][0]) for k in _alone(p, paths, names)] for p in pages]
    slots = [found.slots(p) for p in pages]
    weight, linked, chrome, own = Counter(), Counter(), Counter(), Counter()
    fixed: list[list[bool]] = []
    shared = Counter(key for p in distinct for key in {(p.path_of(k), tuple(b[0])) for k, b in enumerate(p.blocks)})
    open_, same_ = 0, 0
    for p, of in zip(pages, slots):
        fixed.append([found.constant(p, k, s) for k, s in enumerate(of)])
        by_name = p.closed_by_name(paths, [not f for f in fixed[-1]])
        for k, (words, _, links, _) in enumerate(p.blocks):
            size = _size(words)
            weight[of[k]] += size
            linked[of[k]] += min(links, size)
            chrome[of[k]] += size * by_name[k]
            if not by_name[k] and 2 * links <= size:
                open_, same_ = open_ + size, same_ + size * (shared[(p.path_of(k), tuple(words))] >= SUPPORT * len(distinct))
    if same_ > SAME * open_:
        return [[" ".join(p.blocks[k][0]) for k in _alone(p, paths, names)] for p in pages]
    closed = {s for s, w in weight.items() if 2 * linked[s] > w or 2 * chrome[s] > w}
    # What is nested in a closed slot is closed.
    for r, up in enumerate(found.parents):
        closed |= {s for s in weight if s[1] == r and up in closed}
    lives = []
    for p, of, same in zip(pages, slots, fixed):
        live = [k for k, s in enumerate(of) if s not in closed and not same[k]]
        for k in live:
            own[p.path_of(k)] += _size(p.blocks[k][0])
        lives.append(live)
    main = _container(paths, own, names)
    out = []
    for p, live in zip(pages, lives):
        kept = _inside(p, live, main) or (_inside(p, live, _container(paths, Counter({p.path_of(k): _size(p.blocks[k][0]) for k in live}), names)) if live else [])
        out.append([" ".join(p.blocks[k][0]) for k in kept])
    return out


def _alone(page: Page, paths: Paths, names: bool) -> list[int]:
    """The article's blocks of a page without a template."""
    weight, linked, own = Counter(), Counter(), Counter()
    for k, (words, _, links, _) in enumerate(page.blocks):
        weight[page.path_of(k)] += _size(words)
        linked[page.path_of(k)] += min(links, _size(words))
    by_name = page.closed_by_name(paths, [True] * len(page.blocks))
    live = [k for k in range(len(page.blocks)) if not by_name[k] and 2 * linked[at := page.path_of(k)] <= weight[at]]
    for k in live:
        own[page.path_of(k)] += _size(page.blocks[k][0])
    return _inside(page, live, _container(paths, own, names)) if live else []


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``.

    Pages of a host are dealt out in groups of about ``GROUP`` by a hash of the page, so a host
    of any size makes bounded groups; every page is extracted with its own group's template,
    in time and memory linear in the pages' length, however deep their elements are.
    A null html gives an empty text, a null url belongs to the host of none, repeated rows
    are extracted each, deduced once in a group and spread over groups like others; groups have
    about ``GROUP`` pages and ``GROUP_CHARS`` characters at most; an empty table gives an empty result; other
    columns are not read.
    """
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    df = pages.select("page_id", "url", "html", F.lower(host).alias("host"), F.monotonically_increasing_id().alias("row"))
    shares = F.greatest(F.count("*") / GROUP, F.sum(F.length("html")) / GROUP_CHARS)
    large = df.groupBy("host").agg(F.ceil(shares).cast("int").alias("groups")).where("groups > 1")
    few = large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    df = df.join(F.broadcast(large) if few else large, "host", "left")
    df = df.withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url", "row"), F.col("groups")), F.lit(0)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text = ["\n".join(blocks) for blocks in extract(pdf["html"].tolist())]
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = df.schema["page_id"].dataType.simpleString()
    return df.drop("groups", "row").groupBy("host", "part").applyInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
