"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of each host."""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Latest, materialize

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select option button head".split())
BLOCK = frozenset(
    "address article aside blockquote body br-block caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a block start inside them ends, unless one of the others stands between.
ENDS_P = BLOCK - frozenset("li dd dt td th tr tbody thead tfoot caption col colgroup body html legend optgroup".split())
#: Elements and words in class, id or role that mark what is no article text.
ASIDE = frozenset("nav footer aside form dialog menu search".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar"
    " notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " teaser teasers alert comment comments disqus respond reply replies complementary contentinfo search pagination pager widget".split()
)
#: A host's main container is the first of these that holds half of its wrapper's text; else where most text is.
MAIN = ("article", "main")
MAIN_WORDS = frozenset("article main content post entry story body text".split())
WHOLE = frozenset(("html", "body", "main"))
#: Elements of running text: a class hides them only if all parts of one of its names are words above, as in cookie-notice.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption a b i em strong span small sub sup u code q".split())
#: Share of a container's text that a part of it must hold to be the main container instead.
MOST = 0.7
#: Different pages of a host from which on a text that all of them have, where the wrapper aligns it, is template text.
TEMPLATE_PAGES = 5
#: Pairs of tokens that are compared in a table where two streams differ; longer stretches are cut at tokens that each has once, or in halves.
PAIRS = 200_000
#: Structures of a host that one group aligns, one after the other.
TOGETHER = 32

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+|[0-9]+")


def scan(html: str) -> Iterator[tuple[str, str, str]]:
    """('<', element, its class, id and role), ('>', element, '') and ('t', text as written, '').

    Comments, declarations and everything in scripts, styles, forms' controls and the head is left out.
    """
    at, size, skip_to = 0, len(html), None
    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            yield "t", html[at : m.start()], ""
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name not in RAW:
                yield ">", name, ""
        elif name in RAW:
            if m[3].rstrip().endswith("/") or name == "option":
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>|<body\b" if name == "head" else rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            if end is None:
                skip_to = size
            else:
                skip_to = end.start() if end[0][1] != "/" else end.end()
            at = skip_to
        else:
            yield "<", name, " ".join(a or b or c for a, b, c in _MARK.findall(m[3])) if m[3] else ""
    if at < size:
        yield "t", html[at:], ""


def key_of(name: str, marks: str) -> str:
    if not marks:
        return name
    words = marks.lower().split() if name in TEXT_LEVEL else _WORD.findall(marks.lower())
    return f"{name}.{'.'.join(sorted({w.replace('.', '-') for w in words}))}"


@functools.lru_cache(100_000)
def is_aside(key: str) -> bool:
    name, *words = key.split(".")
    if name == "article" and not MAIN_WORDS.isdisjoint(words):
        return False
    return name in ASIDE or (name not in WHOLE and any(ASIDE_WORDS.issuperset(parts) for w in words if (parts := _WORD.findall(w))))


_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
_LISTS = frozenset("ul ol dl table tbody thead tfoot menu".split())


class Open:
    """The elements open at a place of a page, with a value for each; an element of no open name is not searched for."""

    def __init__(self, root):
        self.names: list[str] = []
        self.values = [root]
        self.count: dict[str, int] = {}

    def push(self, name: str, value) -> None:
        self.names.append(name)
        self.values.append(value)
        self.count[name] = self.count.get(name, 0) + 1

    def _cut(self, size: int) -> None:
        while len(self.names) > size:
            self.count[self.names.pop()] -= 1
            self.values.pop()

    def _end(self, names: tuple[str, ...], walls: frozenset[str]) -> None:
        """Closes the innermost element of ``names`` and all in it, unless one of ``walls`` stands before it."""
        if any(self.count.get(n) for n in names):
            for i in range(len(self.names) - 1, -1, -1):
                if self.names[i] in names:
                    return self._cut(i)
                if self.names[i] in walls:
                    return None

    def close(self, name: str) -> None:
        """End tag: closes the innermost element of that name and all in it; none open: nothing."""
        self._end((name,), frozenset())

    def imply(self, name: str) -> None:
        """What a start tag ends without an end tag: an open p at a block, an open li, dt, dd, td, th or tr at its like."""
        if name in ENDS_P:
            self._end(("p",), BLOCK)
        if name in _LIKE:
            self._end(_LIKE[name], _LISTS)


# Wrappers. An item is a tag ("<key", ">name"), a text ("t", hash or None for a slot, characters), an optional ("?", items) or a repeated group ("+", items).


def key(item) -> object:
    """What items are aligned by: texts by being texts, groups by their items."""
    if isinstance(item, str):
        return item
    return "t" if item[0] == "t" else (item[0], tuple(map(key, item[1])))


def join(a, b):
    """Two items of one key as one: texts that differ become a slot."""
    if isinstance(a, str):
        return a
    if a[0] == "t":
        return ("t", a[1] if a[1] == b[1] else None, a[2] + b[2])
    return (a[0], tuple(map(join, a[1], b[1])))


def repeat(body: list):
    """A repeated group; one of a single group is no deeper than that."""
    if len(body) == 1 and not isinstance(body[0], str):
        if body[0][0] == "+":
            return body[0]
        if body[0][0] == "?":
            return ("?", (repeat(list(body[0][1])),))
    return ("+", tuple(body))


def optional(body: list):
    return body[0] if len(body) == 1 and not isinstance(body[0], str) and body[0][0] == "?" else ("?", tuple(body))


def whole(items: list) -> bool:
    """Whether items close what they open, but for elements that their like ends, and nothing else."""
    open_names: list[str] = []
    for x in items:
        if isinstance(x, str):
            name = x[1:].split(".", 1)[0]
            if x[0] == "<":
                if name not in VOID:
                    open_names.append(name)
            elif name in open_names:
                while open_names.pop() != name:
                    pass
            else:
                return False
    return all(name == "p" or name in _LIKE for name in open_names)


def fold(items: list) -> list:
    """Items with groups that follow on themselves folded into repeated groups, of any length, from the left, until none is left.

    Only whole groups are: end tags that follow each other close different elements.
    """
    while True:
        ids: dict = {}
        keys = [ids.setdefault(key(x), len(ids)) for x in items]
        again, last = [0] * len(keys), {}
        for i in range(len(keys) - 1, -1, -1):
            again[i] = last.get(keys[i], i) - i
            last[keys[i]] = i
        out, i = [], 0
        while i < len(items):
            period = again[i]
            group = keys[i : i + period]
            j = i + period
            if period and keys[j : j + period] == group and whole(items[i:j]):
                body = items[i:j]
                while keys[j : j + period] == group:
                    body = list(map(join, body, items[j : j + period]))
                    j += period
                out.append(repeat(fold(body) if period > 1 else body))
                i = j
            else:
                out.append(items[i])
                i += 1
        if len(out) == len(items):
            return items
        items = out


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a common subsequence of two streams, in order: the longest, except between anchors.

    Where what differs is long, tokens that each side has once are anchors, as many as come in the
    same order; a long stretch without any is cut where two halves of one side have the longest
    subsequences with two parts of the other, until it is short. Memory is linear.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, n, j, m = work.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= PAIRS:
            out += [(i + x, j + y) for x, y in _longest(a[i:n], b[j:m])]
            continue
        at_a, at_b = _once(a, i, n), _once(b, j, m)
        anchors = _rising([(at_a[x], at_b[x]) for x in at_a if x in at_b])
        if anchors:
            ends = [*anchors, (n, m)]
            for x, y in ends:
                work.append((i, x, j, y))
                i, j = x + 1, y + 1
            out += anchors
        elif n - i > 1:
            half = (i + n) // 2
            cut = j + _cut(a[i:half], a[half:n], b[j:m])
            work += [(i, half, j, cut), (half, n, cut, m)]
        elif a[i] in b[j:m]:
            out.append((i, b.index(a[i], j, m)))
    return sorted(out)


def _cut(head: list[int], tail: list[int], b: list[int]) -> int:
    """Where b is cut so that head with its first part and tail with the rest have the longest common subsequences."""
    first, last = _lengths(head, b), _lengths(tail[::-1], b[::-1])
    return int((first + last[::-1]).argmax())


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of a and each head of b: a bit for each place of b, all places at once."""
    wanted, places = set(a), {}
    for j, x in enumerate(b):
        if x in wanted:
            places.setdefault(x, []).append(j)
    bits = {}
    for x, at in places.items():
        own = np.zeros(len(b), np.uint8)
        own[at] = 1
        bits[x] = int.from_bytes(np.packbits(own, bitorder="little").tobytes(), "little")
    every = row = (1 << len(b)) - 1
    for x in a:
        if x in bits:
            hit = row & bits[x]
            row = ((row + hit) | (row - hit)) & every
    grown = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)] == 0
    return np.concatenate([[0], np.cumsum(grown)])


def _once(keys: list[int], i: int, n: int) -> dict[int, int]:
    """Keys that stand once from i to n, and where; in order."""
    seen: dict[int, int] = {}
    for x in range(i, n):
        seen[keys[x]] = -1 if keys[x] in seen else x
    return {k: x for k, x in seen.items() if x >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rise in both places, of pairs that rise in the first."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        before[i] = ends[at - 1] if at else -1
        tails[at : at + 1] = [y]
        ends[at : at + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _longest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, own = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if own == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """The wrapper of what matches either: a common subsequence by key, mismatches made groups."""
    ids: dict = {}
    ka, kb = ([ids.setdefault(key(x), len(ids)) for x in items] for items in (a, b))
    if ka == kb:
        return list(map(join, a, b))
    out, i, j = [], 0, 0
    for x, y in [*common(ka, kb), (len(a), len(b))]:
        if x > i or y > j:
            out.extend(mismatch(out, a[i:x], b[j:y]))
        if x < len(a):
            out.append(join(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def accept(group, items: list, keys: list):
    """``group`` with ``items`` (of these keys) joined in if it matches them; else None."""
    if isinstance(group, str) or group[0] == "t" or not items:
        return None
    kind, body = group
    if keys[0] == key(group) and len(keys) == 1:
        return join(group, items[0])
    if key(body[0]) == keys[0] and len(keys) % len(body) == 0:
        own, times = [key(x) for x in body], len(keys) // len(body)
        if keys == own * times and (times == 1 or kind == "+"):
            for t in range(times):
                body = list(map(join, body, items[t * len(own) : (t + 1) * len(own)]))
            return (kind, tuple(body))
    if len(body) == 1 and (inner := accept(body[0], items, keys)) is not None:
        return (kind, (inner,))
    return None


def mismatch(before: list, left: list, right: list) -> list:
    """What stands where only one side has items, or each has its own.

    A group that matches the other side's items takes them in; items like those before make
    those a repeated group; what else only one side has is optional.
    """
    keys_of = [[key(x) for x in one] for one in (left, right)]
    for one, other, keys in ((left, right, keys_of[1]), (right, left, keys_of[0])):
        for i, x in enumerate(one):
            if (taken := accept(x, other, keys)) is not None:
                return [y if j != i else taken for j, y in enumerate(map(may_lack, one[:i] + [taken] + one[i + 1 :]))]
    out = []
    for one, keys in zip((left, right), keys_of):
        if not one:
            continue
        if before and (taken := accept(before[-1], one, keys)) is not None:
            before[-1] = taken
        elif len(one) <= len(before) and whole(one) and [key(x) for x in before[-len(one) :]] == keys:
            before[-len(one) :] = [repeat(list(map(join, before[-len(one) :], one)))]
        elif all(not isinstance(x, str) and x[0] == "?" for x in one):
            out += one
        else:
            out.append(optional(one))
    return out


def may_lack(item):
    return optional([item])


def structure(html: str) -> list:
    """A page as a wrapper of its own: its token stream, repeated groups folded."""
    items: list = []
    for kind, value, marks in scan(html):
        if kind == "t":
            if text := value.strip():
                items.append(("t", str(hash_text(text)), len(text)))
        elif kind == "<":
            items.append("<" + key_of(value, marks))
        else:
            items.append(">" + value)
    return fold(items)


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def texts(items) -> Iterator[tuple]:
    for x in items:
        if not isinstance(x, str):
            if x[0] == "t":
                yield x
            else:
                yield from texts(x[1])


def fill(items, values: Iterator[tuple]):
    """``items`` with each text, in order, replaced."""
    return [x if isinstance(x, str) else next(values) if x[0] == "t" else (x[0], tuple(fill(x[1], values))) for x in items]


def regions(wrapper: list) -> list[tuple]:
    """Elements of a wrapper in page order: (key, place of the parent, texts in it: (hash or None, characters, whether a page may lack it), whether they count, path).

    Texts do not count in asides, links and headers. Place 0 is the page.
    """
    out: list[tuple] = [("", -1, [], True, 0)]
    at = Open(0)

    def walk(items, lacking: bool) -> None:
        for x in items:
            if isinstance(x, str):
                name = x[1:].split(".", 1)[0]
                if x[0] == ">":
                    at.close(name)
                else:
                    at.imply(name)
                    own = at.values[-1]
                    out.append((x[1:], own, [], out[own][3] and name not in ("a", "header") and not is_aside(x[1:]), path_of(x[1:], out[own][4])))
                    if name not in VOID:
                        at.push(name, len(out) - 1)
            elif x[0] == "t":
                out[at.values[-1]][2].append((x[1], x[2], lacking))
            else:
                walk(x[1], lacking or x[0] == "?")

    walk(wrapper, False)
    return out


def container(wrapper: list) -> str:
    """The key of the element that holds a host's articles: article or main elements or one so named that hold half of the slot text, or the deepest with most of it.

    Slots are what the host's pages differ in; constant text counts a quarter. Where no text
    stands outside of asides, the first article or main element there is. Of elements that hold
    as much the first counts.
    """
    parts = regions(wrapper)
    # like elements of one parent are one region
    region: list[int] = []
    of: dict[tuple[int, str], int] = {}
    keys, parents, mass, paths = [], [], [], []
    for k, parent, found, counts, path in parts:
        up = region[parent] if parent >= 0 else -1
        at = of.setdefault((up, k), len(keys))
        if at == len(keys):
            keys.append(k)
            parents.append(up)
            mass.append(0)
            paths.append(path)
        region.append(at)
        mass[at] += sum(n if h is None else n // 4 for h, n, _ in found) if counts else 0
    held = dict.fromkeys(MAIN, 0)
    within = {name: [False] * len(keys) for name in MAIN}
    for name in MAIN:
        for at, k in enumerate(keys):
            within[name][at] = k.split(".", 1)[0] == name or (parents[at] >= 0 and within[name][parents[at]])
            held[name] += mass[at] * within[name][at]
    for at in range(len(keys) - 1, 0, -1):
        mass[parents[at]] += mass[at]
    every = mass[0]
    for name in MAIN:
        if 2 * held[name] >= every and any(k.split(".", 1)[0] == name for k in keys):
            return name
    for at, k in enumerate(keys):
        name, *words = k.split(".")
        if name in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words) and mass[at] > 0 and 2 * mass[at] >= every:
            return k
    below: dict[int, list[int]] = {}
    for at in range(1, len(keys)):
        below.setdefault(parents[at], []).append(at)
    best = 0
    while deeper := [at for at in below.get(best, ()) if mass[at] > 0 and mass[at] >= MOST * every and keys[at].split(".", 1)[0] in ("html", "body", "div", "section", "table", "tbody", "tr", "td")]:
        best = max(deeper, key=lambda at: mass[at])
    return f"#{paths[best]}" if paths[best] else "body"


def path_of(k: str, parent: int) -> int:
    """A number for the keys from the page's body to an element, given that of its parent."""
    return parent if k in ("html", "body") else zlib.crc32(k.encode("utf-8", "replace"), parent)


def template(wrapper: list, main: str, pages: int) -> list[str]:
    """Texts within the elements ``main`` that all pages of the host have where the wrapper aligns them: "hash key of the element".

    None unless at least TEMPLATE_PAGES different pages made the wrapper and differ within ``main``.
    """
    if pages < TEMPLATE_PAGES:
        return []
    parts, inside, out, slots = regions(wrapper), [], set(), 0
    for k, parent, found, _, path in parts:
        inside.append(same_element(k, path, main) or (parent >= 0 and inside[parent]))
        if inside[-1]:
            slots += sum(n for h, n, _ in found if h is None)
            out |= {f"{h} {k}" for h, _, lacking in found if h is not None and not lacking}
    return sorted(out) if slots else []


def same_element(k: str, path: int, main: str) -> bool:
    """Whether an element is one of ``main``: a path, a key, or the name of one of MAIN or of the body whatever its class."""
    if main[0] == "#":
        return f"#{path}" == main
    return k == main or ("." not in main and k.split(".", 1)[0] == main)


def extract(html: str | None, main: str = "article", constant: frozenset[str] = frozenset()) -> str:
    """The blocks of text in the elements ``main`` (all elements, if the page has none), without asides; joined by line ends.

    Elements ``main`` inside asides count only where the page has no text in others. ``constant``
    is the host's template text (see ``template``), which is left out.
    """
    if not html:
        return ""
    tokens = [(kind, value, key_of(value, marks) if kind == "<" else "") for kind, value, marks in scan(html)]
    inside = main[0] == "#" or any(kind == "<" and same_element(k, 0, main) for kind, _, k in tokens)
    blocks: list[str] = []
    apart: list[str] = []
    parts: list[str] = []
    # of the place: its element's key and path, whether in main, whether an aside is around main, whether it is hidden
    at = Open(("", 0, not inside, False, False))

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                (apart if beside else blocks).append(text)
            parts.clear()

    beside = met = False
    for kind, value, k in tokens:
        if kind == "t":
            own, _, shown, _, hidden = at.values[-1]
            if shown and not hidden and not (constant and f"{hash_text(value.strip())} {own}" in constant):
                parts.append(value)
            continue
        if value == "br":
            parts.append(" ")
        elif value in BLOCK:
            flush()
        if kind == ">":
            at.close(value)
        elif value not in VOID:
            at.imply(value)
            _, path, shown, around, hidden = at.values[-1]
            path = path_of(k, path)
            shown = shown or same_element(k, path, main)
            met |= shown
            off = is_aside(k) or (not inside and value == "header")
            at.push(value, (k, path, shown, around or (off and not shown), hidden or (off and shown)))
        beside = at.values[-1][3]
    flush()
    if not met and main[0] == "#":
        return extract(html, "body", constant)  # the page has no such place
    return "\n".join(blocks or apart)


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty for null or none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def thaw(x):
    """An item read back from JSON."""
    return x if isinstance(x, str) else (x[0], x[1], x[2]) if x[0] == "t" else (x[0], tuple(map(thaw, x[1])))


def merged(forms: DataFrame, last: bool) -> DataFrame:
    """``forms`` (``host, part, form, pages``) with one wrapper for each host and part, aligned one after the other.

    ``pages`` has a bit set for each of the pages that a form comes from (by hash, so it counts
    too few rather than too many). A task holds one wrapper, not the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wrapper, seen = None, [], 0

        def out() -> pa.RecordBatch:
            main = container(wrapper) if last else None
            drop = template(wrapper, main, (seen & ((1 << 64) - 1)).bit_count()) if last else None
            cols = [[at[0]], [json.dumps(wrapper, separators=(",", ":"))], [seen], [main], [drop]]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "form", "pages", "container", "template"])

        for b in batches:
            for host, part, form, pages in zip(*(c.to_pylist() for c in b.columns)):
                items = [thaw(x) for x in json.loads(form)]
                if at != (host, part):
                    if at is not None:
                        yield out()
                    at, wrapper, seen = (host, part), items, pages
                else:
                    wrapper, seen = fold(align(wrapper, items)), seen | pages
        if at is not None:
            yield out()

    rows = forms.select("host", "part", "form", "pages").repartition("host", "part").sortWithinPartitions("host", "part", "form")
    return rows.mapInArrow(run, "host string, form string, pages long, container string, template array<string>")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON), ``container``, ``template``: one for each host, from all its pages.

    Pages are folded by themselves; those of one structure meet in partial aggregates that tell
    slots from constant texts. The structures of a host are then aligned in a tree of rounds:
    groups of about TOGETHER each, until one group is left, so a host with very many structures
    is dealt to many tasks. Null and empty pages have the empty structure; repeated rows change
    nothing but characters; an empty table has no hosts.
    """
    ship(pages.sparkSession)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, forms, values, bits = [], [], [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                items = structure(html or "")
                found = list(texts(items))
                hosts.append(host)
                forms.append(json.dumps(fill(items, iter([("t", None, 0)] * len(found))), separators=(",", ":")))
                values.append([{"h": None if h is None else int(h), "n": n} for _, h, n in found])
                bit = hash_text(f"{forms[-1]} {[h for _, h, _ in found]}") % 64
                bits.append(1 << bit if bit < 63 else -(1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(forms), pa.array(bits, pa.int64()), pa.array(values, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))], ["host", "form", "page", "texts"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), html_col).mapInArrow(shape, "host string, form string, page long, texts array<struct<h:bigint,n:bigint>>")
    rows = rows.select("host", "form", "page", F.posexplode_outer("texts").alias("pos", "x"))
    each = rows.groupBy("host", "form", "pos").agg(F.min("x.h").alias("low"), F.max("x.h").alias("high"), F.count("x.h").alias("hashes"), F.count("*").alias("rows"), F.sum("x.n").alias("chars"), F.bit_or("page").alias("pages"))
    value = F.struct("pos", F.when((F.col("low") == F.col("high")) & (F.col("hashes") == F.col("rows")), F.col("low")).alias("h"), "chars")
    forms = each.groupBy("host", "form").agg(F.sort_array(F.collect_list(value)).alias("v"), F.bit_or("pages").alias("pages"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for form, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                items = [thaw(x) for x in json.loads(form)]
                out.append(json.dumps(fill(items, iter([("t", None if x["h"] is None else str(x["h"]), x["chars"] or 0) for x in v])), separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(3)], ["host", "form", "pages"])

    table = Latest("structures")
    forms = table.put(forms.mapInArrow(told, "host string, form string, pages long"))
    while True:
        sizes = forms.groupBy("host").count().where(F.col("count") > TOGETHER).select("host", F.ceil(F.col("count") / TOGETHER).alias("parts"))
        if sizes.isEmpty():
            return merged(forms.withColumn("part", F.lit(0).cast("long")), True).select("host", F.col("form").alias("wrapper"), "container", "template")
        part = F.pmod(F.xxhash64("form"), F.coalesce("parts", F.lit(1)))
        forms = table.put(merged(forms.join(sizes, "host", "left").withColumn("part", part), False).select("host", "form", "pages"))


#: Characters of hosts' containers and template texts up to which they are broadcast.
BROADCAST_CHARS = 20_000_000


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    A page is read by its host's wrapper: the text is that of the container that the wrapper's
    slots are in, without what all the host's pages have there, and without menus, headers,
    footers, notices, adverts, forms and comments in it. Null and empty pages have empty texts;
    addresses without a host share one wrapper. Pages are read whole, however long. Repeated
    rows get a row each, an empty table none; other columns are not read.
    """
    found = materialize(wrappers(pages, url_col, html_col).select("host", "container", "template"), "wrappers")
    chars = F.sum(F.length("host") + F.length("container") + F.length(F.array_join("template", " ")) + 24)
    if (found.agg(chars).first()[0] or 0) <= BROADCAST_CHARS:
        found = F.broadcast(found)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")).join(found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [extract(h, c or "body", frozenset(t or ())) for h, c, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select(F.col("page_id").cast("long"), "url", "html", "container", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
