"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

A page is read as a stream of block tags and texts, nested by their tags. A wrapper is such a nesting in which an item
may be optional or repeated and texts are slots. Wrappers are merged by aligning their streams: items of one signature
(tag and first class) are matched in order and merged inside, items that only one side has become optional, and
neighbours that repeat (singly or as groups of up to four) become one repeated item. Pages enter as wrappers of their
own, so inference is a merge over all pages of a host: within each task first, then over shares of a host, then per
host. No step holds more than one wrapper per host and the one it reads.

A wrapper counts, for each slot, the characters and those in links. The slots of the article (or, without such an
element, of the block with most running text) that are not menus, notices or the like give the text.

Edge cases: NULL or empty html gives an empty text. Pages without a host form one group. Pages that their host's wrapper
does not fit, and single pages, use the wrapper of the page alone. NULL ids are kept, repeated rows are separate rows,
other columns are ignored, and pages of any length are read whole.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Shares that a host's partial wrappers are dealt to before the last merge.
SHARES = 64
#: Hosts whose wrappers a task holds before it passes them on.
HELD = 2_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?/][^>]*>|([^<]+|<)", re.S)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?\s*([A-Za-z][\w-]*)", re.I)
_VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Embedded elements, left out as if they were not there. One without an end tag ends with its parent; its blocks belong to
#: the parent, and within _NARROW ones, which hold no blocks, the first block ends it.
_EMBEDDED = frozenset("svg object select iframe template noscript".split())
_NARROW = frozenset(("svg", "select"))
_BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table blockquote pre section article main header footer nav aside figure hr address".split())
_SKIPPED = frozenset("nav footer aside form button dialog menu head title input option fieldset".split())
_ASIDE = re.compile(
    r"^(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|side-?bar|menu\w*|nav\w*|breadcrumbs?|footer\w*|head|header|masthead|"
    r"comments?\w*|respons\w*|disqus\w*|cookie\w*|consent\w*|notice\w*|alert\w*|popup|modal|overlay|share\w*|social\w*|related\w*|"
    r"recommend\w*|newsletter|subscri\w*|login|signup|search\w*|toolbar|widget\w*|pagination|pager|skip\w*|copyright|legal)(?:$|[-_])", re.I)
_MAIN = re.compile(r"^(?:article|main|content|post|entry|story|body|text)(?:$|[-_])", re.I)

# A wrapper item is a list; these are its places. A signature "#" is a text slot.
SIG, OPT, REP, CHARS, LINKED, ITEMS, SOURCES = range(7)


def parse(source: str) -> list:
    """The page as nested items [signature, False, False, chars, chars in links, items or text]."""
    root = ["", False, False, 0, 0, []]
    stack, tags, links, raw, linked = [root], [""], 0, [], 0
    #: How often each tag is open; by place in the stack, the text that an embedded element interrupts.
    open_, before = Counter(), {}

    def flush() -> None:
        nonlocal raw, linked
        if raw:
            text = " ".join(html.unescape("".join(raw)).split())
            if text:
                stack[-1][ITEMS].append(["#", False, False, len(text), min(linked, len(text)), text])
            raw, linked = [], 0

    def close(at: int, ended: bool) -> None:
        """Closes the elements from place `at` on, the first of them by its own end tag if ended."""
        nonlocal raw, linked
        while len(stack) > at:
            flush()
            item, tag = stack.pop(), tags.pop()
            open_[tag] -= 1
            if tag in _EMBEDDED:
                raw, linked = before.pop(len(stack))
                if not ended or len(stack) > at:
                    flush()
                    if tag not in _NARROW:
                        stack[-1][ITEMS].extend(item[ITEMS])

    for m in _TOKEN.finditer(source):
        if (text := m[5]) is not None:
            raw.append(text)
            linked += len(text) if links else 0
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            links = max(0, links + (-1 if m[2] else 1)) if tag == "a" else links
            continue
        if tag in _EMBEDDED:
            if m[2]:
                if open_[tag]:
                    close(next(i for i in range(len(tags) - 1, 0, -1) if tags[i] == tag), True)
            elif not m[4].endswith("/"):
                before[len(stack)] = raw, linked
                raw, linked = [], 0
                stack.append([tag, False, False, 0, 0, []])
                tags.append(tag)
                open_[tag] += 1
            continue
        if tag in _BLOCKS and not m[2] and any(open_[x] for x in _NARROW) and not open_["foreignobject"]:
            close(min(tags.index(x) for x in _NARROW if open_[x]), False)
        flush()
        if tag in _VOID:
            continue
        if m[2]:
            if open_[tag]:
                close(next(i for i in range(len(tags) - 1, 0, -1) if tags[i] == tag), True)
                links = 0
            continue
        if tags[-1] in ("p", *_CLOSES.get(tag, ())):
            close(len(stack) - 1, True)
        name = _CLASS.search(m[4]) if m[4] else None
        item = [f"{tag}.{name[1].lower()}" if name else tag, False, False, 0, 0, []]
        stack[-1][ITEMS].append(item)
        if not m[4].endswith("/"):
            stack.append(item)
            tags.append(tag)
            open_[tag] += 1
    close(1, False)
    flush()
    return root


def _copy(page: list, sources: bool = False) -> list:
    """A page without its texts, its repetitions folded. With sources, each item also lists the page's items it stands for."""
    root, order = [], [page]
    for item in order:
        if item[SIG] != "#":
            order += item[ITEMS]
    done: dict[int, list] = {}
    for item in reversed(order):
        items = [] if item[SIG] == "#" else _fold([done.pop(id(x)) for x in item[ITEMS]])
        root = done[id(item)] = [*item[:ITEMS], items, *([[item]] if sources else [])]
    return root


def _fold(items: list, todo: deque | None = None) -> list:
    """Neighbouring repetitions of one to four items as one repeated item. What lies below them is merged by `todo`, later."""
    mine = deque() if todo is None else todo
    for period in (1, 2, 3, 4):
        out, i = [], 0
        while i < len(items):
            group = items[i:i + period]
            j, sigs = i + period, [x[SIG] for x in group]
            while len(group) == period and [x[SIG] for x in items[j:j + period]] == sigs:
                group = [_join(a, b, mine) for a, b in zip(group, items[j:j + period])]
                j += period
            if j > i + period:
                if period == 1:
                    group[0][REP] = True
                    out.append(group[0])
                else:
                    out.append(["(" + " ".join(sigs), False, True, 0, 0, group, *([[]] if len(group[0]) > SOURCES else [])])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    if todo is None:
        _finish(mine)
    return items


def align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Places of the two item lists, matched in order by signature as often as possible."""
    n, m = len(a), len(b)
    if [x[SIG] for x in a] == [x[SIG] for x in b]:
        return [(i, i) for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][SIG] == b[j][SIG] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][SIG] == b[j][SIG]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _join(a: list, b: list, todo: deque) -> list:
    """The wrapper of what either item matches, its own items still to be merged."""
    if len(a) > SOURCES:
        a[SOURCES].extend(b[SOURCES])
    out = [a[SIG], a[OPT] or b[OPT], a[REP] or b[REP], a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], [], *a[SOURCES:]]
    if a[SIG] != "#":
        todo.append((out, a, b))
    return out


def _finish(todo: deque) -> None:
    """Merges in the order of arrival, so that items are whole before others are made of them; nesting needs no recursion."""
    while todo:
        out, a, b = todo.popleft()
        items = []
        for i, j in align(a[ITEMS], b[ITEMS]):
            if i is None or j is None:
                one = a[ITEMS][i] if j is None else b[ITEMS][j]
                items.append([one[SIG], True, *one[REP:]])
            else:
                items.append(_join(a[ITEMS][i], b[ITEMS][j], todo))
        # In place: an item that became optional meanwhile has the same list.
        out[ITEMS].extend(_fold(items, todo))


def merge(a: list, b: list) -> list:
    """The wrapper of what either item matches."""
    todo = deque()
    out = _join(a, b, todo)
    _finish(todo)
    return out


def packed(wrapper: list) -> str:
    """A wrapper as JSON rows [depth, signature, optional, repeated, chars, chars in links] in order."""
    rows, todo = [], [(0, wrapper)]
    while todo:
        depth, item = todo.pop()
        rows.append([depth, *item[:ITEMS]])
        todo += [(depth + 1, x) for x in reversed(item[ITEMS])]
    return json.dumps(rows)


def unpacked(rows: str) -> list:
    path: list[list] = []
    for depth, *item in json.loads(rows):
        item.append([])
        if depth:
            path[depth - 1][ITEMS].append(item)
        path[depth:] = [item]
    return path[0]


def _aside(sig: str) -> bool:
    tag, _, name = sig.partition(".")
    return tag in _SKIPPED or bool(name and not sig.startswith("(") and _ASIDE.match(name))


def _rank(sig: str) -> int:
    """How plainly a signature says that it is the article."""
    tag, _, name = sig.partition(".")
    if sig.startswith("("):
        return 0
    return 3 if tag == "article" else 2 if tag == "main" or name == "main" else 1 if name and _MAIN.match(name) else 0


def _masses(wrapper: list) -> dict[int, float]:
    """By identity of the item, running text below each item: characters, those in links counting against."""
    order, out = [wrapper], {}
    for item in order:
        if item[SIG] != "#" and not _aside(item[SIG]):
            order += item[ITEMS]
    for item in reversed(order):
        if item[SIG] == "#":
            out[id(item)] = item[CHARS] - 2.0 * item[LINKED]
        else:
            out[id(item)] = 0.0 if _aside(item[SIG]) else sum(out[id(x)] for x in item[ITEMS])
    return out


def _mass(item: list) -> float:
    return _masses(item)[id(item)]


def main_block(wrapper: list) -> list:
    """The item that holds the text; menus, notices and the like below it are not part of the text."""
    mass, best, main, todo = _masses(wrapper), None, wrapper, [(wrapper, 0)]
    while todo:
        item, depth = todo.pop()
        if item[SIG] == "#" or _aside(item[SIG]):
            continue
        if (weight := mass[id(item)]) > 0 and (rank := _rank(item[SIG])) and (best is None or (rank, weight, -depth) > best):
            best, main = (rank, weight, -depth), item
        todo += [(x, depth + 1) for x in reversed(item[ITEMS])]
    if best is None:
        # The innermost block that holds most of the running text.
        whole = mass[id(wrapper)]
        while deeper := [x for x in main[ITEMS] if x[SIG] != "#" and not x[REP] and mass.get(id(x), 0.0) > 0.6 * whole]:
            main = deeper[0]
    return main


def _texts(block: list, out: list[str]) -> None:
    """Appends all texts of a page's block but those of menus, notices and the like."""
    todo = [*reversed(block[ITEMS])]
    while todo:
        item = todo.pop()
        if item[SIG] == "#":
            out.append(item[ITEMS])
        elif not _aside(item[SIG]):
            todo += reversed(item[ITEMS])


def _match(page: list, wrapper: list, main: list, out: list[str]) -> bool:
    """Appends the texts of the page's blocks that take the slot `main`; False if a text outside of them has no slot."""
    fits, todo, slots = True, [(page, wrapper)], {}
    while todo:
        item, slot = todo.pop()
        if slot is None:
            fits = fits and _mass(item) <= 0
        elif slot is main:
            _texts(item, out)
        elif item[SIG] != "#":
            if id(slot) not in slots:
                slots[id(slot)] = _Slots(slot[ITEMS])
            todo += reversed([*zip(item[ITEMS], slots[id(slot)].take(item[ITEMS]))])
    return fits


class _Slots:
    """The slots of one level in order, those of groups and of groups in groups included.

    Every slot may be left out, so a group is left and entered again anywhere: after a slot may come any later one and,
    within the outermost repetition that holds it, any at all.
    """

    def __init__(self, items: list):
        self.flat: list[list] = []
        #: For each slot, the slots that may come before it are those of lesser places than this.
        self.until: list[int] = []
        self.at: dict[str, list[int]] = {}
        for top in items:
            first, todo = len(self.flat), [top]
            while todo:
                x = todo.pop()
                if x[SIG].startswith("("):
                    todo += reversed(x[ITEMS])
                else:
                    self.at.setdefault(x[SIG], []).append(len(self.flat))
                    self.flat.append(x)
            inner = range(first, len(self.flat))
            repeats = top[REP] or top[SIG].startswith("(")
            self.until += [len(self.flat) if repeats else k for k in inner]

    def take(self, items: list) -> list[list | None]:
        """The slot of each item, None if it has none: as many items as can be have one, rather a slot all pages have."""
        sigs, flat = [x[SIG] for x in items], self.flat
        if sigs == [x[SIG] for x in flat]:
            return [*flat]
        # top[k]: the best way so far that ends in a slot before k, as (score, (way before, item, slot)).
        top: list[tuple] = [(0, None)] * (len(flat) + 1)
        for n, sig in enumerate(sigs):
            found = []
            for k in self.at.get(sig, ()):
                score, way = top[self.until[k]]
                found.append((k, score + (1 << 24) + (not flat[k][OPT]), (way, n, k)))
            for k, score, way in found:
                for later in range(k + 1, len(top)):
                    if top[later][0] >= score:
                        break
                    top[later] = score, way
        out: list[list | None] = [None] * len(items)
        way = top[-1][1]
        while way is not None:
            way, n, k = way
            out[n] = flat[k]
        return out


def extract(page: list, wrapper: list | None, main: list | None = None) -> str:
    """The main text of a parsed page; `main` is the wrapper's main block."""
    out: list[str] = []
    if wrapper is not None and _match(page, wrapper, main, out) and out:
        return " ".join(out)
    out = []
    block = main_block(_copy(page, sources=True))
    for item in block[SOURCES]:
        _texts(item, out)
    return " ".join(out)


def host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def infer(pages: DataFrame, shares: int = SHARES) -> DataFrame:
    """host, wrapper (JSON): one row per host, from all of its pages."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for b in batches:
            for name, source in zip(b["host"], b["html"]):
                if isinstance(source, str):
                    own = _copy(parse(source))
                    held[name] = merge(held[name], own) if name in held else own
                if len(held) >= HELD:
                    yield rows(held)
                    held = {}
        yield rows(held)

    def rows(held: dict[str, list]) -> pd.DataFrame:
        return pd.DataFrame({"host": list(held), "wrapper": [packed(x) for x in held.values()]}, dtype="object")

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for x in sorted(part["wrapper"]):
            whole = unpacked(x) if whole is None else merge(whole, unpacked(x))
        return pd.DataFrame({"host": part["host"].iloc[:1], "wrapper": [packed(whole)]})

    schema = "host string, wrapper string"
    partial = pages.select(host().alias("host"), "html").mapInPandas(local, schema)
    partial = partial.withColumn("share", F.pmod(F.xxhash64("wrapper"), F.lit(shares)))
    shared = partial.groupBy("host", "share").applyInPandas(joined, schema)
    return shared.groupBy("host").applyInPandas(joined, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """The result of query op6_wrappers: page_id, url, text, n_chars."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = scratch.put("known", infer(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, tuple[list, list]] = {}
        for b in batches:
            texts = []
            for source, wrapper in zip(b["html"], b["wrapper"]):
                if not isinstance(source, str):
                    texts.append("")
                    continue
                if isinstance(wrapper, str) and wrapper not in ready:
                    if len(ready) >= HELD:
                        ready.clear()
                    whole = unpacked(wrapper)
                    ready[wrapper] = whole, main_block(whole)
                texts.append(extract(parse(source), *ready.get(wrapper, (None, None))))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    both = rows.withColumn("host", host()).join(known, "host", "left").select("page_id", "url", "html", "wrapper")
    return both.mapInPandas(run, "page_id long, url string, text string, n_chars long")
