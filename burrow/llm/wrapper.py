"""Operator 5: main text of web pages by wrappers, inferred per host as union-free regular expressions.

A page is a tree of block elements and texts. Siblings that repeat, alone or as a stretch, are folded into repeated
groups, so that a page's form is short. The distinct forms of a host are aligned one after another: what matches is
merged, what one lacks becomes optional, repeats of either side match a group of the other, every text becomes a slot;
unions never arise. The result is the host's wrapper, and ``expression`` writes it as a regular expression. With its
slots it counts pages, texts, characters, characters in links, and characters of texts that are fixed, that is, on at
least half of the host's distinct pages and on three or more of them.

The wrapper decides what is main text. Running text speaks for an element; several links, threads of short records and
text that is fixed throughout speak against it; element names and class words are a prior that such evidence can
overrule. An element that more speaks against than for is left out. Among the others the content is the
sub-expression with most text: from the root, the reader steps into the child that carries two thirds of its parent's
text (an article or main counts eightfold) as long as there is one. A page is then read along its wrapper: texts in that
sub-expression, and the main headings before it, form the blocks. Where half of a host's text is fixed, as in near
copies of one page, or a line that many pages share stands among others, this says nothing, and the text stays.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.
Null or empty html, an empty table and pages of nothing but links give empty texts. Pages without a host are wrappers
of their own. Elements nested deeper than DEEP levels count as siblings there. Repeated rows are treated one by one,
and equal pages count once for what is fixed; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.llm.common import Scratch, frugal, frugal_group

DEEP = 256
# Element names of HTML and common class names of page parts.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
HIDDEN = {"head", "title", "button", "select", "dialog", "svg", "math", "object", "canvas", "audio", "video"} | RAW
FRAMES = {"nav", "header", "footer", "aside", "form", "menu"}
MAIN = {"article", "main"}
LEAVES = {"p", "li", "tr", "td", "th", "dt", "dd", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "copyright", "comment", "comments", "disqus", "respond", "notice", "notices", "alert", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "subscription", "pagination", "pager", "widget"}
WEAK = {"header", "reply", "replies", "feedback", "responses", "discussion", "overlay", "signup", "login", "share", "sharing", "social", "related", "recommended", "links", "toolbar", "tags"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"}}
NEST = MAIN | {"body", "div", "section", "li", "td", "th", "blockquote"}
LIMIT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "body": set()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_P = {"p"}


def marks(attributes: str) -> tuple[tuple[str, ...], bool]:
    """Words of an element's class, id and role (digits taken off), and whether the element is hidden."""
    words, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words.update(w for x in value.split() if (w := re.sub(r"\d+", "", x)))
        elif name == "role":
            words.add("@" + value)
        else:
            hidden |= name == "hidden" or value == "true"
    return tuple(sorted(words)), hidden


class Page:
    """Elements of a page (number 0 is its root) and its blocks ``(element, text, characters in links)``, with its form.

    ``form``: nested lists ``[name, words, children]``, a text being ``"#"``; ``at``: per block the place of its slot in
    the form, counted from the root onwards.
    """

    def __init__(self, page: str):
        self.keys, self.children, self.blocks = [("", ())], [[]], []
        self._parse(page)
        self._fold()

    def _parse(self, page: str) -> None:
        keys, children, blocks = self.keys, self.children, self.blocks
        stack, count = [("", 0, False)], {}
        held, linked, link, at = [], 0, 0, 0

        def flush():
            nonlocal linked
            if held:
                text = "".join(held)
                text = " ".join((entities.unescape(text) if "&" in text else text).split())
                if text:
                    children[stack[-1][1]].append(~len(blocks))
                    blocks.append((stack[-1][1], text, min(linked, len(text))))
                held.clear()
            linked = 0

        def close(names, limits=()):
            if not any(count.get(x) for x in names):
                return False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    for x in stack[k:]:
                        count[x[0]] -= 1
                    del stack[k:]
                    return True
                if stack[k][0] in limits:
                    return False
            return False

        def text(raw):
            nonlocal linked
            if not stack[-1][2]:
                held.append(raw)
                if link:
                    linked += len(raw.strip())

        while at < len(page):
            m = _TOKEN.search(page, at)
            if m is None:
                text(page[at:])
                break
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if name in INLINE:
                continue
            if name == "a":
                link = 0 if m[1] else len(stack)
                continue
            if name == "br":
                text(" ")
                continue
            if m[1]:
                flush()
                close({name}, {"article", "body"} - {name} if name in ("p", "li") else ())
            elif name in RAW or name == "title":
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name in VOID:
                if name == "hr":
                    flush()
                    close(_P, MAIN)
            else:
                flush()
                while close(CLOSES.get(name, _P), LIMIT.get(name, NEST)):
                    pass
                words, hidden = marks(m[3]) if m[3] else ((), False)
                above, number, out = stack[-1]
                out = out or hidden or name in HIDDEN
                if len(stack) < DEEP:
                    children[number].append(len(keys))
                    number = len(keys)
                    keys.append((name, words))
                    children.append([])
                count[name] = count.get(name, 0) + 1
                stack.append((name, number, out))
            if link > len(stack):
                link = 0
        flush()

    def _fold(self) -> None:
        """Forms are numbered as they are met, bottom up; number 0 is a text. Elements without text have none."""
        known, size, written = {}, [1], ['"#"']
        own, places = [None] * len(self.keys), [None] * len(self.keys)

        def number(key, inner):
            got = known.get((key, inner))
            if got is None:
                got = known[key, inner] = len(size)
                size.append(1 + sum(size[x] for x in inner))
                written.append(f"[{json.dumps(key[0])},{json.dumps(key[1])},[{','.join(written[x] for x in inner)}]]")
            return got

        for n in range(len(self.keys) - 1, -1, -1):
            kids = [(k, 0 if k < 0 else own[k]) for k in self.children[n]]
            kids = [(k, x) for k, x in kids if x is not None]
            if not kids:
                continue
            items, place = folded([x for _, x in kids]) if len(kids) > 1 else ([kids[0][1]], [(0, None)])
            inner = tuple(x if isinstance(x, int) else number(("()", ()), x) for x in items)
            own[n] = number(self.keys[n], inner)
            starts = [1]
            for x in inner:
                starts.append(starts[-1] + size[x])
            places[n] = [(k, starts[j] if i is None else starts[j] + 1 + sum(size[x] for x in items[j][:i])) for (k, _), (j, i) in zip(kids, place, strict=True)]
        self.form = written[own[0]] if own[0] is not None else '["",[],[]]'
        self.at, base = [0] * len(self.blocks), [0] * len(self.keys)
        for n, found in enumerate(places):
            for k, x in found or ():
                if k < 0:
                    self.at[~k] = base[n] + x
                else:
                    base[k] = base[n] + x


def folded(ids: list[int]) -> tuple[list, list[tuple[int, int | None]]]:
    """Items of a list of forms, and for each form its item and its place therein. Equal forms in a row become one item,
    a stretch that repeats becomes a group, the tuple of its forms."""
    runs, run_of = [], []
    for x in ids:
        if not runs or runs[-1] != x:
            runs.append(x)
        run_of.append(len(runs) - 1)
    later, after = {}, [0] * len(runs)
    for i in range(len(runs) - 1, -1, -1):
        after[i] = later.get(runs[i], 0)
        later[runs[i]] = i
    items, place, i = [], [None] * len(runs), 0
    while i < len(runs):
        w = after[i] - i
        n = 1
        while w > 1 and runs[i + n * w : i + (n + 1) * w] == runs[i : i + w]:
            n += 1
        if n > 1:
            for k in range(n * w):
                place[i + k] = (len(items), k % w)
            items.append(tuple(runs[i : i + w]))
            i += n * w
        else:
            place[i] = (len(items), None)
            items.append(runs[i])
            i += 1
    return items, [place[r] for r in run_of]


class Part:
    """An element, group ``()`` or text slot ``#`` of a wrapper, with what is counted of it."""

    __slots__ = ("tag", "words", "kids", "pages", "texts", "chars", "linked", "fixed", "out", "main", "h1")

    def __init__(self, tag, words=(), kids=(), counts=(0, 0, 0, 0, 0)):
        self.tag, self.words, self.kids = tag, frozenset(words), list(kids)
        self.pages, self.texts, self.chars, self.linked, self.fixed = counts

    def counts(self):
        return self.pages, self.texts, self.chars, self.linked, self.fixed

    def dump(self):
        return [self.tag, sorted(self.words), [k.dump() for k in self.kids], self.counts()]


def load(x) -> Part:
    return Part(x[0], x[1], [load(k) for k in x[2]], x[3])


def of_form(form: str, pages: int = 0, counted: dict | None = None) -> tuple[Part, list[Part]]:
    """A form as a wrapper of its own, and its parts by place. ``counted``: texts, chars, linked, fixed by place."""
    parts: list[Part] = []

    def build(x):
        place = len(parts)
        parts.append(None)
        texts = (counted or {}).get(place, (0, 0, 0, 0))
        part = Part("#", counts=(pages, *texts)) if x == "#" else Part(x[0], x[1], counts=(pages, 0, 0, 0, 0))
        parts[place] = part
        if x != "#":
            part.kids = [build(k) for k in x[2]]
        return part

    return build(json.loads(form)), parts


def alike(a: Part, b: Part) -> bool:
    return a.tag == b.tag and (bool(a.words & b.words) or not a.words and not b.words)


def match(a: Part, b: Part, memo: dict) -> int:
    """How many parts two parts share at best; 0 if they can't be aligned."""
    if not alike(a, b):
        return 0
    if not a.kids or not b.kids:
        return 1 + (a.words == b.words)
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + (a.words == b.words) + table(a.kids, b.kids, memo)[0][0][0]
    return memo[key]


def table(a: list[Part], b: list[Part], memo: dict):
    """Best alignments of the ends of two lists. A part of ``a`` that may repeat takes several parts of ``b`` in a row;
    the second table says what is best if ``a[i]`` has just taken the part before ``b[j]``. Containers without class
    words repeat only where a page has equal ones in a row, since a menu, a text and its comments may all be such."""
    n, m = len(a), len(b)
    best, going = [[0] * (m + 1) for _ in range(n + 1)], [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        repeats = bool(a[i].words) or a[i].tag in LEAVES or a[i].tag in ("()", "#")
        for j in range(m, -1, -1):
            going[i][j] = best[i + 1][j]
            if j < m:
                near = match(a[i], b[j], memo)
                taken = near and near + going[i][j + 1]
                going[i][j] = max(going[i][j], taken) if repeats else going[i][j]
                best[i][j] = max(best[i + 1][j], best[i][j + 1], taken)
    return best, going


def grouped(items: list[Part], other: list[Part], memo: dict) -> list[Part]:
    """``items`` with stretches put into groups that ``other`` has as repeated groups. The memo keeps them alive, since
    it goes by identity."""
    for g in other:
        names = [k.tag for k in g.kids]
        if g.tag != "()" or any(x.tag == "()" for x in items):
            continue
        out, i = [], 0
        while i < len(items):
            if [x.tag for x in items[i : i + len(names)]] == names and all(map(alike, g.kids, items[i : i + len(names)])):
                out.append(Part("()", kids=items[i : i + len(names)], counts=(max(x.pages for x in items[i : i + len(names)]), 0, 0, 0, 0)))
                memo.setdefault("groups", []).append(out[-1])
                i += len(names)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def merge(a: Part, b: Part, memo: dict, seen: dict | None = None, again: bool = False) -> None:
    """Generalises ``a`` so that it covers ``b``. ``seen``: gets the part of ``a`` by identity of each part of ``b``.
    ``again``: ``a`` has taken another part of the same pages, which count once."""
    if b.tag == "#" or a.words != b.words:
        a.words &= b.words
    if seen is not None:
        seen[id(b)] = a
    a.pages, a.texts, a.chars, a.linked, a.fixed = a.pages if again else a.pages + b.pages, a.texts + b.texts, a.chars + b.chars, a.linked + b.linked, a.fixed + b.fixed
    if not b.kids:
        return
    left, right = grouped(a.kids, b.kids, memo), grouped(b.kids, a.kids, memo)
    best, going = table(left, right, memo)
    out, pairs, i, j, on = [], [], 0, 0, False
    while i < len(left) and j < len(right):
        near = match(left[i], right[j], memo)
        now = going[i][j] if on else best[i][j]
        if near and now == near + going[i][j + 1] and not (on and now == best[i + 1][j]):
            pairs.append((left[i], right[j]))
            j, on = j + 1, True
        elif on or now == best[i + 1][j]:
            out.append(left[i])
            i, on = i + 1, False
        else:
            out.append(right[j])
            keep(right[j], seen)
            j += 1
    if i < len(left):
        out += left[i:]
    for x in right[j:]:
        out.append(x)
        keep(x, seen)
    met: set[int] = set()
    for x, y in pairs:
        merge(x, y, memo, seen, again or id(x) in met)
        met.add(id(x))
    a.kids = out


def keep(part: Part, seen: dict | None) -> None:
    if seen is not None:
        for x in walk(part):
            seen[id(x)] = x


def walk(part: Part):
    stack = [part]
    while stack:
        x = stack.pop()
        yield x
        stack += reversed(x.kids)


def expression(part: Part, pages: int | None = None) -> str:
    """A wrapper as a union-free regular expression: ``(x)?`` is optional, ``(x)+`` repeats."""
    if part.tag == "#":
        inner = "#"
    else:
        inner = "".join(expression(k, part.pages) for k in part.kids)
        inner = inner if part.tag == "()" else f"<{'.'.join([part.tag, *sorted(part.words)])}>{inner}</{part.tag}>"
    texts = max((x.texts / x.pages for x in walk(part) if x.tag == "#" and x.pages), default=0)
    inner = f"({inner})+" if part.tag in LEAVES | {"()"} and texts > 1 else inner
    return f"({inner})?" if pages is not None and part.pages < pages else inner


def prior(part: Part, inside: bool) -> float:
    """What the names of an element say before any evidence. ``inside``: it is within an article or main."""
    if part.tag in ("", "#", "()", "html", "body", "h1"):
        return 0.0
    words = {w for x in part.words if x[0] != "@" for w in _WORDS.findall(x)} | {x for x in part.words if x[0] != "@"}
    out = 3.0 if part.tag in MAIN else -1.0 if part.tag == "header" and inside else -3.0 if part.tag in FRAMES else 0.0
    if part.tag not in MAIN:
        out -= 3.0 * bool(words & STRONG) or 1.0 * bool(words & WEAK)
    return out - 3.0 * any(x[1:] in ROLES for x in part.words if x[0] == "@")


def judge(root: Part) -> None:
    """Sums counts up the wrapper and marks the parts that are not content (``out``)."""
    order = list(walk(root))
    for x in reversed(order):
        x.main, x.h1 = x.tag in MAIN, x.tag == "h1"
        for k in x.kids:
            x.texts, x.chars, x.linked, x.fixed = x.texts + k.texts, x.chars + k.chars, x.linked + k.linked, x.fixed + k.fixed
            x.main, x.h1 = x.main or k.main, x.h1 or k.h1
    copies, stack = 2 * root.fixed >= root.chars, [(root, False, False)]
    while stack:
        x, out, inside = stack.pop()
        x.out = out
        if not out and x.chars:
            pages, link, fixed = max(1, x.pages), x.linked / x.chars, x.fixed / x.chars
            template = fixed >= 0.9 and not copies and not x.h1
            running = 0.0 if template else min(1.0, x.chars / x.texts / 40) * (1 - link)
            share = x.chars / root.chars
            score = prior(x, inside) + 2 * running - 3 * template - (2 * link if x.texts / pages >= 2 else 0)
            if share >= 0.5 and (x.main or x.h1) and x.tag not in FRAMES - {"form"}:
                score += 4
            elif share < 0.5 and not inside and x.tag not in MAIN | LEAVES | {"#", "()"} and thread(x, pages):
                score -= 2.5
            x.out = score < 0
        stack += [(k, x.out, inside or x.tag in MAIN) for k in x.kids]


def thread(part: Part, pages: int) -> bool:
    """Whether all of an element but a heading is one repeated record of two or more texts."""
    kids = [k for k in part.kids if k.tag not in LEAVES | {"#"} or k.tag in ("li", "tr")]
    slots = [x for x in walk(kids[0]) if x.tag == "#"] if len(kids) == 1 else []
    return len(slots) >= 2 and all(x.texts / pages >= 1.5 for x in slots[:2])


def chosen(root: Part, here: set[int]) -> set[int]:
    """Identities of the slots that hold main text, for a page that has the parts ``here``."""
    weight: dict[int, float] = {}
    whole: dict[int, float] = {}
    for x in reversed(list(walk(root))):
        whole[id(x)] = 0.0 if x.out else max(0.5, x.chars) if x.tag == "#" else sum(whole[id(k)] for k in x.kids)
        if id(x) in here and not x.out and (x.tag == "#" or any(weight.get(id(k)) for k in x.kids)):
            weight[id(x)] = whole[id(x)] / max(1, x.pages)
    node, out = root, set()
    while True:
        kids = [k for k in node.kids if weight.get(id(k))]
        pull = [weight[id(k)] * (8 if k.main and any(weight.get(id(x)) for x in walk(k) if x.tag in MAIN) else 1) for k in kids]
        best = max(range(len(kids)), key=pull.__getitem__, default=None)
        if best is None or pull[best] < sum(pull) * 2 / 3 or kids[best].tag in LEAVES | {"#", "()"} or not any(k.kids for k in kids[best].kids):
            break
        out |= {id(x) for k in kids[:best] if k.tag == "h1" for x in walk(k) if id(x) in weight}
        node = kids[best]
    return out | {id(x) for x in walk(node) if x.tag == "#" and id(x) in weight}


class Wrapper:
    """The wrapper of a host, ready to read pages. Without one, a page is its own wrapper."""

    def __init__(self, dump: str | None):
        self.dump, self.memo = json.loads(dump) if dump else None, {}

    def slots(self, page: Page) -> frozenset[int]:
        """Places in the page's form that hold main text."""
        found = self.memo.get(page.form) if self.dump else None
        if found is None:
            if self.dump:
                root, seen = load(self.dump), {}
                own, parts = of_form(page.form)
                merge(root, own, {}, seen)
            else:
                counted: dict = {}
                for (_, text, linked), at in zip(page.blocks, page.at, strict=True):
                    n, c, k, f = counted.get(at, (0, 0, 0, 0))
                    counted[at] = (n + 1, c + len(text), k + linked, f)
                root, parts = of_form(page.form, 1, counted)
                seen = {id(x): x for x in parts}
            judge(root)
            here = {id(seen[id(x)]) for x in parts if id(x) in seen} | {id(x) for x in walk(root) if x.tag == "()"}
            good = chosen(root, here)
            found = frozenset(k for k, x in enumerate(parts) if id(seen.get(id(x))) in good)
            if len(self.memo) > 2000:
                self.memo.clear()
            self.memo[page.form] = found
        return found

    def read(self, html: str) -> str:
        page = Page(html)
        if not page.blocks:
            return ""
        good = self.slots(page)
        return "\n".join([text for (_, text, _), at in zip(page.blocks, page.at, strict=True) if at in good])


def digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_ROWS = "host string, shape long, at int, text long, page long, chars long, linked long, form string"


def _blocks(batches):
    """A row per block of a page, and one with ``at`` -1 per page; the form goes with the first page of a task that has it."""
    import pyarrow as pa
    import xxhash

    told = set()
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html)
            shape, found = digest(page.form), [digest(t) for _, t, _ in page.blocks]
            whole = xxhash.xxh64_intdigest(str(found)) - (1 << 63)
            rows.append((host, shape, -1, 0, whole, 0, 0, None if (host, shape) in told else page.form))
            if len(told) > 100_000:
                told.clear()
            told.add((host, shape))
            rows += [(host, shape, at, d, whole, len(t), linked, None) for (_, t, linked), at, d in zip(page.blocks, page.at, found, strict=True)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for i in range(0, len(rows), 10_000):
            columns = list(zip(*rows[i : i + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _ROWS.split(", ")])


def _first(group):
    """One wrapper of forms with their counts."""
    import pyarrow as pa

    rows = []
    for form, pages, counted in zip(group.column("form").to_pylist(), group.column("pages").to_pylist(), group.column("counted").to_pylist(), strict=True):
        rows.append((-pages, len(form), form, {c["at"]: (c["texts"], c["chars"], c["linked"], c["fixed"]) for c in counted or ()}))
    rows.sort(key=lambda r: r[:3])
    root = of_form(rows[0][2], -rows[0][0], rows[0][3])[0]
    for r in rows[1:]:
        merge(root, of_form(r[2], -r[0], r[3])[0], {})
    return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([json.dumps(root.dump())], pa.string())})


def _again(group):
    """One wrapper of several."""
    import pyarrow as pa

    dumps = sorted(group.column("wrapper").to_pylist(), key=lambda x: (-json.loads(x)[3][0], len(x), x))
    root = load(json.loads(dumps[0]))
    for x in dumps[1:]:
        merge(root, load(json.loads(x)), {})
    return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([json.dumps(root.dump())], pa.string())})


def wrappers(pages: DataFrame, scratch: Scratch, small: int) -> DataFrame:
    """``host, wrapper`` from ``pages(host, html)``, hosts not being null.

    Blocks leave the scan as hashes and lengths. Equal forms of a host are counted before they meet; where a host has
    many, they are merged in groups of about 100, and the merged ones again, until one is left.
    """
    rows = scratch.save(pages.where("html <> ''").mapInArrow(frugal("wrapper", _blocks), _ROWS), "blocks")
    whole = rows.where("at < 0")
    distinct = whole.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("of"))
    often = rows.where("at >= 0").select("host", "text", "page").distinct().groupBy("host", "text").agg(F.count("*").alias("n")).where("n >= 3")
    literals = scratch.save(often.join(distinct, "host").where("2 * n >= of").select("host", "text"), "literals")
    fixed = literals.withColumn("is_fixed", F.lit(1))
    texts = rows.where("at >= 0").groupBy("host", "shape", "at", "text").agg(F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    texts = texts.join(F.broadcast(fixed) if literals.count() <= small else fixed, ["host", "text"], "left")
    slots = texts.groupBy("host", "shape", "at").agg(F.sum("texts").alias("texts"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum(F.coalesce(F.col("is_fixed"), F.lit(0)) * F.col("chars")).alias("fixed"))
    counted = slots.groupBy("host", "shape").agg(F.collect_list(F.struct("at", "texts", "chars", "linked", "fixed")).alias("counted"))
    forms = scratch.save(whole.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.max("form").alias("form")).join(counted, ["host", "shape"], "left"), "forms")

    def dealt(df, by):
        many = df.groupBy("host").agg(F.ceil(F.count("*") / 100).alias("n"))
        return df.join(many, "host").withColumn("salt", F.pmod(F.xxhash64(by), F.col("n"))).groupBy("host", "salt")

    found = scratch.save(dealt(forms, "shape").applyInArrow(frugal_group("wrapper", _first), "host string, wrapper string"), "wrappers-0")
    turn = 0
    while (found.groupBy("host").count().agg(F.max("count")).first()[0] or 1) > 1:
        turn += 1
        found = scratch.save(dealt(found, "wrapper").applyInArrow(frugal_group("wrapper", _again), "host string, wrapper string"), f"wrappers-{turn}")
    scratch.keep_only(f"wrappers-{turn}")
    return found


def extract(spark: SparkSession, pages: DataFrame, *, small: int = 20_000) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html)``.

    ``small``: up to so many wrappers, of together at most 8 MB, are broadcast to the scan; beyond it they are joined.
    """
    scratch = Scratch(spark)
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    pages = pages.select("page_id", "url", "html", F.when(host != "", F.lower(host)).alias("host"))
    known = wrappers(pages.where("host is not null").select("host", "html"), scratch, small)
    n, size = known.agg(F.count("*"), F.sum(F.length("wrapper"))).first()
    joined = pages.join(F.broadcast(known) if n <= small and (size or 0) <= 8 << 20 else known, "host", "left")

    def run(batches):
        import pyarrow as pa

        memo: dict = {}
        for batch in batches:
            texts = []
            for page, host, dump in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "wrapper")), strict=True):
                if host not in memo:
                    if len(memo) > 1000:
                        memo.clear()
                    memo[host] = Wrapper(dump)
                texts.append(memo[host].read(page) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "wrapper").mapInArrow(frugal("wrapper", run), "page_id long, url string, text string, n_chars long")
