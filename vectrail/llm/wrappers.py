"""Main text of HTML pages by union-free wrappers.

Pages of one host share a template. A wrapper is a union-free regular
expression over their token streams: elements, text slots, optional parts and
repeated parts or groups of parts, but no alternatives. It is inferred from all
pages of the host: a page's elements become nested parts, equal neighbours fold
into a repeated part, and sequences of two or three parts that recur into a
repeated group; pages are aligned one after the other with the wrapper so far,
and a part that only one side has becomes optional. Pages of one shape count
once, hosts of many shapes are aligned in a tree of groups of ``FAN_IN``, and
wrappers align with each other as pages do.

Every page is then parsed by its host's wrapper, which gives each block of text
the slot it fills. Slots inside the element that holds the article (article or
main, asked of each page by itself) are main text, whatever their links and
however often they recur. For pages without such an element slots are judged
over all pages of the host that lack it too, pages of one main text counting
once: a slot that all of these (two at least) fill with one text is template,
but not a heading, not a repeated part, and not if such slots hold most of the
text; nor is a slot of links main text. On each page elements that are no
article text by their kind (menus, footers, forms, ...) or by their class, id
or role go with all that is in them; names of elements around the article's own
element don't count, and where a page has no such element and nothing would be
left, neither do names of elements that hold most of its text.

Elements may have any number of different parts. What a wrapper doesn't cover,
parts on less than one in ``PLACE_SHARE`` of a host's pages, is judged by the
page alone; no text is dropped for that. Tables of wrappers have one row a
host; the planner broadcasts them only where they are small.

Defined results: null or empty html gives an empty text; a null url is a host
of its own; unclosed comments, scripts, quotes and tags reach to the end of the
page; very long and very deep pages take time in proportion to their length; an
empty table gives an empty result; repeated rows each get their text; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, map_arrow, stage_table, table

FAN_IN = 256
PLACE_SHARE = 1000

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|title|textarea|select)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
MARK = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of the left ends an open element of the right.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
P_ENDERS = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that are no article text by their kind; a header only outside the article.
NOT_MAIN = frozenset("nav footer aside form button menu dialog head".split())
#: Parts of class, id and role names of what isn't main text.
NOT_MAIN_NAME = re.compile(
    r"(?:^|[-_])(?:ads?|adv|advert\w*|banner|menu|nav\w*|side(?:bar)?|foot(?:er)?|masthead|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|comments?|disqus|replies|respond|share|sharing|social|related|recommended|promo\w*|sponsor\w*|newsletter|subscribe|breadcrumbs?|pag(?:er|ination)|toolbar|login|signup|search|widget|copyright|contentinfo|complementary|navigation)(?:$|[-_\d])",
    re.I,
)
#: Names that speak of a page's layout, as in "with-sidebar" or "widget-page".
LAYOUT_NAME = re.compile(r"(?:^|[-_])(?:with|without|has|have|no)[-_]|[-_](?:page|layout)$", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = ("article", "main")


def speaks_against(marks: str) -> bool:
    """Whether the class, id or role of an element is one of what isn't main text."""
    return any(NOT_MAIN_NAME.search(x) and not LAYOUT_NAME.search(x) for x in marks.split())


class Node:
    """A block element of a page, or (``text`` not None) a block of text."""

    __slots__ = ("name", "marks", "parent", "kids", "text", "linked", "mass", "slot", "kind", "named")

    def __init__(self, name: str, marks: str, parent: Node | None, text: str | None = None, linked: int = 0):
        self.name, self.marks, self.parent, self.text, self.linked = name, marks, parent, text, linked
        self.kids: list[Node] = []
        self.mass, self.slot = 0, -1
        #: whether the element is no article text by its kind, and by its names
        self.kind = self.named = False

    @property
    def sign(self) -> str:
        return "#" if self.text is not None else f"{self.name}.{self.marks}" if self.marks else self.name


def marks_of(attributes: str) -> str:
    """The element's class, id and role in lower case; numbers in them don't tell places apart."""
    if "=" not in attributes:
        return ""
    marks = " ".join(" ".join(m[2] or m[3] or m[4] or "" for m in MARK.finditer(attributes)).lower().split())
    return re.sub(r"\d+", "0", marks)


def nodes_of(page: str) -> list[Node]:
    """The page's block elements that hold text, and its texts, in order; the first is the page itself."""
    root = Node("", "", None)
    out = [root]
    stack: list[tuple[str, Node]] = []  # open elements and the block element that holds what they hold
    opened: dict[str, list[int]] = {}  # places of open elements in the stack by name
    blocks: list[int] = []  # and of those that end paragraphs
    parts: list[str] = []
    linked, at = 0, 0

    def here() -> Node:
        return stack[-1][1] if stack else root

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                node = Node("#", "", here(), text, linked)
                out.append(node)
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if opened.get("a"):
                linked += len(text.strip())

    def last(names) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    def close(names: tuple[str, ...], above: int) -> None:
        """Closes the innermost open element of these names, unless it lies outside place ``above``."""
        k = last(names)
        if k > above:
            while len(stack) > k:
                name, _ = stack.pop()
                opened[name].pop()
                if blocks and blocks[-1] == len(stack):
                    blocks.pop()

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if not inline and name != "br":
            flush()
        if m[2]:
            close((name,), blocks[-1] if inline and blocks else -1)
        elif name == "br":
            parts.append(" ")
        else:
            if name in P_ENDERS:
                close(("p",), last(("table", "button")))
            if name in ENDS:
                close(ENDS[name], last(("ul", "ol", "table", "dl")))
            if name not in VOID and not m[4].endswith("/"):
                node = here()
                if not inline:
                    node = Node(name, marks_of(m[4]), node)
                    out.append(node)
                opened.setdefault(name, []).append(len(stack))
                if name in P_ENDERS:
                    blocks.append(len(stack))
                stack.append((name, node))
    add(page[at:])
    flush()
    # masses of text from below, then only what holds some
    for node in reversed(out):
        if node.text is not None:
            node.mass = len(node.text)
        if node.parent is not None and node.mass:
            node.parent.mass += node.mass
    out = [n for n in out if n.mass or n is root]
    for node in out[1:]:
        node.parent.kids.append(node)
    return out


class Part:
    """A part of a wrapper: an element, a text slot (sign ``#``) or a group (sign in parentheses)."""

    __slots__ = ("sign", "kids", "optional", "repeated", "pages", "slot", "keys")

    def __init__(self, sign: str, kids: list[Part] | None = None, pages: int = 1):
        self.sign, self.kids, self.pages = sign, kids or [], pages
        self.optional = self.repeated = False
        self.slot, self.keys = -1, None


def grouping(signs: list[str], known: frozenset[tuple[str, ...]] = frozenset()) -> list[tuple[tuple[str, ...], list[list[int]]]]:
    """Units of a sequence: (signs, for each sign its places). Neighbours of one sign are one unit, and so are two or three units that recur at once or are a ``known`` group."""
    out: list[tuple[tuple[str, ...], list[list[int]]]] = []

    def fold(k: int, into_group: bool) -> bool:
        n = k if into_group else 2 * k
        if len(out) < n + into_group or any(len(u[0]) > 1 for u in out[-n:]):
            return False
        first = out[-k - 1][0] if into_group else tuple(u[0][0] for u in out[-n:-k])
        if first != tuple(u[0][0] for u in out[-k:]):
            return False
        new = [u[1][0] for u in out[-k:]]
        del out[-k:]
        if into_group:
            for have, more in zip(out[-1][1], new, strict=True):
                have += more
        else:
            old = [u[1][0] for u in out[-k:]]
            del out[-k:]
            out.append((first, [a + b for a, b in zip(old, new, strict=True)]))
        return True

    for i, sign in enumerate(signs):
        if out and out[-1][0] == (sign,):
            out[-1][1][0].append(i)
            continue
        if len(out) > 2:  # the unit before is complete now
            _ = fold(2, True) or fold(3, True) or fold(2, False) or fold(3, False)
        out.append(((sign,), [[i]]))
    if len(out) > 2:
        _ = fold(2, True) or fold(3, True) or fold(2, False) or fold(3, False)
    if known:
        plain, out = out, []
        at = 0
        while at < len(plain):
            for k in (3, 2):
                some = plain[at : at + k]
                if len(some) == k and all(len(u[0]) == 1 for u in some) and (group := tuple(u[0][0] for u in some)) in known:
                    out.append((group, [u[1][0] for u in some]))
                    at += k
                    break
            else:
                out.append(plain[at])
                at += 1
    return out


def name_of(signs: tuple[str, ...]) -> str:
    return signs[0] if len(signs) == 1 else "(" + "\x1f".join(signs) + ")"


def groups_in(parts: list[Part]) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(p.sign[1:-1].split("\x1f")) for p in parts if p.sign[:1] == "(")


def numbered(signs: list[str]) -> list[tuple[str, int]]:
    """Each sign with how often it came before."""
    seen: dict[str, int] = {}
    out = []
    for s in signs:
        n = seen.get(s, 0)
        seen[s] = n + 1
        out.append((s, n))
    return out


def partners(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Places of equal keys in a and b, as many as rise in both (a longest increasing sequence)."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    place = {k: i for i, k in enumerate(a)}
    pairs = [(place[k], j) for j, k in enumerate(b) if k in place]
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for x, (i, _) in enumerate(pairs):
        k = bisect_left(tops, i)
        if k == len(tops):
            tops.append(i)
            at.append(x)
        else:
            tops[k], at[k] = i, x
        before[x] = at[k - 1] if k else -1
    out, x = [], at[-1] if at else -1
    while x >= 0:
        out.append(pairs[x])
        x = before[x]
    return out[::-1]


def regroup(parts: list[Part], known: frozenset[tuple[str, ...]]) -> list[Part]:
    """Neighbouring parts that are a known group become one."""
    firsts = {g[0] for g in known}
    if not any(p.sign in firsts for p in parts):
        return parts
    out: list[Part] = []
    at = 0
    while at < len(parts):
        for k in (3, 2):
            some = parts[at : at + k]
            if len(some) == k and tuple(p.sign for p in some) in known:
                group = Part(name_of(tuple(p.sign for p in some)), some, max(p.pages for p in some))
                group.optional = all(p.optional for p in some)
                out.append(group)
                at += k
                break
        else:
            out.append(parts[at])
            at += 1
    return out


def join(a: Part, b: Part, same_page: bool) -> None:
    """Aligns ``b`` into ``a``, which has the same sign: what both have is joined, what one has becomes optional."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        a.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
        a.optional |= b.optional
        a.repeated |= b.repeated
        if len(a.kids) == len(b.kids) and all(x.sign == y.sign for x, y in zip(a.kids, b.kids, strict=True)):
            todo += zip(a.kids, b.kids, strict=True)
            continue
        ours, theirs = regroup(a.kids, groups_in(b.kids)), b.kids
        theirs = regroup(theirs, groups_in(ours))
        merged: list[Part] = []

        def put(p: Part, merged: list[Part] = merged, todo: list = todo) -> None:
            if merged and merged[-1].sign == p.sign:
                merged[-1].repeated = True
                todo.append((merged[-1], p))
            else:
                merged.append(p)

        i = j = 0
        pairs = partners(numbered([p.sign for p in ours]), numbered([p.sign for p in theirs]))
        for x, y in (*pairs, (len(ours), len(theirs))):
            for p in ours[i:x]:
                p.optional = True
                put(p)
            for p in theirs[j:y]:
                p.optional = True
                put(p)
            if x < len(ours):
                todo.append((ours[x], theirs[y]))
                put(ours[x])
            i, j = x + 1, y + 1
        a.kids = merged


def page_part(nodes: list[Node], pages: int = 1) -> Part:
    """A page as nested parts with repeats folded."""
    made: dict[int, Part] = {}

    def one(parts: list[Part]) -> Part:
        for p in parts[1:]:
            join(parts[0], p, True)
        parts[0].repeated |= len(parts) > 1
        return parts[0]

    for node in reversed(nodes):
        kids = [made.pop(id(k)) for k in node.kids]
        folded = []
        for signs, places in grouping([k.sign for k in kids]):
            parts = [one([kids[i] for i in some]) for some in places]
            if len(signs) == 1:
                folded += parts
            else:
                group = Part(name_of(signs), parts, pages)
                group.repeated = True
                folded.append(group)
        made[id(node)] = Part(node.sign, folded, pages)
    return made[id(nodes[0])]


def written(root: Part) -> str:
    """A wrapper as text: depth, flags, pages and sign of its parts in order."""
    lines, stack = [], [(root, 0)]
    while stack:
        p, depth = stack.pop()
        lines.append(f"{depth}\x1d{2 * p.repeated + p.optional}\x1d{p.pages}\x1d{p.sign}")
        stack += [(k, depth + 1) for k in reversed(p.kids)]
    return "\x1e".join(lines)


def read(text: str, pages: int | None = None) -> Part:
    """The wrapper of a text; its parts' slots are their places in it."""
    path: list[Part] = []
    for slot, line in enumerate(text.split("\x1e")):
        depth, flags, n, sign = line.split("\x1d", 3)
        p = Part(sign, None, int(n) if pages is None else pages)
        p.repeated, p.optional, p.slot = int(flags) > 1, bool(int(flags) & 1), slot
        del path[int(depth) :]
        if path:
            path[-1].kids.append(p)
        path.append(p)
    return path[0]


def expression(root: Part) -> str:
    """The wrapper as a regular expression."""
    out: list[str] = []
    todo: list[Part | str] = [root]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
            continue
        group = p.sign.startswith("(")
        mark = ("+" if p.repeated else "") + ("?" if p.optional else "")
        begin, end = ("", "") if group or p.sign in ("#", "") else (f"<{p.sign}>", "</>")
        out.append(("(" if mark or group else "") + (begin or ("#" if p.sign == "#" else "")))
        todo.append(end + (f"){mark}" if mark or group else ""))
        todo += reversed(p.kids)
    return "".join(out)


def infer(pages: list[str]) -> Part:
    """The wrapper of pages, by aligning one after the other."""
    wrapper = None
    for page in pages:
        part = page_part(nodes_of(page))
        if wrapper is None:
            wrapper = part
        else:
            join(wrapper, part, False)
    return wrapper or Part("")


def parse(wrapper: Part, root: Node) -> None:
    """Parses a page by the wrapper: each text gets the slot that it fills, or -1."""
    todo = [(wrapper, root)]
    while todo:
        part, node = todo.pop()
        if part.keys is None:
            part.keys = (numbered([k.sign for k in part.kids]), groups_in(part.kids))
        ours, known = part.keys
        units = grouping([k.sign for k in node.kids], known)
        for x, y in partners(ours, numbered([name_of(signs) for signs, _ in units])):
            kid = part.kids[x]
            for p, places in zip(kid.kids if len(units[y][0]) > 1 else (kid,), units[y][1], strict=True):
                for i in places:
                    if p.sign == "#":
                        node.kids[i].slot = p.slot
                    else:
                        todo.append((p, node.kids[i]))


def main_of(nodes: list[Node]) -> tuple[list[Node], Node | None]:
    """The page's texts that are in its article by the page alone, and the element that holds it (None if the page has no such element)."""
    against: dict[int, tuple[int, int]] = {}  # (kinds, names) against what is in each element
    in_main: dict[int, bool] = {}
    found: dict[str, list[Node]] = {m: [] for m in MAIN}
    for n in nodes:
        kinds, names = against.get(id(n.parent), (0, 0))
        inner = in_main.get(id(n.parent), False)
        if n.text is None:
            n.kind = n.name in NOT_MAIN or (n.name == "header" and not inner)
            n.named = bool(n.marks) and n.name not in ("body", "html", *MAIN) and speaks_against(n.marks)
            if n.name in MAIN and not kinds and not inner:
                found[n.name].append(n)
            elif n.name == "article" and not kinds:
                found["article"].append(n)
            # an article within an article that speaks of comments is one
            if n.name in MAIN and inner and n.marks and speaks_against(n.marks):
                n.named = True
        against[id(n)] = (kinds + n.kind, names + n.named)
        in_main[id(n)] = inner or n.name in MAIN

    def best(some: list[Node]) -> Node | None:
        return min(some, key=lambda n: (against[id(n)][1], -n.mass), default=None)

    def inside_of(holder: Node | None) -> list[Node]:
        free: set[int] = set()
        node = holder
        while node is not None:
            free.add(id(node))
            node = node.parent
        return texts_of(nodes, free, holder.name if holder else None)

    article, main = best(found["article"]), best(found["main"])
    holder = article or main
    kept = inside_of(holder)
    if article and main:
        # articles under a name that speaks against them, or with less than half of the main element's text, are comments or teasers
        more = inside_of(main)
        if against[id(article)][1] > against[id(main)][1] or 2 * sum(n.mass for n in kept) < sum(n.mass for n in more):
            holder, kept = main, more
    if not kept and holder is None:
        # names of what holds most of the text speak for a layout
        most = sum(n.mass for n in nodes if n.text is not None and not against[id(n)][0])
        free = {id(n) for n in nodes if n.text is None and not against[id(n)][0] and 2 * n.mass > most}
        kept = texts_of(nodes, free, None)
    return kept, holder


def texts_of(nodes: list[Node], free: set[int], main: str | None) -> list[Node]:
    """Texts that nothing speaks against but names of ``free`` elements, inside an element ``main`` if one is asked for."""
    clean: dict[int, bool] = {}
    inside: dict[int, bool] = {}
    out = []
    for n in nodes:
        ok = clean.get(id(n.parent), True) and not n.kind and (not n.named or id(n) in free)
        within = inside.get(id(n.parent), main is None) or n.name == main
        clean[id(n)], inside[id(n)] = ok, within
        if n.text is not None and ok and within:
            out.append(n)
    return out


def main_text(page: str, wrapper: Part, judged: dict[int, bool]) -> str:
    nodes = nodes_of(page)
    parse(wrapper, nodes[0])
    kept, holder = main_of(nodes)
    if holder is None:
        kept = [n for n in kept if judged.get(n.slot, 2 * n.linked <= len(n.text))] or [n for n in kept if 2 * n.linked <= len(n.text)]
    return "\n\n".join(n.text for n in kept)


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one row for each host, from all its pages."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [written(page_part(nodes_of(page))) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(text, pa.string())], ["host", "shape"])

    def align(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "shape"], ascending=[False, True])
        first = group["level"].iloc[0] == 0
        parts = [read(s, int(n) if first else None) for s, n in zip(group["shape"], group["n"], strict=True)]
        for p in parts[1:]:
            join(parts[0], p, False)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "shape": [written(parts[0])], "n": [int(group["n"].sum())], "part": [int(group["part"].iloc[0])]})

    usable = pages.filter(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("host"), "html")
    found = map_arrow(usable, shapes, "host string, shape string").groupBy("host", F.xxhash64("shape").alias("h"), "shape").agg(F.count(F.lit(1)).alias("n"))
    found = stage_table(found.select("host", "shape", "n", F.lit(0).alias("level"), "h"), "shapes")
    most = found.groupBy("host").agg(F.count(F.lit(1)).alias("shapes")).agg(F.max("shapes")).first()[0] or 0
    level, parts = 0, max(1, -(-most // FAN_IN))
    todo = found.withColumn("part", F.pmod("h", F.lit(parts)).cast("long")).drop("h")
    while True:
        done = stage_table(todo.groupBy("host", "part").applyInPandas(align, "host string, shape string, n long, part long"), "aligned")
        if parts == 1:
            break
        level, parts = level + 1, max(1, -(-parts // FAN_IN))
        todo = done.withColumn("level", F.lit(level)).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, n in zip(batch.column("shape").to_pylist(), batch.column("n").to_pylist(), strict=True):
                root = read(text)
                todo = [root]
                while todo:
                    p = todo.pop()
                    if p.sign[:1] != "(":
                        p.kids = [k for k in p.kids if k.pages * PLACE_SHARE >= n]
                    todo += p.kids
                kept.append(written(root))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(kept, pa.string())], ["host", "wrapper"])

    return map_arrow(done.select("host", "shape", "n"), prune, "host string, wrapper string")


_wrappers: dict[str | None, Part] = {}


def wrapper_of(text: str | None) -> Part:
    if text not in _wrappers:
        if len(_wrappers) > 64:
            _wrappers.clear()
        _wrappers[text] = read(text) if text else Part("")
    return _wrappers[text]


def slot_rows(page: str, wrapper: Part) -> list[tuple[int | None, int, int, int, int, bool, bool]]:
    """Of a page without an article's element: (slot, page, text, chars, linked, repeated, heading) of slots that it fills, texts hashed, and a row without a slot for the page."""
    nodes = nodes_of(page)
    kept, holder = main_of(nodes)
    if holder is not None or not kept:
        return []
    parse(wrapper, nodes[0])
    slots: dict[int, list[Node]] = {}
    for n in kept:
        slots.setdefault(n.slot, []).append(n)
    number = lambda parts: int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    texts = {slot: number([n.text for n in found]) for slot, found in slots.items()}
    main = number([f"{slot}\t{text}" for slot, text in sorted(texts.items())])
    rows = [(slot, main, texts[slot], sum(len(n.text) for n in found), sum(n.linked for n in found), len(found) > 1, found[0].parent.name in HEADINGS) for slot, found in slots.items() if slot >= 0]
    return [*rows, (None, main, 0, 0, 0, False, False)]


def judge_slots(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, judged): over all pages of each host that have no article's element, their slots and whether these are main text, as JSON."""
    names = ["host", "slot", "page", "text", "chars", "linked", "repeated", "heading"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("wrappers", _wrappers.clear)
        for batch in batches:
            rows = [(host, *r) for host, page, w in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True) for r in slot_rows(page, wrapper_of(w))]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    usable = pages.filter(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("host"), "html").join(wrappers, "host")
    rows = map_arrow(usable.select("host", "html", "wrapper"), run, "host string, slot long, page long, text long, chars long, linked long, repeated boolean, heading boolean")
    # pages of one main text have the same rows
    once = rows.groupBy("host", "slot", "page").agg(F.min("text").alias("text"), F.max("chars").alias("chars"), F.max("linked").alias("linked"), F.max(F.col("repeated") | F.col("heading")).alias("never"))
    one_text = (F.min("text") == F.max("text")) & ~F.max("never")
    slots = stage_table(once.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("pages"), one_text.alias("one_text"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")), "slots")
    hosts = slots.filter("slot is null").select("host", F.col("pages").alias("n_pages"))
    known = slots.filter("slot is not null").join(hosts, "host").withColumn("same", F.col("one_text") & (F.col("pages") == F.col("n_pages")) & (F.col("n_pages") > 1))
    links = 2 * F.col("linked") > F.col("chars")
    sums = known.groupBy("host").agg(F.sum(F.when(F.col("same"), F.col("chars")).otherwise(0)).alias("same_chars"), F.sum(F.when(F.col("same") | links, 0).otherwise(F.col("chars"))).alias("other_chars"))
    stays = ~(F.col("same") & (F.col("same_chars") < F.col("other_chars"))) & ~links
    kept = F.struct("slot", stays.alias("main"))
    return known.join(sums, "host").groupBy("host").agg(F.to_json(F.collect_list(kept)).alias("judged"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    wrappers = stage_table(infer_wrappers(pages), "wrappers")
    wrappers = stage_table(wrappers.join(judge_slots(pages, wrappers), "host", "left"), "judged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("wrappers", _wrappers.clear)
        seen: dict[str | None, dict[int, bool]] = {}
        for batch in batches:
            texts = []
            for page, wrapper, judged in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "judged")), strict=True):
                if judged not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[judged] = {s["slot"]: s["main"] for s in json.loads(judged or "[]")}
                texts.append(main_text(page or "", wrapper_of(wrapper), seen[judged]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(wrappers, "host", "left")
    return map_arrow(rows.select("page_id", "url", "html", "wrapper", "judged"), run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
