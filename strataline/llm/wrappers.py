"""Main text of web pages through wrappers inferred per host.

A page is a tree of start tags (with class, id and role) and text slots. The
children of a node are a union-free regular expression: in order, each once,
optional or repeated, or a repeated group. ``merge_lists`` aligns two such
expressions: what stands in both is merged node by node, what stands in one
only becomes optional, and runs of equal tags or of equal groups of tags are folded
to repeated ones. Merging is done page by page within tasks, then by host in
two steps, in the order of the wrappers' text, so that a host's pages never meet
in one task and reruns agree; every page takes part.

``decide`` marks a host's slots. Each slot knows the text that all pages have in it, if
that is one, different pages that have it, and how much text it holds. A slot is main text if it lies in an
``article`` (or else ``main``), in no part that is a menu, header, footer, sidebar,
notice, advert, form, comment or the like, and does not say the same on three
pages or more. Tags tell such parts; class names are a prior: a name that only hints
at one (``related-work``) counts unless the part holds dense text or the article.
On hosts without such elements the main text is in the smallest container that holds
most of the varying text outside links, or where a page has none in it, in the
slots that vary, or in all if none does. Pages with equal text outside menus and the like are copies of one page.

Extraction matches a page's tree with its host's expression, from the left, and keeps the texts whose slots are main ones.

Defined cases: a null or empty html has no text; a null url, or one without a
host, belongs to the host named ''; repeated rows are pages each; a page that is,
but for copies of it, the only one of its host or the only one with a slot has it not constant; unclosed tags end where HTML has
them end, unclosed comments and scripts at the page's end; elements nest to any depth; extra columns are
dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import sys
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm._store import Stored, small_batches

# Element sets of the HTML standard. (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript template iframe xmp noembed noframes".split()
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body caption dd dt head html legend li tbody td tfoot th thead tr summary figcaption".split())
#: A start tag ends the open elements named here, up to the nearest one of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Parts that are no main text, by tag.
ASIDE_TAGS = frozenset("aside button datalist dialog footer form head header iframe input menu nav noscript script select style svg template textarea title".split())
#: Words of class, id and role that tell such a part, in compound names too.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter pager pagination paywall popup promo promotion reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words that tell it as a whole name, and hint at it in a compound one.
HINT_WORDS = frozenset("alert banner complementary disclaimer form header login notice notices notification recommended related search teaser".split())
#: Of text-level elements, these words alone tell it.
NOTICE_WORDS = frozenset("ad ads advert advertisement cookie cookies newsletter notice paywall promo share skip sponsored subscribe".split())
TEXT_LEVEL = frozenset("a abbr b blockquote br cite code dd dt em font h1 h2 h3 h4 h5 h6 i p pre q s small span strong sub sup td th time u".split())
#: Class names that begin so speak of another part than the element.
ABOUT_OTHERS = ("with-", "without-", "has-", "no-", "not-", "is-")
#: A part is dense if its texts outside links have so many characters on average; a container is chosen if it has such a share of the text.
DENSE, SHARE = 40, 0.6
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Groups of up to so many neighbouring elements are folded when they repeat; longer periods stay optional elements.
MAX_UNIT = 6
#: Wrappers of all hosts together are broadcast up to so many bytes, else joined by shuffle.
BROADCAST_BYTES = 8 << 20
HOSTS_HELD = 2000
#: A host's partial wrappers, one of each task that saw it, meet in so many groups, then these: with 4096 tasks, 64 wrappers twice.
SALTS = 64
#: Nested elements are walked by recursion in Python alone, which takes no C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def symbol(tag: str, attrs: str) -> str:
    """A tag with its class, id and role names, in lower case with hyphens, without digits."""
    if not attrs or "=" not in attrs:
        return tag
    names = set()
    for _, a, b, c in ATTR.findall(attrs):
        for name in (a or b or c).split():
            names.add(re.sub(r"[^a-z]+", "-", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()).strip("-"))
    names.discard("")
    return tag + "." + ".".join(sorted(names)) if names else tag


def tag_of(sym: str) -> str:
    return sym.partition(".")[0]


_priors: dict[str, int] = {}


def prior(sym: str) -> int:
    """Whether an element is no main text: 2 by its tag or a name, 1 by a hint, 0 otherwise."""
    found = _priors.get(sym)
    if found is None:
        if len(_priors) > 100_000:
            _priors.clear()
        found = _priors[sym] = _prior(sym)
    return found


def _prior(sym: str) -> int:
    tag, *names = sym.split(".")
    if tag in ASIDE_TAGS:
        return 2
    if tag in ("html", "body"):
        return 0
    out = 0
    for name in names:
        if name.startswith(ABOUT_OTHERS):
            continue
        words = name.split("-")
        if tag in TEXT_LEVEL:
            out = max(out, 2 * (not NOTICE_WORDS.isdisjoint(words)))
        elif not ASIDE_WORDS.isdisjoint(words) or HINT_WORDS.issuperset(words):
            out = 2
        elif not HINT_WORDS.isdisjoint(words):
            out = max(out, 1)
    return out


def parse(page: str) -> list:
    """The page's tree: [symbol, children], texts as strings."""
    root: list = ["", []]
    stack = [root]
    tags = [""]
    places: dict[str, list[int]] = {}  # where each tag is open

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def cut(i: int) -> None:
        for t in tags[i:]:
            places[t].pop()
        del stack[i:], tags[i:]

    def close(names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        while (i := last(names)) and i > last(until):
            cut(i)

    for m in TOKEN.finditer(page):
        text = m["text"]
        at = stack[-1][1]
        if text is not None:
            if at and isinstance(at[-1], str):
                at[-1] += text
            else:
                at.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "button", "table", "body"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("html", "body") and places.get(tag):
            continue
        node: list = [symbol(tag, m["attrs"]), []]
        stack[-1][1].append(node)
        if tag in VOID or (m["attrs"] or "").endswith("/"):
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        tags.append(tag)
    return root


# A wrapper node is [symbol, least, repeated, content]: content is the list of child nodes, or of a
# text slot ('#') [digest of its text, None once texts differ; digests of up to PAGES different pages
# that have it, the smallest ones; characters; texts]. A repeated group has the symbol '(...)'.
SLOT, PAGES = "#", 3


def learn(tree: list, page: str | None = None) -> list:
    """The wrapper of one page's node."""
    if page is None:
        page = hash_text(" ".join(_body_texts(tree)))
    out = []
    for c in tree[1]:
        if not isinstance(c, str):
            out.append(learn(c, page))
        elif not c.isspace():
            out.append([SLOT, 1, 0, [hash_text(c), [page], len(c), 1]])
    return [tree[0], 1, 0, fold(out)]


def _body_texts(tree: list) -> list[str]:
    """The texts in no part that is a menu or the like."""
    out: list[str] = []
    left = [tree]
    while left:
        node = left.pop()
        if isinstance(node, str):
            out.append(node)
        elif prior(node[0]) < 2:
            left += reversed(node[1])
    return out


def hash_text(text: str) -> str:
    flat = " ".join(text.split()).encode()
    return f"{zlib.crc32(flat):x}.{len(flat)}"


def _merge_node(a: list, b: list) -> list:
    if a[0] == SLOT:
        x, y = a[3], b[3]
        pages = x[1] if x[1] == y[1] else sorted({*x[1], *y[1]})[:PAGES]
        return [SLOT, min(a[1], b[1]), a[2] | b[2], [x[0] if x[0] == y[0] else None, pages, x[2] + y[2], x[3] + y[3]]]
    return [a[0], min(a[1], b[1]), a[2] | b[2], merge_lists(a[3], b[3])]


def _optional(node: list) -> list:
    return [node[0], 0, *node[2:]]


def fold(nodes: list) -> list:
    """Runs of equal nodes, and of equal groups of nodes, become repeated ones."""
    for unit in range(1, MAX_UNIT + 1):
        if len(nodes) < 2 * unit:
            break
        out: list = []
        i = 0
        while i < len(nodes):
            names = [n[0] for n in nodes[i : i + unit]]
            j = i + unit
            if len(names) < unit or [n[0] for n in nodes[j : j + unit]] != names or (unit > 1 and SLOT in names and len(set(names)) == 1):
                out.append(nodes[i])
                i += 1
                continue
            body = nodes[i:j]
            while [n[0] for n in nodes[j : j + unit]] == names:
                body = [_merge_node(x, y) for x, y in zip(body, nodes[j : j + unit], strict=True)]
                j += unit
            if unit == 1:
                out.append([*body[0][:2], 1, *body[0][3:]])
            else:
                out.append([f"({' '.join(names)})", 1, 1, body])
            i = j
        nodes = out
    return nodes


def _grouped(nodes: list, groups: list) -> list:
    """Nodes with every occurrence of a known group's sequence as that group."""
    for g in groups:
        names = [n[0] for n in g[3]]
        out: list = []
        i = 0
        while i < len(nodes):
            if [n[0] for n in nodes[i : i + len(names)]] == names:
                out.append([g[0], 1, 0, nodes[i : i + len(names)]])
                i += len(names)
            else:
                out.append(nodes[i])
                i += 1
        nodes = fold(out) if len(out) != len(nodes) else nodes
    return nodes


def merge_lists(a: list, b: list) -> list:
    """The union-free expression of two sequences of siblings."""
    left, right = [n[0] for n in a], [n[0] for n in b]
    if left == right:
        return [_merge_node(x, y) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, [n for n in b if n[0][:1] == "("]), _grouped(b, [n for n in a if n[0][:1] == "("])
    left, right = [n[0] for n in a], [n[0] for n in b]
    out: list = []
    for kind, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_merge_node(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [_optional(n) for n in a[i:j]] + [_optional(n) for n in b[k:m]]
    return fold(out)


def pattern(node: list) -> str:
    """The wrapper as a regular expression over tags and #; #= is a slot of one text, #! a main one."""
    mark = "*" if node[2] and not node[1] else "+" if node[2] else "" if node[1] else "?"
    if node[0] == SLOT:
        body = "#!" if len(node[3]) > 4 and node[3][4] & 1 else "#" if node[3][0] is None else "#="
    else:
        parts = []
        for n in node[3]:
            parts.append(pattern(n))
        body = f"({' '.join(parts)})" if node[0][:1] == "(" else f"<{node[0]}>{' '.join(parts)}</>"
    return f"({body}){mark}" if mark and body[:1] != "(" else body + mark


#: What a slot's text is: in an article, or else main; in the chosen container; varying, or any if none varies.
MAIN, CHOSEN, REST = 1, 2, 4


def _weigh(node: list, seen: dict, link: bool = False) -> tuple:
    """Characters and texts outside links, characters in links, characters of varying texts outside links, whether an article is inside."""
    chars = n = linked = varying = 0
    article = False
    for c in node[3]:
        if c[0] == SLOT:
            _, _, size, times = c[3]
            if link:
                linked += size
            else:
                chars, n = chars + size, n + times
                varying += size * _varies(c[3], 2)
        else:
            tag = tag_of(c[0])
            got = _weigh(c, seen, link or tag == "a")
            chars, n, linked, varying = chars + got[0], n + got[1], linked + got[2], varying + got[3]
            article = article or got[4] or tag in ("article", "main")
    seen[id(node)] = out = (chars, n, linked, varying, article)
    return out


def _varies(slot: list, pages: int) -> bool:
    """Whether a slot's text differs, or stands on fewer than so many different pages."""
    return slot[0] is None or len(slot[1]) < pages


def _is_aside(node: list, seen: dict) -> bool:
    level = prior(node[0])
    if level != 1:
        return level == 2
    chars, n, linked, varying, article = seen[id(node)]
    return not (article or (varying and chars > linked and chars >= DENSE * n))


def decide(wrapper: list) -> list:
    """The wrapper with marks of its slots: each slot's content gets a fifth part."""
    seen: dict[int, tuple] = {}
    _weigh(wrapper, seen)
    zones: dict[str, list[list]] = {"article": [], "main": [], "": []}

    def visit(node: list, zone: str) -> None:
        for c in node[3]:
            if c[0] == SLOT:
                del c[3][4:]
                c[3].append(0)
                zones[""].append(c[3])
                if zone:
                    zones[zone].append(c[3])
            elif c[0][:1] == "(":
                visit(c, zone)
            elif _is_aside(c, seen):
                blank(c)
            else:
                tag, *names = c[0].split(".")
                visit(c, "article" if "article" in (tag, zone) else "main" if tag == "main" or "main" in names else zone)

    def blank(node: list) -> None:
        for c in node[3]:
            if c[0] == SLOT:
                del c[3][4:]
                c[3].append(0)
            else:
                blank(c)

    visit(wrapper, "")
    inside = zones["article"] or zones["main"]
    mark = [x for x in inside if _varies(x, PAGES)] or inside
    for x in mark:
        x[4] |= MAIN
    for x in [x for x in zones[""] if _varies(x, 2)] or zones[""]:
        x[4] |= REST
    # the smallest container of most of the varying text
    at = wrapper
    while True:
        total = sum(seen[id(c)][3] for c in _elements(at) if not _is_aside(c, seen)) + sum(c[3][2] for c in at[3] if c[0] == SLOT and _varies(c[3], 2))
        best = max(_elements(at), key=lambda c: 0 if _is_aside(c, seen) else seen[id(c)][3], default=None)
        if best is None or _is_aside(best, seen) or tag_of(best[0]) in TEXT_LEVEL or seen[id(best)][3] < max(SHARE * total, 1) or _leaf(best):
            break
        at = best

    def choose(node: list) -> None:
        for c in node[3]:
            if c[0] == SLOT:
                c[3][4] |= CHOSEN * (c[3][4] >= REST)
            elif c[0][:1] == "(" or tag_of(c[0]) in TEXT_LEVEL or seen[id(c)][2] <= seen[id(c)][0]:  # no list of links
                choose(c)

    choose(at)
    return wrapper


def _elements(node: list) -> list[list]:
    """A node's child elements, those in groups too."""
    out = []
    for c in node[3]:
        if c[0][:1] == "(":
            out += _elements(c)
        elif c[0] != SLOT:
            out.append(c)
    return out


def _leaf(node: list) -> bool:
    """Whether a node is one of several of its kind, as list items and table rows are, not a container of its own."""
    return bool(node[2]) or tag_of(node[0]) in ("li", "tr", "dl", "ul", "ol")


# Wrappers travel as flat text, node by node, since they may nest deeper than JSON can.
def dump(wrapper: list) -> str:
    out: list[str] = []

    def put(node: list) -> None:
        if node[0] == SLOT:
            text, pages, *numbers = node[3]
            out.append(f"{SLOT} {node[1]} {node[2]} {text or '-'} {','.join(pages)} {' '.join(map(str, numbers))}")
            return
        out.append(f"{'(' if node[0][:1] == '(' else node[0] or '/'} {node[1]} {node[2]} {len(node[3])}")
        for c in node[3]:
            put(c)

    put(wrapper)
    return "\n".join(out)


def load(text: str) -> list:
    lines = iter(text.split("\n"))

    def get() -> list:
        name, least, repeated, *rest = next(lines).split(" ")
        if name == SLOT:
            return [SLOT, int(least), int(repeated), [None if rest[0] == "-" else rest[0], rest[1].split(","), *map(int, rest[2:])]]
        content = []
        for _ in range(int(rest[0])):
            content.append(get())
        name = "" if name == "/" else f"({' '.join(n[0] for n in content)})" if name == "(" else name
        return [name, int(least), int(repeated), content]

    return get()


class Matcher:
    """A host's expression, ready to be matched with pages."""

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        self._flat: dict[int, tuple] = {}

    def flat(self, content: list) -> tuple[list, dict[str, list[int]]]:
        """The nodes in order, each with the bounds of its group and whether that repeats, and where each symbol stands."""
        found = self._flat.get(id(content))
        if found is None:
            nodes: list[tuple] = []
            for n in content:
                at = len(nodes)
                inner = n[3] if n[0][:1] == "(" else [n]
                flat = [x for m in inner for x in ([m] if m[0][:1] != "(" else self._leaves(m))]
                nodes += [(m, at, at + len(flat), n[2]) for m in flat]
            where: dict[str, list[int]] = {}
            for i, x in enumerate(nodes):
                where.setdefault(x[0][0], []).append(i)
            found = self._flat[id(content)] = (nodes, where)
        return found

    def _leaves(self, group: list) -> list[list]:
        out = []
        for m in group[3]:
            out += self._leaves(m) if m[0][:1] == "(" else [m]
        return out

    def next(self, content: list, at: int, sym: str) -> int:
        """The place of the next child: on in its group, again from the group's begin if it repeats, behind it, or else anywhere; -1 if there is none."""
        nodes, where = self.flat(content)
        places = where.get(sym)
        if not places:
            return -1
        if at < 0:
            return places[0]
        _, low, high, repeats = nodes[at]
        i = bisect_left(places, at + 1)
        if i < len(places) and places[i] < high:
            return places[i]
        j = bisect_left(places, low)
        if repeats and j < len(places) and places[j] <= at:
            return places[j]
        return places[i] if i < len(places) else places[0]


def _texts(tree: list, matcher: Matcher, content: list | None, zone: int, blocks: list[list]) -> None:
    """Texts with their marks, in a list per block; a new block begins with an empty list.

    Where the expression has no slot for a text, the page's own elements decide (``zone``).
    """
    at = -1
    for c in tree[1]:
        if isinstance(c, str):
            if c.isspace():
                blocks[-1].append((MAIN | CHOSEN | REST, " "))
                continue
            found = -1 if content is None else matcher.next(content, at, SLOT)
            at = found if found >= 0 else at
            blocks[-1].append((matcher.flat(content)[0][found][0][3][4] if found >= 0 else zone, c))
            continue
        tag = tag_of(c[0])
        if tag in BLOCKS and blocks[-1]:
            blocks.append([])
        if tag == "br":
            blocks[-1].append((MAIN | CHOSEN | REST, " "))
        found = -1 if content is None else matcher.next(content, at, c[0])
        at = found if found >= 0 else at
        inner = 0 if prior(c[0]) == 2 or not zone else zone | (MAIN if tag == "article" else 0)
        _texts(c, matcher, matcher.flat(content)[0][found][0][3] if found >= 0 else None, inner, blocks)
        if tag in BLOCKS and blocks[-1]:
            blocks.append([])


def extract(page: str | None, matcher: Matcher) -> str:
    """The page's main text: its blocks, one a line."""
    blocks: list[list] = [[]]
    _texts(parse(page or ""), matcher, matcher.wrapper[3], REST, blocks)
    for mark in (MAIN, CHOSEN, REST):
        lines = []
        for parts in blocks:
            text = " ".join(entities.unescape("".join(x for m, x in parts if m & mark)).split())
            if text:
                lines.append(text)
        if lines:
            return "\n".join(lines)
    return ""


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _merged(rows: Iterator[tuple[str, str, int]]) -> dict[str, list]:
    """host: [wrapper, pages], merged in the order of the wrappers' text."""
    found: dict[str, list] = {}
    for name, body, n in sorted(rows):
        w = load(body)
        found[name] = [_merge_node(found[name][0], w), found[name][1] + n] if name in found else [w, n]
    return found


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (with its slots' marks), pages and pattern of every host."""
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("pages", pa.int64())])

    def table(found: dict[str, list]) -> list[pa.Array]:
        return [pa.array(list(found), pa.string()), pa.array([dump(w) for w, _ in found.values()], pa.string()), pa.array([n for _, n in found.values()], pa.int64())]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for b in batches:
            for name, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = learn(parse(page or ""))
                found[name] = [_merge_node(found[name][0], w), found[name][1] + 1] if name in found else [w, 1]
            if len(found) > HOSTS_HELD:
                yield pa.RecordBatch.from_arrays(table(found), schema=schema)
                found = {}
        if found:
            yield pa.RecordBatch.from_arrays(table(found), schema=schema)

    def rows(batch: pa.Table) -> dict[str, list]:
        return _merged(zip(*(batch.column(c).to_pylist() for c in schema.names), strict=True))

    def some(key, batch):
        return pa.Table.from_arrays(table(rows(batch)), schema=schema)

    def final(key, batch):
        found = rows(batch)
        for w, _ in found.values():
            decide(w)
        return pa.Table.from_arrays([*table(found), pa.array([pattern(w) for w, _ in found.values()], pa.string())], names=[*schema.names, "pattern"])

    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(partial, "host string, wrapper string, pages long")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper", "pages"), F.lit(SALTS)))
    halves = salted.groupBy("host", "salt").applyInArrow(some, "host string, wrapper string, pages long")
    return halves.groupBy("host").applyInArrow(final, "host string, wrapper string, pages long, pattern string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)
    known = Stored(infer(pages).select("host", "wrapper"), "wrappers").df
    if (known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(known, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Matcher] = {}
        for b in batches:
            texts = []
            for page, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if text not in seen:
                    if len(seen) > HOSTS_HELD:
                        seen.clear()
                    seen[text] = Matcher(load(text))
                texts.append(extract(page, seen[text]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op3_html_wrappers": op3_html_wrappers}
ORACLES: dict[str, str] = {}
