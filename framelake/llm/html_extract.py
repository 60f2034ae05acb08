"""Main text of web pages by site style trees (Yi, Liu and Li, 2003).

The DOMs of a host's pages are merged: an element node of the tree is a place
(the tags and classes from the root, through the child sequences of its
ancestors), a style node is one child sequence seen there; children of one tag and
class in a row count as one. The importance of presentation is the entropy of a
place's child sequences over the pages, to the base of their number: what never
varies is a template. The importance of content is one minus the mean entropy of the
features that the pages have at a place, each as often as pages have it. A branch of
low importance is removed from each page. A branch is noise where it is of low
importance and so is all below it; text stands in leaves alone, so what a page loses
is what its low leaves hold.

Features are all word triples and link targets of a leaf, so that leaves that differ
in a date or number have mostly equal ones. Pages of one host with the same body count once, so
that recrawls and mirrors of a page don't make its text a template; a page that
would lose nearly all its text is such a copy too and stays as it is.

Before the tree, the contract's fixed rules: elements that never hold an article
(menus, headers, footers, forms, scripts ...) go by tag, role, class or id, and
where an article or main element holds enough of the page, the main text is inside
it. The tree then weighs every page's remaining leaves, inside an article or not.

Data flow: one parse pass writes each page's leaves (places as hashes, links, texts).
A second pass makes their features and counts them per place; its tasks send packed
counts, dealt by feature, that others add up, without texts. The places of low importance are few; they meet the
pages' places in a join whose hot keys are spread, and the pages that have one lose
it in a join by row. No host's tree is gathered anywhere.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import encoded, salt, salt_bit, salts, written

#: Pages of a place below which its importance is not judged.
LEAST_PAGES = 4
#: Features that a task counts at once, and about those of all pages that one task adds up.
COUNTED, ADDED = 2 << 20, 1 << 20
#: A page that would lose more of its text than this is a copy of others and stays whole.
MOST_REMOVED = 0.8
#: Of a page's text, what an article or main element holds at least to be its main text.
ARTICLE_SHARE = 0.25
#: Of a page's text, what an element holds at least to wrap it rather than to be a part.
WRAPS = 0.6
#: Characters for each control that a form which wraps a page holds at least.
FORM_CHARS = 40
#: Importance below which a branch is noise.
LOW = 0.4
#: Weight of a place's children against its own presentation (gamma).
GAMMA = 0.9

# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object embed svg canvas audio video map textarea title select option datalist button noembed noframes xmp dialog menu nav header footer aside form fieldset input label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "thead": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead", "tfoot"}}
SCOPE = frozenset("table ul ol dl select td th body html article section main div aside nav header footer form".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
MAIN = frozenset("article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("input select textarea button".split())
#: Names of parts that are no main text: a class or id, or a piece of one.
_NAMES = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|side-?bar\w*|nav|navi|navbar|navigation|menus?|breadcrumbs?|footer|foot|header|masthead|topbar|"
    r"cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|signup|share|sharing|social|related|recommend\w*|widget\w*|toolbar|"
    r"pagination|pager|skip-?link|login"
)
NOISE_NAME = re.compile(_NAMES)
NOISE_PIECE = re.compile(rf"(?:^|[_-])(?:{_NAMES})(?:$|[_-])")
READERS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|respond|disqus|replies)(?:$|[_-])")
#: Names of elements that hold the main text; they outweigh a piece of another name.
BODY_NAMES = frozenset("post entry article story content main hentry post-content post-body entry-content article-content article-body story-body page-content main-content".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|$)|!\[CDATA\[.*?(?:\]\]>|$)|([!?][^>]*(?:>|$))|/([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|$)|/[^>]*(?:>|$))", re.S)
_LOOSE = re.compile(r"<()()(?:/([a-zA-Z][^\s/>]*)|([a-zA-Z][^\s/>]*))([^>]*?)(/?)(?:>|$)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without user, port and a leading www."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = m[1].lower().rstrip(".") if m else ""
    return host.removeprefix("www.")


#: How sure a sign of noise is: a piece of a name or a form; a whole name; a tag, role or style.
WEAK, NAMED, NEVER = 1, 2, 3


@dataclass
class Node:
    tag: str
    name: str  # tag and classes, the node's presentation
    noise: int  # 0, WEAK, NAMED or NEVER
    main: bool  # an article or main element
    link: str = ""  # where a link or image points to
    children: list = field(default_factory=list)  # nodes and strings
    drop: bool = False
    kept: bool = False  # inside the page's article
    block: bool = False  # holds an element that is not inline


def _noise(tag: str, attrs: dict[str, str]) -> int:
    if tag in UNSEEN and tag != "form" or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return NEVER
    if attrs.get("role", "").lower() in NOISE_ROLES or HIDDEN.search(attrs.get("style", "")):
        return NEVER
    if tag in ("html", "body"):
        return 0
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    if any(NOISE_NAME.fullmatch(n) or READERS.search(n) for n in names):
        return NAMED
    if tag in MAIN or not BODY_NAMES.isdisjoint(names):
        return 0
    return WEAK if tag == "form" or any(map(NOISE_PIECE.search, names)) else 0


def _settle(root: Node) -> None:
    """Decide by rule which nodes go, and which hold the page's article.

    A name is a weaker sign than a tag, and a piece of one or a form is a weak one:
    an element with most of the page's text is no sidebar for a piece of its name, a
    form with most of it and few controls, outside an article, wraps the page, and so
    does an element of any name that holds the title and most of the text. A header inside the article
    stays. The article is the article or main element with the most text, if it holds
    enough of the page, and those beside it of the same tag and class."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    size: dict[int, int] = {}
    title: dict[int, bool] = {}
    controls: dict[int, int] = {}
    for node in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node)]
        own = sum(len(c) for c in node.children if isinstance(c, str) and not c.isspace())
        node.block = any(c.block or c.tag not in INLINE and c.tag not in VOID for c in inner)
        size[id(node)] = 0 if node.noise == NEVER else own + sum(size[id(c)] for c in inner)
        title[id(node)] = node.tag == "h1" or any(title[id(c)] for c in inner)
        controls[id(node)] = (node.tag in CONTROLS and "hidden" not in node.name) + sum(controls[id(c)] for c in inner)

    def goes(c: Node) -> bool:
        if c.noise in (0, NEVER):
            return c.noise == NEVER
        if size[id(c)] <= WRAPS * size[id(root)]:
            return True
        if c.tag == "form" and not title[id(c)]:
            return id(c) in inside or size[id(c)] < FORM_CHARS * controls[id(c)]
        return c.noise == NAMED and not title[id(c)]

    inside: set[int] = set()  # what stands in an article or main element
    for node in order:
        for c in node.children:
            if isinstance(c, Node):
                if node.main or id(node) in inside:
                    inside.add(id(c))
                c.drop = node.drop or goes(c)
    rest: dict[int, int] = {}
    for node in reversed(order):
        rest[id(node)] = 0 if node.drop else sum(len(c) if isinstance(c, str) and not c.isspace() else rest[id(c)] if isinstance(c, Node) else 0 for c in node.children)
    best, beside = None, []
    todo = [root]
    while todo:  # outermost articles only
        node = todo.pop()
        inner = [c for c in node.children if isinstance(c, Node) and not c.drop]
        for c in inner:
            if c.main and (best is None or rest[id(c)] > rest[id(best)]):
                best, beside = c, [x for x in inner if x.main and x.name == c.name]
        todo.extend(c for c in reversed(inner) if not c.main)
    if best is None or not rest[id(best)] or sum(rest[id(c)] for c in beside) < ARTICLE_SHARE * rest[id(root)]:
        return
    for c in beside:
        c.kept = True
    for node in order:
        for c in node.children:
            if isinstance(c, Node):
                c.kept = c.kept or node.kept
                head = node.kept and not node.drop and (c.tag == "header" or c.tag != "form" and c.noise in (WEAK, NAMED) and "head" in c.name)
                c.drop = node.drop or goes(c) and not head


class Open:
    """The open elements, and where in their stack each tag and those that are not
    inline stand, so that an end tag costs the same at any depth."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.solid = [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in INLINE:
            self.solid.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Close the elements from place k on."""
        while len(self.nodes) > k:
            self.places[self.nodes.pop().tag].pop()
        while self.solid[-1] >= k:
            self.solid.pop()


def parse(html: str) -> Node:
    """A tolerant DOM: implied ends of paragraphs, list items and cells, stray end
    tags ignored, an unclosed tag at the end dropped, everything open at the end
    closed. Elements nest to any depth."""
    root = Node("#root", "#root", 0, False)
    stack, at, end = Open(root), 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            stack.nodes[-1].children.append(html[at:])
            break
        if lt > at:
            stack.nodes[-1].children.append(html[at:lt])
        m = _TAG.match(html, lt)
        if m is None:  # a quote without its end
            m = _LOOSE.match(html, lt)
        if m is None:  # a bare "<" is text
            stack.nodes[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[3]:
            _close(stack, m[3].lower())
            continue
        if not m[4] or (at == end and html[-1:] != ">"):
            continue
        tag = m[4].lower()
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[5])} if m[5].strip() else {}
        _imply(stack, tag)
        top = stack.nodes[-1]
        shown = [tag, *sorted(attrs.get("class", "").split()), *(["hidden"] if tag == "input" and attrs.get("type", "").lower() == "hidden" else [])]
        node = Node(tag, " ".join(shown), _noise(tag, attrs), tag in MAIN or attrs.get("role") == "main", attrs.get("href") or attrs.get("src") or "")
        top.children.append(node)
        if tag in VOID or m[6] and tag not in INLINE | CLOSES_P | RAW:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        stack.push(node)
    _settle(root)
    return root


def _imply(stack: Open, tag: str) -> None:
    """Close what a start tag implicitly ends."""
    if tag in CLOSES_P:
        k = stack.solid[-1]
        if stack.nodes[k].tag == "p":
            stack.cut(k)
    while tag in ENDS:
        k = max((stack.places[t][-1] for t in ENDS[tag] if stack.places.get(t)), default=0)
        bar = max((stack.places[t][-1] for t in SCOPE - ENDS[tag] if stack.places.get(t)), default=0)
        if k <= bar:
            break
        stack.cut(k)


def _close(stack: Open, tag: str) -> None:
    found = stack.places.get(tag)
    if found and not (tag in FORMATTING and stack.solid[-1] > found[-1]):
        stack.cut(found[-1])


@dataclass
class Block:
    """A leaf, a run of inline content: its place, its parent's place, its text."""

    place: int
    parent: int
    drop: bool
    kept: bool
    heading: bool
    text: str
    links: list[str]


def _key(*parts: object) -> int:
    h = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


def blocks(root: Node, host: str) -> list[Block]:
    """The leaves of a page in page order, each at its place in the host's tree."""
    out: list[Block] = []
    todo: list[tuple] = [("visit", root, _key(host, "#root"))]
    run: list[str] = []
    links: list[str] = []
    state = (0, 0, False, False, False)

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            out.append(Block(*state, text, links.copy()))
        run.clear()
        links.clear()

    # Depth first without recursion; "say" adds text, "set" begins a place's next run.
    while todo:
        what, node, place = todo.pop()
        if what == "say":
            run.append(node)
            continue
        if what == "link":
            links.append(node)
            continue
        if what == "set":
            flush()
            state = node
            continue
        # Inline elements belong to the leaf around them unless they are removed.
        names = [c.name for c in node.children if isinstance(c, Node) and c.tag not in INLINE and c.tag != "br"]
        style = _key(place, *(n for k, n in enumerate(names) if not k or n != names[k - 1]))
        own = (_key(place, style, "text"), place, node.drop, node.kept, node.tag in HEADINGS)
        steps: list[tuple] = [("set", own, 0)]
        n, before = 0, None
        for c in node.children:
            if isinstance(c, str):
                steps.append(("say", c, 0))
            elif c.tag in ("br", "wbr"):
                steps.append(("say", " " if c.tag == "br" else "", 0))
            elif c.tag in INLINE and not c.block and (not c.drop or node.drop):
                text, targets = _inline(c, node.drop)
                steps.append(("say", text, 0))
                steps.extend(("link", t, 0) for t in targets)
            else:
                n += before is not None and c.name != before
                before = c.name
                steps.append(("visit", c, _key(style, n, c.name)))
                steps.append(("set", own, 0))
        todo.extend(reversed(steps))
    flush()
    return out


def _inline(node: Node, dropped: bool) -> tuple[str, list[str]]:
    """The text of an inline element and where its links point."""
    out, links, todo = [], [], [node]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append(" ")
        elif not c.drop or dropped:
            if c.link:
                links.append(c.link)
            todo.extend(reversed(c.children))
    return "".join(out), links


def features(block: Block) -> set[int]:
    """A leaf's features: the 32-bit hashes of its word triples (of all its words where
    they are fewer) and link targets."""
    return _features(block.text, block.links)


def _features(text: str, links: list[str]) -> set[int]:
    words = encoded(text).split(b" ")
    triples = {b" ".join(t) for t in zip(words, words[1:], words[2:], strict=False)} if len(words) > 2 else {b" ".join(words)}
    hashes = set(map(xxhash.xxh32_intdigest, triples))
    hashes.update(xxhash.xxh32_intdigest(encoded(t), 1) for t in links)
    return hashes


def page_blocks(html: str, url: str | None) -> list[Block]:
    """The leaves that the rules leave of a page: those of its article, if it has one."""
    found = [b for b in blocks(parse(html), host_of(url)) if not b.drop]
    inside = [b for b in found if b.kept]
    return inside or found


# --- the operator ---------------------------------------------------------------

_LEAF = "struct<place:long,parent:long,links:array<string>,text:string>"


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One row per page: its leaves, and a hash of its host and body. A heading of an
    article belongs to the text below it: it has no place in the tree."""
    leaf = pa.list_(pa.struct([("place", pa.int64()), ("parent", pa.int64()), ("links", pa.list_(pa.string())), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, leaves = [], []
            for url, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = page_blocks(page or "", url)
                bodies.append(_key(host_of(url), *(x.text for x in found)))
                leaves.append(
                    [
                        {"place": None, "parent": None, "links": [], "text": x.text}
                        if x.kept and x.heading
                        else {"place": x.place, "parent": x.parent, "links": [encoded(t).decode() for t in x.links], "text": x.text}
                        for x in found
                    ]
                )
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bodies, pa.int64()), pa.array(leaves, leaf)], names=["uid", "id", "url", "body", "leaves"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"),
    )
    return rows.mapInArrow(run, f"uid long, id {kind}, url string, body long, leaves array<{_LEAF}>")


def weighed(read: DataFrame) -> DataFrame:
    """(uid, leaves, counts): counts is 1 for the first page of a host and body, else 0."""
    again = read.groupBy("body").agg(F.min("uid").alias("first"), F.count("*").alias("n")).filter("n > 1").select("body", "first")
    again = written(again, "bodies")  # so that its size is known when the join is planned
    counts = (F.col("first").isNull() | (F.col("uid") == F.col("first"))).cast("long")
    return read.join(again, "body", "left").select("uid", "leaves", counts.alias("counts"))


def _each(pages: DataFrame, fields: Callable[[Column], Column]) -> DataFrame:
    """The distinct values of `fields` over a page's weighed leaves, a row each."""
    leaves = F.filter("leaves", lambda b: b["place"].isNotNull())
    return pages.select("uid", "counts", F.explode(F.array_distinct(F.transform(leaves, fields))).alias("x")).select("uid", "counts", "x.*")


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers as steps and counts, each byte of all of them together, so that
    the high bytes, mostly zero, compress."""
    planes = [np.ascontiguousarray(v).view(np.uint8).reshape(-1, 4).T.tobytes() for v in (np.diff(keys, prepend=np.uint32(0)), counts.astype("<u4"))]
    return b"".join(planes)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = (np.ascontiguousarray(v.reshape(4, -1).T).view("<u4").ravel() for v in np.split(np.frombuffer(data, np.uint8), 2))
    return np.cumsum(steps, dtype=np.uint32), counts


def feature_sums(pages: DataFrame, counted: int = COUNTED, added: int = ADDED) -> DataFrame:
    """(place, n, logs): the sums of c and of c log c over the features of a place, each
    of which c pages have there. All features of all pages count, a page's once a place.

    Features are dealt by their first bits, so a place's are spread over tasks, however
    many pages have it, and a task that adds up holds its share of the features."""
    chars = pages.agg(F.sum(F.aggregate("leaves", F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"])))).first()[0] or 0
    # Only the size of a share depends on this: some six characters a word.
    bits = max(6, math.ceil(math.log2(max(1, chars / 6 / added))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            place, feature = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            share = feature >> np.uint32(32 - bits)
            names, out = np.fromiter(places, np.int64, len(places)), []
            order = np.argsort(share, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
                cuts = np.flatnonzero(np.diff(place[part], prepend=-1 % (1 << 64)))
                sizes = np.diff(cuts, append=len(part))
                out.append((int(share[part[0]]), names[place[part[cuts]].astype(int)].astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), _packed(feature[part], counts[part])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["share", "places", "sizes", "counts"])

        for b in batches:
            for leaves in b.column(0).to_pylist():
                of: dict[int, set[int]] = {}
                for x in leaves:
                    if x["place"] is not None:
                        found = _features(x["text"], x["links"])
                        of[x["place"]] = of[x["place"]] | found if x["place"] in of else found
                for place, found in of.items():
                    held.append(np.fromiter(found, np.uint64, len(found)) | np.uint64(places.setdefault(place, len(places)) << 32))
                    size += len(found)
                if size >= counted:
                    yield flush()
                    places.clear()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def add(rows: pa.Table) -> pa.Table:
        names, sizes, found = (rows.column(c).to_pylist() for c in ("places", "sizes", "counts"))
        place = np.concatenate([np.repeat(np.frombuffer(n, "<i8"), np.frombuffer(k, "<i8")) for n, k in zip(names, sizes, strict=True)])
        feature, c = (np.concatenate(v) for v in zip(*map(_unpacked, found), strict=True))
        order = np.lexsort((feature, place))
        place, feature, c = place[order], feature[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (feature[1:] != feature[:-1]))))
        c, place = np.add.reduceat(c.astype(np.int64), first), place[first]
        cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        return pa.table({"place": place[cuts], "n": np.add.reduceat(c, cuts), "logs": np.add.reduceat(c * np.log(c), cuts)})

    parts = pages.select("leaves").mapInArrow(count, "share int, places binary, sizes binary, counts binary")
    sums = parts.groupBy("share").applyInArrow(add, "place long, n long, logs double")
    return sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum("logs").alias("logs"))


def importance(pages: DataFrame, gamma: float = GAMMA, least: int = LEAST_PAGES) -> DataFrame:
    """(place, spread, importance) of the places that at least `least` pages have.

    presentation = - sum p log_m p over the child sequences that hold text of the
    place's parent, for the m pages that have the parent; 1 for fewer than `least`.
    content = 1 - the mean of log_m(c) over the features of the place, each weighed
    by the c of its m pages that have it. The branch is as important as
    (1 - gamma) * presentation + gamma * content. `spread` has a bit for each salt of
    the pages, counted or not, that have the place.
    """
    named = lambda b, *names: F.struct(*[b[n].alias(n) for n in names])
    seen = _each(pages, lambda b: named(b, "place", "parent")).groupBy("place", "parent").agg(F.sum("counts").alias("m"), salt_bit("uid").alias("spread"))
    shown = seen.groupBy("parent").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.log("m")).alias("s"))
    # - sum (c/m) log_m (c/m) = (log m - s/m) / log m
    entropy = (F.log("all") - F.col("s") / F.col("all")) / F.log("all")
    shown = shown.select("parent", F.when(F.col("all") < least, 1.0).otherwise(entropy).alias("presentation"))
    had = feature_sums(pages.filter("counts = 1"))
    both = seen.filter(F.col("m") >= least).join(had, "place").join(shown, "parent")
    content = 1 - F.col("logs") / F.col("n") / F.log("m")
    return both.select("place", "spread", ((1 - gamma) * F.col("presentation") + gamma * content).alias("importance"))


def low_places(read: DataFrame, low: float = LOW, gamma: float = GAMMA, least: int = LEAST_PAGES) -> DataFrame:
    """(uid, noise): a page's places of low importance."""
    pages = weighed(read)
    # Written, so that its size is known: a small table leaves the pages where they
    # are. The place of a third of all pages is one key, repeated by their salts.
    noise = written(importance(pages, gamma, least).filter(F.col("importance") < low), "low")
    noise = noise.select("place", F.explode(salts("spread")).alias("salt"))
    asked = _each(pages, lambda b: F.struct(b["place"].alias("place"))).select("uid", "place", salt("uid").alias("salt"))
    return asked.join(noise, ["place", "salt"]).groupBy("uid").agg(F.collect_list("place").alias("noise"))


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", low: float = LOW, gamma: float = GAMMA, least: int = LEAST_PAGES
) -> DataFrame:
    """The main text of every page.

    Returns one row per input row: id, url, text (white space inside a block is
    one space, blocks are joined by one space; empty if none) and n_removed, the
    blocks that the site's style tree took out. A null or empty page is empty; a
    null URL is the host "". A page cut short keeps what it holds. Repeated rows
    are pages of their own, but count once in their host's tree. An empty table
    gives an empty result. Other columns are not read.
    """
    read = written(parsed(pages, id_col, url_col, html_col), "pages")
    noise = written(low_places(read, low, gamma, least), "noise")
    out = read.join(noise, "uid", "left")
    is_low = lambda b: F.coalesce(F.array_contains(F.col("noise"), b["place"]), F.lit(False))
    chars = lambda leaves: F.aggregate(leaves, F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))
    copy = chars(F.filter("leaves", is_low)) > MOST_REMOVED * chars(F.col("leaves"))
    stays = F.filter("leaves", lambda b: ~is_low(b))
    stays = F.when(F.col("noise").isNull() | copy, F.col("leaves")).otherwise(stays)
    out = out.select("id", "url", stays.alias("stays"), F.size("leaves").alias("n"))
    return out.select("id", "url", F.array_join("stays.text", " ").alias("text"), (F.col("n") - F.size("stays")).cast("long").alias("n_removed"))
