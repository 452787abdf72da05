"""Main text of web pages by site template removal.

Every page is read once into a tree, and the subtrees of all its elements, menus, side
columns and footers included, are hashed. Spark counts them per host over distinct pages;
a subtree that recurs on many different pages of its host is template and is deleted.
Prose inside an article is never template: copies of one article on a host are still
articles. What is furniture on one page only is left to rules: parts that HTML itself
names so (menus, forms, scripts, comments and so on) go by tag, class, id and role.

Reading takes time in proportion to the page, however malformed it is.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.llm.common import batch_rows, saved
from dayloom.operators.lookup import looked_up

#: A template recurs on this many different pages of a host, whatever its size; on a
#: small host fewer are enough if they are this share of its different pages.
MANY_PAGES, LEAST_PAGES, LEAST_SHARE = 10, 3, 0.2

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = RAW | frozenset(
    "head nav footer aside form button select option input svg math canvas audio video object dialog menu "
    "fieldset datalist map".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th".split())
#: Elements that a new one of these kinds ends, when no container lies between.
ENDED_BY_BLOCK = frozenset(("p",))
ENDED_BY_SAME = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
CONTAINERS = BLOCKS - PROSE | {"td", "th", "li", "blockquote"}
#: Words in class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert sidebar sidenav menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer comment comments reply replies discussion disqus related recommended newsletter subscribe "
    "subscription signup share sharing social popup modal overlay toolbar search pagination pager skip login".split()
)
#: Of these, marks that still hold when an article stands inside (a comment may be one).
KEPT_MARKS = frozenset(
    "comment comments reply replies discussion disqus related recommended sidebar sidenav ad ads advert adverts "
    "advertisement promo".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())

#: Pages that a Python worker gets at a time.
BATCH = 1024
#: Templates up to which they are told to all tasks; more are joined to the pages.
TOLD = 1 << 20
#: A subtree's hash is polynomial in those of its blocks of text.
BASE, PRIME = 0x1F3D5B79A7C9E5B3, (1 << 61) - 1

#: Where a tag may end or hide its end in a value, and where its name ends.
TURN = re.compile("[\"'>]")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PIECES = re.compile(r"[^a-z]+")
#: Words that turn a mark in the same name into a statement about the page.
ABOUT = frozenset("has have no not with without is page layout price".split())
#: Elements that an end tag of an inline element does not reach over.
WALLS = frozenset("article main body td th".split())


@dataclass
class Node:
    tag: str
    parts: list = field(default_factory=list)  # strings and nodes, in order
    dropped: bool = False
    main: bool = False
    inside: bool = False  # it or an element around it is main
    wrapper: bool = False  # dropped, unless an article stands inside


def _attributes(tag: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(tag, NAME.match(tag).end()):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _marks(at: dict[str, str]) -> set[str]:
    """Words of class and id names, without names that say something about the page."""
    words: set[str] = set()
    for name in f"{at.get('class', '')} {at.get('id', '')}".lower().split():
        pieces = set(PIECES.split(name))
        if not pieces & ABOUT:
            words |= pieces
    return words


def _opened(tag: str, name: str, inside: bool, by_class: bool) -> Node:
    """A node, and whether it is furniture or main content. ``inside`` an article, a
    header belongs to the article."""
    node = Node(name, dropped=name in DROPPED or name == "header" and not inside, main=name in ("article", "main"))
    node.wrapper = name == "form"
    if len(tag) > len(name) + 3 and not node.dropped and name not in ("html", "body"):
        at = _attributes(tag)
        words = _marks(at) if by_class else set()
        node.dropped = (
            "hidden" in at or at.get("aria-hidden") == "true" or bool(words & MARKS) and not node.main
            or at.get("role", "").lower() in ROLES
            or node.main and bool(words & {"comment", "comments", "reply", "replies", "ad", "advert", "promo"})
        )
        node.main |= at.get("role", "").lower() == "main"
        node.wrapper = node.dropped and bool(words & MARKS) and not words & KEPT_MARKS
    node.inside = inside or node.main
    return node


class _Open:
    """Open elements of a page, with the places of names, walls, containers and furniture,
    so that no end tag looks through the whole stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.containers: list[int] = []
        self.furniture: list[int] = []  # dropped for good
        self.wrappers: list[int] = []  # dropped unless an article stands inside

    def push(self, node: Node) -> None:
        i = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(i)
        if node.tag in WALLS:
            self.walls.append(i)
        if node.tag in CONTAINERS:
            self.containers.append(i)
        if node.dropped:
            (self.wrappers if node.wrapper else self.furniture).append(i)

    def cut(self, i: int) -> None:
        """Closes the element at place ``i`` and all inside it."""
        for node in self.stack[i:]:
            self.at[node.tag].pop()
        del self.stack[i:]
        for places in (self.walls, self.containers, self.furniture, self.wrappers):
            while places and places[-1] >= i:
                places.pop()

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, name: str) -> None:
        i = self.last((name,))
        if i and (name in BLOCKS or not self.walls or self.walls[-1] <= i):
            self.cut(i)

    def make_room(self, name: str) -> None:
        """Ends the elements that a new one of this name ends."""
        ended = ENDED_BY_SAME.get(name, frozenset()) | (ENDED_BY_BLOCK if name in BLOCKS else frozenset())
        i = self.last(ended) if ended else 0
        if i and (not self.containers or self.containers[-1] <= i):
            self.cut(i)

    def rescue(self) -> None:
        """An article stands inside: wrappers around it are no furniture."""
        if not self.furniture:
            for i in self.wrappers:
                self.stack[i].dropped = False
            self.wrappers.clear()


class _Tags:
    """Ends of tags. A page whose quotes do not pair has them ignored from there on."""

    def __init__(self, source: str):
        self.source, self.quotes = source, True

    def end(self, start: int) -> int:
        """Position after the tag that begins at ``start``; -1 if none ends any more."""
        source, at = self.source, start
        while self.quotes:
            m = TURN.search(source, at)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.end()
            else:
                at = source.find(m[0], m.end()) + 1
                self.quotes = at > 0
        return source.find(">", start) + 1 or -1


def _lower(source: str) -> str:
    low = source.lower()
    return low if len(low) == len(source) else "".join(c.lower() if len(c.lower()) == 1 else c for c in source)


def parse(source: str, by_class: bool = True) -> Node:
    """The tree of a page; unclosed elements end where HTML ends them."""
    root = Node("#root")
    open_, tags, at, low = _Open(root), _Tags(source), 0, None
    text: list[str] = []  # pieces up to the next tag

    def flush() -> None:
        if text:
            open_.stack[-1].parts.append(html.unescape("".join(text)))
            text.clear()

    while at < len(source):
        start = source.find("<", at)
        if start < 0:
            text.append(source[at:])
            break
        text.append(source[at:start])
        after = source[start + 1 : start + 3]
        if after[:1] in ("!", "?") and after:
            if source.startswith("<!--", start):
                at = source.find("-->", start + 4) + 3
                at = len(source) if at < 3 else at
            else:
                at = source.find(">", start) + 1 or len(source)
            flush()
            continue
        m = NAME.match(source, start)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            if m:  # no tag ends any more
                text.append(source[start:])
                break
            text.append("<")
            at = start + 1
            continue
        flush()
        at, name, closing = end, m[1].lower(), after[0] == "/"
        if closing:
            open_.close(name)
            continue
        if name in RAW:
            low = low if low is not None else _lower(source)
            stop = low.find("</" + name, at)
            at = len(source) if stop < 0 else source.find(">", stop) + 1 or len(source)
            continue
        open_.make_room(name)
        tag = source[start:end]
        node = _opened(tag, name, open_.stack[-1].inside, by_class)
        if node.main and not node.dropped:
            open_.rescue()
        open_.stack[-1].parts.append(node)
        if name not in VOID and not tag.endswith("/>"):
            open_.push(node)
    flush()
    return root


def _roots(node: Node) -> list[Node]:
    """Top-level article elements, else main elements, else the whole page."""
    for kinds in (("article",), None):
        found, open_ = [], [node]
        while open_:
            x = open_.pop()
            if x.dropped:
                continue
            if x.tag in kinds if kinds else x.main:
                found.append(x)
            else:
                open_.extend(y for y in reversed(x.parts) if isinstance(y, Node))
        if found:
            return found
    return [node]


def _blocks(page: Node, roots: list[Node]) -> tuple[list[str], list[bool], list[tuple[int, int, int]]]:
    """Blocks of text in page order, whether each is main text, and ``(digest, first,
    last)`` of every element that may be template: furniture, containers anywhere, prose
    outside articles."""
    blocks: list[str] = []
    kept: list[bool] = []
    spans: list[tuple[int, int, int]] = []
    lines: list[list[str]] = [[]]  # one more inside each piece of furniture
    chosen = {id(r) for r in roots}
    # hashes of the first blocks, of all and of main ones, so that any run's hash is at hand
    sums: dict[bool, list[int]] = {False: [0], True: [0]}
    powers = [1]

    def end(main: bool) -> None:
        text = " ".join("".join(lines[-1]).split())
        lines[-1].clear()
        if text:
            blocks.append(text)
            kept.append(main)
            code = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
            powers.append(powers[-1] * BASE % PRIME)
            for s in (sums[False], sums[True])[: 1 + main]:
                s.append((s[-1] * BASE + code) % PRIME)

    def place() -> tuple[int, int]:
        return len(blocks), len(sums[True]) - 1

    def digest(tag: str, first: tuple[int, int], main: bool) -> int:
        """Of an element inside main text only its main blocks count."""
        s, a, b = sums[main], first[main], place()[main]
        return ((s[b] - s[a] * powers[b - a]) % PRIME + xxhash.xxh3_64_intdigest(tag) + b - a) % PRIME

    # an explicit stack: pages may be nested deeper than Python's
    open_: list = [(page, False, False, False)]
    started: list[tuple[int, int]] = []
    while open_:
        x, closing, main, article = open_.pop()
        if isinstance(x, str):
            lines[-1].append(x)
            continue
        block = x.tag in BLOCKS or x.dropped or id(x) in chosen
        if closing:
            if block:
                end(main)
                first = started.pop()
                if place()[main] > first[main] and not x.main and x.tag not in ("#root", "html", "body"):
                    if not (article and x.tag in PROSE):
                        spans.append((digest(x.tag, first, main), first[0], len(blocks)))
            if x.dropped:
                lines.pop()
            continue
        if x.tag == "br":
            lines[-1].append("\n")
            continue
        outer, inner = main, (main or id(x) in chosen) and not x.dropped
        if x.dropped:
            lines.append([])  # its text does not break the line around it
        elif block:
            end(outer)
        if block:
            started.append(place())
        within = (article or x.main) and not x.dropped
        open_.append((x, True, inner, article and not x.dropped))
        open_.extend((y, False, inner, within) for y in reversed(x.parts))
    end(id(page) in chosen)
    return blocks, kept, spans


def read(source: str | None) -> tuple[list[str], list[bool], list[tuple[int, int, int]]]:
    """Blocks of one page, which of them are main text, and removable spans.

    If the words of classes and ids leave no main text, the page does not mean them so:
    it is read by tags and roles alone.
    """
    if not source:
        return [], [], []
    page = parse(source)
    found = _blocks(page, _roots(page))
    if not any(found[1]):
        page = parse(source, by_class=False)
        found = _blocks(page, _roots(page))
    return found


def host(url: Column) -> Column:
    """Lower-case host of an address, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html",
    least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, many_pages: int = MANY_PAGES,
) -> DataFrame:
    """``(key, url, text, n_chars)`` of every row.

    Null or empty HTML gives an empty text. Rows without a host are one site. Rows that
    show the same count as one page for the templates and are all kept in the result; null keys and
    further columns do not matter. An empty table gives no rows.
    """
    kinds = dict(pages.dtypes)
    rows = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(source).alias("_source"),
        F.xxhash64(F.col(url), F.col(source)).alias("_row"), host(F.col(url)).alias("_host"),
    )

    def parsed(batches):
        for b in batches:
            out = [_read_row(h, s) for h, s in zip(b["_host"], b.pop("_source"))]
            yield b.assign(**{c: [x[i] for x in out] for i, c in enumerate(READ)})

    # pages are read once; counting and deleting start from what was read
    with batch_rows(pages.sparkSession, BATCH):
        read_pages = saved(rows.mapInPandas(
            parsed,
            f"_key {kinds[key]}, _url {kinds[url]}, _row long, _host string, _blocks array<string>, _main array<boolean>, "
            "_digests array<long>, _firsts array<int>, _lasts array<int>, _page long",
        ), "pages")
    page = read_pages.select("_host", "_page", F.array_distinct("_digests").alias("_digests"))
    sites = page.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("_pages"))
    seen = page.select("_host", "_page", F.explode("_digests").alias("_digest")).distinct()
    counted = seen.groupBy("_host", "_digest").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_pages)
    template = looked_up(counted, "_host", sites, "_digest").filter(
        (F.col("_n") >= many_pages) | (F.col("_n") >= least_share * F.col("_pages"))
    )
    template = saved(template.select("_host", "_digest"), "templates")

    def cleaned(batches, told: np.ndarray | None = None):
        for b in batches:
            marks = b["_template"] if told is None else _told(b["_digests"], told)
            texts = [
                " ".join(_without(*row)) for row in zip(*(b[c] for c in ("_blocks", "_main", "_digests", "_firsts", "_lasts")), marks)
            ]
            yield pd.DataFrame({
                key: b["_key"].to_numpy(), url: b["_url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts],
            })

    result = f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long"
    if template.count() <= TOLD:
        told = np.sort(template.select("_digest").toPandas()["_digest"].to_numpy(np.int64))
        return read_pages.mapInPandas(lambda batches: cleaned(batches, told), result)
    marked = (
        read_pages.select("_host", "_row", F.explode("_digests").alias("_digest")).distinct()
        .join(template, ["_host", "_digest"]).groupBy("_row").agg(F.collect_set("_digest").alias("_template"))
    )
    return read_pages.join(saved(marked, "marked"), "_row", "left").mapInPandas(cleaned, result)


def _told(digests: pd.Series, told: np.ndarray) -> list[list[int]]:
    """Of every page's digests those that are templates; ``told`` is sorted."""
    every = np.concatenate([np.empty(0, np.int64), *digests]).astype(np.int64)
    at = np.searchsorted(told, every)
    known = at < len(told)
    known[known] = told[at[known]] == every[known]
    ends = np.cumsum([len(d) for d in digests])
    return [part[hit].tolist() for part, hit in zip(np.split(every, ends[:-1]), np.split(known, ends[:-1]))]


#: What is read of a page; ``_page`` is one for pages whose main text is the same.
READ = ["_blocks", "_main", "_digests", "_firsts", "_lasts", "_page"]


def _read_row(site: str, source: str | None) -> tuple[list, list, list, list, list, int]:
    """A digest names its site too, so that equal subtrees of two hosts differ."""
    blocks, kept, spans = read(source)
    seed = xxhash.xxh3_64_intdigest(site.encode("utf-8", "replace"))
    shown = "\n".join([t for t, main in zip(blocks, kept) if main])
    page = xxhash.xxh3_64_intdigest(shown.encode("utf-8", "replace")) >> 1
    return blocks, kept, [(s[0] + seed) % PRIME for s in spans], [s[1] for s in spans], [s[2] for s in spans], page


def _without(blocks, kept, digests, firsts, lasts, template) -> list[str]:
    """Main text without the spans that are template."""
    gone, template = set(), set(template) if template is not None else ()
    for d, first, last in zip(digests, firsts, lasts):
        if d in template:
            gone.update(range(first, last))
    return [t for i, (t, main) in enumerate(zip(blocks, kept)) if main and i not in gone]
