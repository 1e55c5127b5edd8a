"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one tree: elements with the same path of tags, classes and ids are one node.
A node's importance is the larger of (1 - g**k) P + g**k C and C: P is the entropy of its presentation (the kinds of its
children) over the host's pages, C that of its content, both to the base of the number of occurrences, k the number of
styles and g 0.9. P and g**k fall as a host grows and shows the same few styles again; C of content that differs from page
to page stays 1, so such a node is never unimportant. What every page of a host shows alike is near 0; a node seen once has
importance 1. Elements that are no content by their tag (nav, footer, aside, form, ...) or are hidden have a prior of 0
instead. Branches of importance under ``LEAST`` are removed from each page.

A word of its class, id or role (ad, sidebar, comments, ...) makes any element but html, body, main and article doubtful,
which is a low prior only. Doubtful elements, single paragraphs and inline ones too, are nodes of the tree: their content
entropy decides, and they stay from ``CLEARED`` on. Where a host has shown a node too seldom to tell, it is removed, unless
it and others like it hold most of the page's text (``MOSTLY``). A doubtful element that holds an article or main is no
doubtful one, unless the page has articles outside such elements (then it holds comments or the like).

Counts are pre-aggregated by node and value and only then by node, so a host of any size is spread over tasks; equal pages
of a host count once. Pages meet the list of their host's unimportant nodes in one join by host, of two plain exchanges:
Spark sends the lists to all tasks where they are under its broadcast threshold, and splits a hot host's pages where not.

Left of a page is: the text in its article elements (in main elements if there is none, else in the body), the
paragraphs, headings, list items and cells in document order. Inside article or main, the tree takes away containers
(div, section, ul, ...), never single paragraphs, and a page is not left without text by the tree. Character references
are decoded, white space (also from <br>) becomes one space, blocks are trimmed, empty ones dropped, the others joined by
a line feed.

Defined cases: null or empty html gives an empty text; null or odd url: such pages have the host '' and no tree; unclosed
and misnested tags are closed where HTML closes them; text outside any tag counts as body text; pages of any length are
read whole; repeated rows get equal texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved, slices, text_bytes

LEAST = 0.2
GAMMA = 0.9
#: Content entropy from which an element is content against a word of its class, id or role.
CLEARED = 0.9
#: Doubtful elements of unknown entropy stay where they hold so many times the text of all others.
MOSTLY = 3
#: A node has to occur so often before its importance counts.
MIN_SEEN = 3
SLICE_BYTES = 6_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>?|([^<]++)|<", re.DOTALL
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var".split()
)
#: Blocks whose single occurrences the tree never removes.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption address summary".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
NOISE_TAGS = frozenset("head nav footer aside form button select dialog menu object svg canvas audio video datalist".split())
#: Words of a class, id or role by which an element says that it may be no part of the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter"
    " subscribe subscription signup login social share sharing related recommended recommendations comment comments disqus"
    " reply replies respond widget pagination pager toolbar complementary contentinfo search alertdialog".split()
)
WORD = re.compile(r"[a-z0-9]+")

#: Elements that no word of theirs makes doubtful.
SURE_TAGS = frozenset("html body main article".split())

_noisy: dict[tuple[str, str], tuple[bool, bool, str]] = {}


def judged(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """(is it no content by its tag or as hidden, is it doubtful by a word, its style: the tag with its classes and id)."""
    if not attributes or attributes.isspace():
        return tag in NOISE_TAGS, False, tag
    key = (tag, attributes)
    if key in _noisy:
        return _noisy[key]
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
    words = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))
    noise = tag in NOISE_TAGS or bool(HIDDEN.search(attributes))
    doubtful = not noise and tag not in SURE_TAGS and bool(words & NOISE_WORDS)
    style = tag + "." + found.get("class", "") + "#" + found.get("id", "")
    if len(_noisy) > 100_000:
        _noisy.clear()
    _noisy[key] = (noise, doubtful, style)
    return _noisy[key]


class Node:
    """An open element. ``doubts``: paths of the doubtful elements that it is in, itself included; ``article`` and ``main``:
    how many of them are outside its outermost article or main, -1 outside any."""

    __slots__ = ("tag", "path", "noise", "article", "main", "start", "children", "leaf", "doubtful", "doubts", "word")

    def __init__(self, tag, path, noise, article, main, start, leaf, doubtful=False, doubts=(), word=0):
        self.tag, self.path, self.noise, self.article, self.main, self.start, self.leaf = tag, path, noise, article, main, start, leaf
        self.doubtful, self.doubts, self.word = doubtful, doubts, word
        self.children: list[str] = []


class Block(NamedTuple):
    """A block outside noise: its text, the paths of its containers without doubtful ones, doubts, article and main as in
    ``Node``; ``parts`` (raw text, doubts) where doubtful inline elements are in it."""

    text: str
    paths: tuple[int, ...]
    doubts: tuple[int, ...]
    article: int
    main: int
    parts: tuple[tuple[str, tuple[int, ...]], ...] = ()


class Page:
    """A parsed page: ``blocks`` outside noise; ``branches`` of (path, style, first block, end block, text that is no block
    of its own), one for each container and doubtful element outside noise."""

    def __init__(self, text: str):
        self.blocks: list[Block] = []
        self.branches: list[tuple[int, int, int, int, str]] = []
        self.words: list[tuple[str, tuple[int, ...]]] = []
        self.stack = [Node("", 0, False, -1, -1, 0, False)]
        at, end = 0, len(text)
        while at < end:
            m = TOKEN.match(text, at)
            at = m.end()
            if m[4] is not None:
                if not self.stack[-1].noise:
                    self.words.append((m[4], self.stack[-1].doubts))
            elif m[2] is None:
                if m[0] == "<":
                    self.words.append(("<", self.stack[-1].doubts))
            elif m[1]:
                self.close(m[2].lower())
            else:
                tag = m[2].lower()
                if tag in RAW:
                    stop = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(text, at)
                    at = stop.start() if stop else end
                elif tag in VOID:
                    if tag == "br":
                        self.words.append((" ", self.stack[-1].doubts))
                    elif tag == "hr":
                        self.open("hr", "")
                        self.close("hr")
                else:
                    self.open(tag, m[3])
        while len(self.stack) > 1:
            self.pop()
        self.flush()

    def flush(self) -> None:
        if self.words:
            top = self.stack[-1]
            if not top.noise:
                text = plain(w for w, _ in self.words)
                if text:
                    block = next(n for n in reversed(self.stack) if n.tag not in INLINE)
                    paths = tuple(n.path for n in self.stack if not n.leaf)
                    parts = tuple(self.words) if any(d != block.doubts for _, d in self.words) else ()
                    self.blocks.append(Block(text, paths, block.doubts, block.article, block.main, parts))
            self.words = []

    def open(self, tag: str, attributes: str) -> None:
        noise, doubtful, style = judged(tag, attributes)
        if tag in INLINE:
            if not noise and not doubtful:
                return
        elif tag in CLOSES_P:
            self.close_open("p", ("button", "td", "th", "table"))
            if tag[0] == "h" and tag[1:].isdigit() and self.stack[-1].tag[:1] == "h" and self.stack[-1].tag[1:].isdigit():
                self.pop()
        elif tag == "li":
            self.close_open("li", ("ul", "ol", "menu", "div", "section", "article"))
        elif tag in ("dt", "dd"):
            self.close_open("dt", ("dl",))
            self.close_open("dd", ("dl",))
        elif tag in ("td", "th", "tr"):
            for t in ("td", "th") if tag != "tr" else ("td", "th", "tr"):
                self.close_open(t, ("table", "tbody", "thead", "tfoot") if t == "tr" else ("table", "tr"))
        elif tag == "body":
            self.close_open("head", ())
            if any(n.tag == "body" for n in self.stack):
                return
        if tag not in INLINE:
            self.flush()
        up = self.stack[-1]
        if up.tag == "head" and tag not in ("base", "link", "meta"):
            self.close_open("head", ())
            up = self.stack[-1]
        leaf = tag in LEAVES or tag in INLINE or doubtful
        # The header of an article holds its title; one of a page does not.
        noise = noise or (tag == "header" and up.article < 0 and up.main < 0)
        up.children.append(style)
        # Paths of doubtful elements are odd, all others even.
        path = hash_of(up.path, style) | 1 if doubtful else up.path if leaf else hash_of(up.path, style) & ~1
        held = len(up.doubts)
        self.stack.append(
            Node(
                tag, path, up.noise or noise, held if tag == "article" and up.article < 0 else up.article,
                held if tag == "main" and up.main < 0 else up.main, len(self.blocks), leaf,
                doubtful, (*up.doubts, path) if doubtful else up.doubts, len(self.words),
            )
        )

    def close_open(self, tag: str, until: tuple[str, ...]) -> None:
        """Close the nearest open ``tag``, unless one of ``until`` is nearer."""
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k].tag
            if t == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if t in until:
                return

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k].tag
            if t == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in INLINE and t not in INLINE:
                return
        if tag not in INLINE:
            self.flush()

    def pop(self) -> None:
        top = self.stack[-1]
        if top.tag not in INLINE:
            self.flush()
        elif top.noise and not self.stack[-2].noise:
            pass  # its words were never taken
        self.stack.pop()
        if (top.doubtful or not top.leaf) and not top.noise:
            style = hash_of(0, "\n".join(dict.fromkeys(top.children)))
            within = plain(w for w, _ in self.words[top.word if len(self.blocks) == top.start else 0 :]) if self.words else ""
            self.branches.append((top.path, style, top.start, len(self.blocks), within))

    def text(self, unimportant: frozenset[int] = frozenset(), cleared: frozenset[int] = frozenset()) -> str:
        """Text of the blocks that are left when the branches in ``unimportant`` are removed, and the doubtful ones that are
        not in ``cleared``."""
        blocks = [b for b in self.blocks if b.article == 0]
        if not blocks:
            blocks = [b for b in self.blocks if b.main == 0] or self.blocks
            if not any(not b.doubts and unimportant.isdisjoint(b.paths) for b in blocks):
                blocks = [b for b in blocks if b.article >= 0] or [b for b in blocks if b.main >= 0] or blocks
        left = [b for b in blocks if unimportant.isdisjoint(b.paths)]
        text = self.undoubted(left, unimportant, cleared)
        return text if text or len(left) == len(blocks) else self.undoubted(blocks, unimportant, cleared)

    def undoubted(self, blocks: list[Block], unimportant: frozenset[int], cleared: frozenset[int]) -> str:
        """Text of blocks without doubtful elements; with those of unknown entropy where they hold most of it."""
        sure, most, size, more = [], [], 0, 0
        for b in blocks:
            held = max(b.article if b.article >= 0 else b.main, 0)  # so many hold its article or main
            if b.parts or len(b.doubts) > held:
                parts = [(w, self.worst(d[held:], unimportant, cleared)) for w, d in b.parts or ((b.text, b.doubts),)]
                join = plain if b.parts else "".join
                texts = [join(w for w, k in parts if k <= least) for least in (0, 1)]
            else:
                texts = [b.text, b.text]
            sure.append(texts[0])
            most.append(texts[1])
            size += len(texts[0])
            more += len(texts[1]) - len(texts[0])
        return "\n".join(t for t in (most if more > MOSTLY * size else sure) if t)

    @staticmethod
    def worst(doubts: tuple[int, ...], unimportant: frozenset[int], cleared: frozenset[int]) -> int:
        """0 if all of doubts are cleared, 2 if one is known as unimportant, else 1."""
        return max((0 if d in cleared else 2 if d in unimportant else 1 for d in doubts), default=0)


def plain(words: Iterable[str]) -> str:
    """Raw pieces of text as one, with character references decoded and white space made single."""
    return " ".join(entities.unescape("".join(words)).split())


def hash_of(up: int, style: str) -> int:
    """A signed 64-bit hash."""
    import xxhash

    x = xxhash.xxh64_intdigest(style, seed=up & 0xFFFFFFFFFFFFFFFF)
    return x - (1 << 64) if x >> 63 else x


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        host.alias("host"),
    )


def tree_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, style, content, page): every container and doubtful element of every page of pages (host, html)."""

    def run(batches):
        import xxhash

        for batch in slices(batches, text_bytes("html"), SLICE_BYTES):
            out: list[tuple] = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html)
                digest = hash_of(1, html)
                codes = [xxhash.xxh64_digest(b.text) for b in page.blocks]
                for path, style, a, b, within in page.branches:
                    if b > a or within:
                        out.append((host, path, style, hash_of(2, b"".join(codes[a:b]) + within.encode()), digest))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "style", "content", "page"]
            )

    return pages.where("host != ''").select("host", "html").mapInArrow(
        run, "host string, path long, style long, content long, page long"
    )


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, seen, importance, content: its entropy) of every node of the sites' trees."""

    def entropy(value: str) -> DataFrame:
        n = nodes.groupBy("host", "path", value).agg(F.count(F.lit(1)).alias("n"))
        m, s = F.sum("n"), F.sum(F.col("n") * F.log("n"))
        return n.groupBy("host", "path").agg(
            m.alias("seen"), F.count(F.lit(1)).alias("values"), F.when(m > 1, 1 - s / (m * F.log(m))).otherwise(1.0).alias("entropy")
        )

    look, content = entropy("style"), entropy("content").select("host", "path", F.col("entropy").alias("content"))
    weight = F.pow(F.lit(GAMMA), F.col("values"))
    both = (1 - weight) * F.col("entropy") + weight * F.col("content")
    return look.join(content, ["host", "path"]).select(
        "host", "path", "seen", F.greatest(both, "content").alias("importance"), "content"
    )


def main_text(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = with_host(pages)
    nodes = saved(tree_nodes(rows).distinct(), "site-nodes")
    doubtful = F.col("path").bitwiseAND(F.lit(1)) == 1
    cleared = doubtful & (F.col("content") >= CLEARED)
    low = (
        importance(nodes)
        .where((F.col("seen") >= MIN_SEEN) & (doubtful | (F.col("importance") < least)))
        .groupBy(F.col("host").alias("site"))
        .agg(  # a site's nodes, not its pages
            F.collect_set(F.when(~cleared, F.col("path"))).alias("low"), F.collect_set(F.when(cleared, F.col("path"))).alias("cleared")
        )
    )

    def run(batches):
        for batch in slices(batches, text_bytes("html"), SLICE_BYTES):
            texts = [
                Page(html).text(frozenset(low_ or ()), frozenset(cleared_ or ()))
                for html, low_, cleared_ in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    # Written first: its size is then known, and both sides of the join come from plain exchanges.
    joined = rows.join(saved(low, "site-low"), F.col("host") == F.col("site"), "left")
    return joined.select("page_id", "url", "html", "low", "cleared").mapInArrow(run, "page_id long, url string, text string")


def op3_main_text(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
