"""Main text of web pages by site template removal.

Pass 1 parses every page and hashes the subtree of every block element (from its tag, its texts and its children's hashes, so that nesting costs nothing); Spark counts, per host, on how many pages of different bodies each hash stands
(partial counts before the shuffle). Subtrees that stand on `min_pages` such pages of their host, and on `share` of all its pages of different bodies, are
templates. Inside article and main elements a subtree also is one that stands on min_pages pages and on more than half of the host's pages, copies
counted: a host that has little but copies of one page shows no more than that. Pass 2 parses the pages
again, deletes the templates' subtrees and what the markup itself names as no part of an article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments), and joins the blocks that are left.

What stays whatever its count: elements that hold an article, a main or an h1 element, elements with more than half of the page's text, and, inside
an article or main element, single text blocks, lists, tables and figures (a common sentence or table is still the article's, however often its page was copied). A page with article elements gives their text,
else its main element's, else its body's.

The templates go to the workers as sorted 64-bit hashes of (host, subtree): by broadcast up to BROADCAST_ROWS of them (8 bytes each), beyond that by a join on
the hash. The choice changes the plan, not the result.

Cases: null or empty html gives an empty text. A null or odd url is a host of its own (""). Broken markup: unclosed elements end with their
parent, stray end tags are left out, an unclosed comment or script runs to the end, a tag without an end is text. Pages of any nesting and size are parsed in about linear time. Copies of a page count as one but for the rule above; repeated rows stay rows. An empty
table gives an empty result. Other columns travel in a struct.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.shared import bound_batches, materialise
from cartolith.llm.textkernels import slices

BROADCAST_ROWS = 4_000_000
NAME = re.compile(r"/?[a-zA-Z][^\s/<>]*")
SPECIAL = re.compile("[>\"']")
BODY = re.compile(r"<body[\s>]", re.I)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption".split()
)
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption summary address".split())
PARTS = TEXT_BLOCKS | set("ul ol dl table caption thead tbody tfoot tr figure details".split())
DROP = set("nav footer aside form script style noscript template iframe svg button select textarea input label head title object canvas audio video dialog menu map".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NAMED = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar "
    "toolbar footer cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "disqus discussion respond reply replies popup modal overlay widget widgets pagination pager copyright skip search".split()
)
# names that hold whatever stands inside; the others don't count for an element around an article, a main or an h1 element ("content with-sidebar")
STRONG = set("comment comments reply replies respond disqus discussion".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "source", "parts", "strong", "weak", "size", "holds", "digest")

    def __init__(self, tag: str, source: str, strong: bool = False, weak: bool = False):
        """source: the start tag."""
        self.tag, self.source, self.parts, self.strong, self.weak, self.size, self.holds, self.digest = tag, source, [], strong, weak, 0, False, b""

    def seal(self) -> None:
        """Hash the subtree; white space counts as one space."""
        h = hashlib.blake2b(" ".join(self.source.split()).encode("utf-8", "surrogatepass"), digest_size=12)
        for part in self.parts:
            if isinstance(part, str):
                if text := " ".join(part.split()):
                    h.update(b"<" + text.encode("utf-8", "surrogatepass"))
            else:
                h.update(b">" + part.digest)
        self.digest = h.digest()

    @property
    def drop(self) -> bool:
        return self.strong or self.weak and not self.holds


def _named(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether the attributes name the element as no part of an article: surely, or by a name that layouts use too."""
    for m in ATTRIBUTE.finditer(raw):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if tag not in ("html", "body", "article", "main") or key == "id":
                words = [w.lower() for w in WORD.findall(value)]
                if tag in ("html", "body", "main"):
                    continue
                if any(w in STRONG for w in words):
                    return True, False
                if any(w in NAMED for w in words) or words in (["header"], ["site", "header"], ["page", "header"]):
                    return False, True
            elif tag == "article" and any(w in ("comment", "comments", "reply", "sponsored", "ad", "promo", "related") for w in map(str.lower, WORD.findall(value))):
                return True, False
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, False
    return False, False


class _Scanner:
    """Markup of a page in order: (start, end, name with a slash before it in end tags, attributes); no name: nothing to read."""

    def __init__(self, page: str):
        self.page = page
        self.special = [m.start() for m in SPECIAL.finditer(page)]
        self.open: set[int] = set()  # of special, those from which no tag ends
        self.last = page.rfind(">")

    def tag_end(self, at: int) -> int:
        """Place of the ">" outside quotes that ends a tag, or -1."""
        page, special, seen = self.page, self.special, []
        i = bisect.bisect_left(special, at)
        while i < len(special) and i not in self.open:
            seen.append(i)
            c = page[special[i]]
            if c == ">":
                return special[i]
            close = page.find(c, special[i] + 1)
            if close < 0:
                break
            i = bisect.bisect_right(special, close)
        self.open.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", ""
            if start > self.last:
                return None
            name = NAME.match(page, start + 1)
            if name:
                end = self.tag_end(name.end())
                if end >= 0:
                    return start, end + 1, name[0].lower(), page[name.end() : end]
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                return start, page.find(">", start) + 1, "", ""
            at = start + 1


def parse(page: str) -> Node:
    """The element tree; parts of a node are its texts (undecoded) and elements in order."""
    root = Node("#root", "")
    stack, at, n = [root], 0, len(page)
    scanner, standing = _Scanner(page), Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.seal()
            standing[node.tag] -= 1
            stack[-1].size += node.size
            stack[-1].holds |= not node.strong and (node.holds or node.tag in ("article", "main", "h1"))

    def say(text: str) -> None:
        stack[-1].parts.append(text)
        stack[-1].size += len(text)

    while found := scanner.next(at):
        start, end, tag, attributes = found
        if start > at:
            say(page[at:start])
        at = end
        if not tag:
            continue
        if tag[0] == "/":
            if standing[tag[1:]] > 0:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag[1:]))
            continue
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = ended.end() if ended else n
            continue
        if tag in BLOCKS and standing["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if tag in CLOSES and any(standing[t] > 0 for t in CLOSES[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in CLOSES[tag]:
                    close(depth)
                    break
                if stack[depth].tag in HOLDS.get(tag, ()):
                    break
        strong, weak = _named(tag, attributes) if len(attributes) > 1 else (False, False)
        node = Node(tag, page[start:end], strong or tag in DROP, weak)
        stack[-1].parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            node.seal()
        else:
            stack.append(node)
            standing[tag] += 1
    if at < n:
        say(page[at:])
    close(1)
    return root


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _key(site: bytes, source: str) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(source.split()).encode("utf-8", "surrogatepass"), digest_size=8, key=site).digest(), "little", signed=True)


def _site(url: str | None) -> bytes:
    return hashlib.blake2b(host(url).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _node_key(site: bytes, node: Node) -> int:
    return int.from_bytes(hashlib.blake2b(node.digest, digest_size=8, key=site).digest(), "little", signed=True)


def _body(page: str, site: bytes) -> int:
    """A hash of (host, body): what copies of a page have in common."""
    m = BODY.search(page)
    return _key(site, page[m.start() :] if m else page)


def subtrees(page: str, url: str | None) -> dict[int, bool]:
    """Hashes of (host, subtree) of the page's blocks, but those that always stay; whether one stands inside an article or main element."""
    root, site, out = parse(page), _site(url), {}
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        for part in node.parts:
            if isinstance(part, Node):
                if part.tag in BLOCKS:
                    if not _stays(part, root):
                        key = _node_key(site, part)
                        out[key] = inside or out.get(key, False)
                    todo.append((part, inside))
    return out


def _stays(node: Node, root: Node) -> bool:
    return node.holds or node.tag in ("article", "main", "h1", "body", "html") or 2 * node.size > root.size


def _find(root: Node, tag: str) -> list[Node]:
    """Elements of a tag that no dropped element and no other of them holds, in order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag and node is not root:
            out.append(node)
        else:
            todo.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.drop)
    return out


def main_text(page: str | None, url: str | None, templates: np.ndarray) -> str:
    """Blocks of the main text, joined by an empty line. templates: sorted hashes."""
    if not page:
        return ""
    root, site = parse(page), _site(url)
    tops = _find(root, "article") or _find(root, "main")
    marked = bool(tops)
    blocks: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if inline:
            text = " ".join(html.unescape("".join(inline)).split())
            if text:
                blocks.append(text)
            inline.clear()

    for top in tops or [root]:
        todo: list[str | Node | None] = [None, *reversed(top.parts)]  # None: a block ends
        while todo:
            part = todo.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                inline.append(part)
            elif part.tag == "br":
                inline.append(" ")
            elif part.drop or part.tag == "header" and not (marked and part.holds):
                flush()
            elif part.tag in BLOCKS:
                flush()
                template = False
                if len(templates) and not (marked and part.tag in PARTS) and not _stays(part, root):
                    key = _node_key(site, part)
                    i = int(np.searchsorted(templates, key))
                    template = i < len(templates) and templates[i] == key
                if not template:
                    todo.append(None)
                    todo.extend(reversed(part.parts))
            else:
                todo.extend(reversed(part.parts))
    return "\n\n".join(blocks)


def _hash_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        rows: dict[tuple[int, int, int], list] = {}
        for page, url in zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True):
            if page:
                site = _site(url)
                host_id, body = int.from_bytes(site[:8], "little", signed=True), _body(page, site)
                for key, inside in subtrees(page, url).items():
                    found = rows.setdefault((host_id, key, body), [0, False])
                    found[0] += 1
                    found[1] |= inside
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        values = list(zip(*rows.values(), strict=True)) or [(), ()]
        arrays = [*(pa.array(c, pa.int64()) for c in columns), pa.array(values[0], pa.int64()), pa.array(values[1], pa.bool_())]
        yield pa.record_batch(arrays, ["host", "key", "body", "n", "inside"])


def _hash_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        hosts, bodies = [], []
        for page, url in zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True):
            if page:
                site = _site(url)
                hosts.append(int.from_bytes(site[:8], "little", signed=True))
                bodies.append(_body(page, site))
        yield pa.record_batch({"host": pa.array(hosts, pa.int64()), "body": pa.array(bodies, pa.int64())})


def _list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        keys = [sorted(subtrees(page, url)) if page else [] for page, url in zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True)]
        yield pa.record_batch({"id": part.column("id"), "keys": pa.array(keys, pa.list_(pa.int64()))})


def _extract(shipped):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(shipped.value, np.int64) if shipped is not None else None
        for part in slices(batches, "html"):
            rows = zip(part.column("html").to_pylist(), part.column("url").to_pylist(), part.column("keys").to_pylist(), strict=True)
            texts = [main_text(page, url, common if common is not None else np.array(sorted(keys or []), np.int64)) for page, url, keys in rows]
            yield pa.record_batch({"row": part.column("row"), "main_text": pa.array(texts, pa.string())})

    return extract


def templates(pages: DataFrame, min_pages: int = 5, html_col: str = "html", url_col: str = "url", share: float = 0.01) -> DataFrame:
    """(key): hashes of the (host, subtree) pairs that are templates."""
    slim = pages.select(F.col(html_col).cast("string").alias("html"), F.col(url_col).cast("string").alias("url"))
    hosts = slim.mapInArrow(_hash_bodies, "host long, body long").groupBy("host", "body").agg(F.count("*").alias("n"))
    hosts = hosts.groupBy("host").agg(F.count("*").alias("host_bodies"), F.sum("n").alias("host_pages"))
    found = slim.mapInArrow(_hash_pages, "host long, key long, body long, n long, inside boolean").groupBy("host", "key", "body").agg(F.sum("n").alias("n"), F.max("inside").alias("inside"))
    found = found.groupBy("host", "key").agg(F.count("*").alias("bodies"), F.sum("n").alias("n"), F.max("inside").alias("inside")).where(F.col("n") >= min_pages)
    common = (F.col("bodies") >= min_pages) & (F.col("bodies") >= share * F.col("host_bodies"))
    return found.join(hosts, "host").where(common | F.col("inside") & (2 * F.col("n") > F.col("host_pages"))).select("key")


def extract(pages: DataFrame, min_pages: int = 5, html_col: str = "html", url_col: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """row (struct of the input's columns) and main_text."""
    spark = pages.sparkSession
    bound_batches(spark)
    common = materialise(templates(pages, min_pages, html_col, url_col), "templates")
    whole = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"))
    whole = whole.select("row", F.col("row")[html_col].cast("string").alias("html"), F.col("row")[url_col].cast("string").alias("url"))
    kind = whole.schema["row"].dataType.simpleString()
    if common.count() <= broadcast_rows:
        keys = np.sort(np.array(common.toArrow().column("key").to_numpy(), np.int64))
        shipped = spark.sparkContext.broadcast(keys.tobytes())
        return whole.withColumn("keys", F.lit(None).cast("array<long>")).mapInArrow(_extract(shipped), f"row {kind}, main_text string")
    whole = whole.withColumn("id", F.xxhash64("html", "url"))
    listed = whole.select("id", "html", "url").mapInArrow(_list_keys, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    found = listed.join(common, "key").groupBy("id").agg(F.collect_set("key").alias("keys"))
    return whole.join(found, "id", "left").select("row", "html", "url", "keys").mapInArrow(_extract(None), f"row {kind}, main_text string")
