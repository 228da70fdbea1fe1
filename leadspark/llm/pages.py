"""Main text of web pages by host paths agreed on by the pages of a host.

Each page's containers are scored by the text they hold outside of links and boilerplate; a page votes for the
generalised tag-class path of its best one, numbers taken out of class names, with its score as the weight. Spark
adds up the votes per host and path. Each page is then extracted by that one of its own paths which wins the largest
share of its host's pages that have it, counting one lost page more, so that neither a path that every page has, as the
body's, nor one that a single page has beats an agreed one; a host has any number of paths. A page is parsed once: its blocks and the ranges of them
that its containers span are written, so choosing a path is a join on paths and cutting the text a slice.

A word in a class, id or role only makes an element suspect: its text counts less, and it is left out of containers
around it, but not when it holds the page's best container or nearly all of its text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm.arrow import small
from leadspark.session import stage

SUSPECT, COMMENT = 0.1, 0.001  # what text in suspect elements counts, and in readers' comments and the like
NEARLY_ALL = 0.8  # of the best container's text: a suspect element that holds this much is a wrapper

# Elements by their role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NO_TEXT = {"head", "script", "style", "noscript", "template", "textarea", "title", "select", "option", "button", "iframe", "svg", "canvas", "object", "audio", "video", "map", "dialog", "datalist", "xmp", "noembed", "noframes"}
BOILERPLATE = {"nav", "footer", "aside", "menu", "header", "search"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "blockquote", "center", "fieldset"}
# a new one of these ends an open one of the second set, up to the nearest third
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set()),
}
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "summary", "legend", "figcaption"}
# Words of class, id and role that mark what is no main text, as a whole name or its first or last word.
MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs",
    "sidebar", "side", "aside", "footer", "header", "masthead", "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "toolbar", "pagination", "pager", "widget", "form", "complementary", "contentinfo", "tags",
}

# those of them that mark other people's text, however long it is
FOREIGN = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr"}
# names that start or end so tell the state of a wrapper: with-sidebar, comments-open
STATES = {"with", "without", "no", "not", "has", "is", "show", "open", "closed", "enabled", "disabled", "off"}
WHOLE_ONLY = {"side", "form", "search", "alert", "overlay", "tags"}  # said of an element only if they are the whole name
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}  # only a whole name marks these

_TOKEN = re.compile(r"<!--(?:>|->)|<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "depth", "open", "dropped", "weight", "key")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        # which rules an open element around here or this one itself would be ended by
        self.open = (parent.open if parent else 0) & ~_STOPS.get(tag, 0) | _ENDED.get(tag, 0)
        self.dropped = tag in NO_TEXT or tag in BOILERPLATE or self._hidden()
        self.weight = 1.0 if self.dropped or tag in ("html", "body") else self._weight()
        self.key: bytes | None = None

    def _hidden(self) -> bool:
        a = self.attrs
        return bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""))

    def _weight(self) -> float:
        """What its text counts in the containers around it."""
        least = SUSPECT if self.tag == "form" else 1.0
        for name in ("class", "id", "role") if self.attrs else ():
            for part in self.attrs.get(name, "").lower().split():
                words = _WORD.findall(part)
                if not words or len(words) > 1 and (words[0] in STATES or words[-1] in STATES):
                    continue
                # of names of several words the last or first one counts, as in comment-list and main-sidebar
                ends = set(words) if len(words) == 1 else set() if self.tag in PROSE else {words[0], words[-1]} - WHOLE_ONLY
                if ends & FOREIGN:
                    return COMMENT
                if ends & MARKED and self.tag not in ("article", "main"):
                    least = SUSPECT
        return least


# bits of the rules by which a start tag ends open elements: 0 is the paragraph's
_P_STOPS = {"table", "button", "div", "article", "section", "td"}
_RULES = [(ENDS_P, {"p"}, _P_STOPS), *[({tag}, *rule) for tag, rule in ENDS.items()]]
_STOPS: dict[str, int] = {}
_ENDED: dict[str, int] = {}
_STARTS: dict[str, int] = {}
for _k, (_starts, _ended, _stops) in enumerate(_RULES):
    for _table, _tags in ((_STARTS, _starts), (_ENDED, _ended), (_STOPS, _stops)):
        for _tag in _tags:
            _table[_tag] = _table.get(_tag, 0) | 1 << _k


def parse(text: str) -> Node:
    """The tree of a page; unclosed elements end with their parents, unknown end tags are ignored. Linear in the page."""
    root = here = Node("#root", {}, None)
    opened: dict[str, int] = {}
    at, last = 0, text.rfind(">")
    while (m := _TOKEN.search(text, at)) if at <= last else (m := _TOKEN.match(text, len(text))):
        if m.start() > at:
            here.children.append(text[at : m.start()])
        at = m.end()
        if tag := m[1]:
            tag = tag.lower()
            if opened.get(tag) and tag not in ("html", "body"):
                here = _close(here, tag, opened)
            elif tag in ("p", "br"):
                here.children.append(Node(tag, {}, here))
        elif tag := m[2]:
            tag = tag.lower()
            starts = _STARTS.get(tag, 0)
            if starts & 1 & here.open:
                here = _close(here, "p", opened)
            while starts & ~1 & here.open:
                here = _close(here, here.tag, opened)
            attrs = {}
            if m[3]:
                for a in _ATTRIBUTE.finditer(m[3]):
                    value = a[2] or ""
                    attrs.setdefault(a[1].lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
            node = Node(tag, attrs, here)
            here.children.append(node)
            if tag in RAW:
                end = _RAW_END[tag].search(text, at)
                at = end.end() if end else len(text)
            elif tag not in VOID and (tag in BLOCKS or not m[3].rstrip().endswith("/")):
                here = node  # a slash does not close a block
                opened[tag] = opened.get(tag, 0) + 1
    if at < len(text):
        here.children.append(text[at:])
    return root


def _close(here: Node, tag: str, opened: dict[str, int]) -> Node:
    """The parent of the innermost open element of ``tag``; those inside it end with it."""
    while True:
        opened[here.tag] -= 1
        ended, here = here.tag, here.parent
        if ended == tag:
            return here


def _step(node: Node) -> str:
    names = sorted({re.sub(r"\d+", "#", c).replace(">", "_") for c in node.attrs.get("class", "").lower().split()})
    return ".".join([node.tag, *names])


def path_of(node: Node) -> str:
    """Tags and classes from the top, without numbers: html>body>div.post-#>article."""
    steps = []
    while node.parent is not None:
        steps.append(_step(node))
        node = node.parent
    return ">".join(reversed(steps))


def _chained(key: bytes, step: str) -> bytes:
    return xxhash.xxh3_128_digest(key + step.encode("utf-8", "surrogatepass"))


def path_key(path: str) -> bytes:
    """The digest that stands for a path; deep paths would take quadratic space as texts."""
    key = b""
    for step in path.split(">"):
        key = _chained(key, step)
    return key


def _key(node: Node) -> bytes:
    chain = []
    while node.parent is not None and node.key is None:
        chain.append(node)
        node = node.parent
    key = node.key or b""
    for n in reversed(chain):
        key = n.key = _chained(key, _step(n))
    return key


def _headings(node: Node) -> list[Node]:
    """In reverse page order, for a stack."""
    found, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            found.append(n)
        else:
            stack += [c for c in reversed(n.children) if isinstance(c, Node) and (c is node or not c.dropped)]
    return found[::-1]


def containers(root: Node) -> list[tuple[float, int, Node]]:
    """(score, order, container), the best first: text outside of links, square roots of blocks' lengths added up.

    A container gets its own blocks whole and its inner containers' at a discount, so an article beats the body
    around it and the single paragraph's wrapper inside it; article and main count more, what is suspect less. Of the
    suspect elements those around the best container, and those below it that hold nearly all of its text without
    being foreign, are found to be wrappers: their ``weight`` becomes 1.
    """
    found: list[tuple[float, int, Node]] = []
    order = 0
    totals: dict[int, float] = {}  # as counted
    plain_totals: dict[int, float] = {}  # as if nothing were suspect
    stack: list[tuple[Node, float, bool]] = [(root, 1.0, False)]
    while stack:
        node, weight, done = stack.pop()
        if node.dropped:
            continue
        if not done:
            weight = min(weight, node.weight)
            stack.append((node, weight, True))
            stack += [(c, weight, False) for c in reversed(node.children) if isinstance(c, Node)]
            continue
        plain = sum(len(c.split()) for c in node.children if isinstance(c, str)) if node.tag != "a" else 0
        own = math.sqrt(plain) if node.tag in BLOCKS or plain > 3 else 0.0
        inner = [(c, 0.7 if c.tag in CONTAINERS else 1.0) for c in node.children if isinstance(c, Node) and id(c) in totals]
        total = totals[id(node)] = own + sum(totals[id(c)] * share * c.weight for c, share in inner)
        plain_totals[id(node)] = own + sum(plain_totals[id(c)] for c, _ in inner)
        if node.tag in CONTAINERS and total:
            found.append((total * weight * {"article": 2.0, "main": 1.6}.get(node.tag, 1.0), order, node))
        order += 1
    found.sort(key=lambda f: (-f[0], f[1]))
    best = found[0][2] if found else root
    around = best
    while around is not None:
        around.weight, around = 1.0, around.parent
    below, least = [best], NEARLY_ALL * plain_totals.get(id(best), 0.0)
    while below:
        node = below.pop()
        for c in node.children:
            if isinstance(c, Node) and plain_totals.get(id(c), -1.0) >= least > 0:
                if c.weight == SUSPECT:
                    c.weight = 1.0
                below.append(c)
    return found


def parts_of(root: Node) -> tuple[list[tuple[str, int]], list[tuple[Node, int, int]]]:
    """The page's blocks in order and the containers that show any, as (container, first block, number of blocks).

    With each block comes the depth of the innermost suspect element around it: a container shows those of its
    blocks whose depth is not larger than its own. ``containers`` must have weighed the tree.
    """
    blocks: list[tuple[str, int]] = []
    spans: list[tuple[Node, int, int]] = []
    run: list[str] = []
    has_block = _with_blocks(root)
    # node, next child, depth of the innermost suspect, first block, [blocks shown]
    stack: list[list] = [[root, 0, 0, 0, 0]]

    def close(frame: list) -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            blocks.append((text, frame[2]))
            frame[4] += 1
        run.clear()

    def enter(child: Node, cut: int) -> None:
        frame = stack[-1]
        if child.tag in BLOCKS or child.weight < 1:
            close(frame)
        stack.append([child, 0, cut, len(blocks), 0])

    while stack:
        frame = stack[-1]
        node, at, cut = frame[0], frame[1], frame[2]
        if at < len(node.children):
            frame[1] += 1
            child = node.children[at]
            if isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            elif child.tag == "header" and node.tag in ("article", "main", "section") and not child._hidden() and child._weight() == 1:
                # an article's own header: its headings are text
                for heading in _headings(child):
                    close(frame)
                    run.extend(_strings(heading))
                close(frame)
            elif child.dropped:
                if child.tag in BLOCKS:
                    close(frame)
            elif child.weight == 1:
                enter(child, cut)
            elif child.tag in BLOCKS or id(child) in has_block:
                enter(child, child.depth)
            # suspect words inside a line are left out
        else:
            if node.tag in BLOCKS or node.weight < 1 or node.parent is None:
                close(frame)
            stack.pop()
            if stack and node.weight == 1:
                stack[-1][4] += frame[4]
            if node.tag in CONTAINERS and frame[4]:
                spans.append((node, frame[3], len(blocks) - frame[3]))
    return blocks, spans


def _with_blocks(root: Node) -> set[int]:
    """Elements that hold a block."""
    found: set[int] = set()
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in BLOCKS:
            up = node.parent
            while up is not None and id(up) not in found:
                found.add(id(up))
                up = up.parent
        stack += [c for c in node.children if isinstance(c, Node)]
    return found


def _strings(node: Node) -> list[str]:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "br":
            out.append(" ")
        elif n is node or not n.dropped and n.weight == 1:
            stack += reversed(n.children)
    return out


def vote(text: str) -> tuple[str, float] | None:
    """The generalised path of the best container and its score."""
    best = containers(parse(text))
    return (path_of(best[0][2]), best[0][0]) if best else None


def shown(blocks: list[tuple[str, int]], depth: int, first: int, n: int) -> list[str]:
    """The blocks that a container at ``depth`` shows."""
    return [text for text, cut in blocks[first : first + n] if cut <= depth]


def extract(text: str, paths: list[str]) -> str:
    """The main text by the first of ``paths`` that leads to text, else by the page's own best container, else all."""
    root = parse(text)
    best = containers(root)
    blocks, spans = parts_of(root)
    for key in [path_key(p) for p in paths] + [_key(node) for _, _, node in best[:1]]:
        # several containers on one path, as articles of a list: all of them, in page order
        if lines := [line for node, first, n in sorted(spans, key=lambda s: s[1]) if _key(node) == key for line in shown(blocks, node.depth, first, n)]:
            return "\n".join(lines)
    return "\n".join(shown(blocks, 0, 0, len(blocks)))


def host_of(url: Column) -> Column:
    """Lower-case host of the URL without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_RANGE = pa.struct([("depth", pa.int32()), ("first", pa.int32()), ("n", pa.int32())])
_KINDS = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.struct([("path", pa.binary()), ("ranges", pa.list_(_RANGE))])), pa.binary(), pa.float64()]


def _parsed(pages: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of ``pages`` with each page's blocks, containers by path, and vote, from its column _html.

    No block holds a line break, so the blocks are one text of lines, compressed as it is written and exchanged.
    """
    added = "_blocks binary, _cuts array<int>, _spans array<struct<path: binary, ranges: array<struct<depth: int, first: int, n: int>>>>, _vote binary, _weight double"
    schema = T.StructType([f for f in pages.schema.fields if f.name in names] + T.StructType.fromDDL(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in small(batches):
            get = lambda n: batch.column(batch.schema.get_field_index(n))
            rows = []
            for value in get("_html"):
                root = parse(value.as_py() or "")
                best = containers(root)
                blocks, spans = parts_of(root)
                ranges: dict[bytes, list] = {}
                for node, first, n in sorted(spans, key=lambda s: s[1]):
                    ranges.setdefault(_key(node), []).append((node.depth, first, n))
                vote_ = (_key(best[0][2]), round(best[0][0], 6)) if best else (None, None)
                rows.append((pack("\n".join(t for t, _ in blocks).encode()), [cut for _, cut in blocks], list(ranges.items()), *vote_))
            yield pa.RecordBatch.from_arrays([*[get(n) for n in names], *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)]], names=[f.name for f in schema.fields])

    return pages.mapInArrow(run, schema)


def _cut(parts: DataFrame, names: list[str]) -> DataFrame:
    """``names`` with text and n_chars: the blocks that _ranges show, without any those outside of suspect elements."""
    schema = T.StructType([f for f in parts.schema.fields if f.name in names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            get = lambda n: batch.column(batch.schema.get_field_index(n))
            texts = []
            for packed, cuts, ranges in zip(get("_blocks"), get("_cuts"), get("_ranges")):
                blocks = list(zip(unpack(packed.as_py()).decode().split("\n"), cuts.as_py()))
                wanted = ranges.as_py() or [{"depth": 0, "first": 0, "n": len(blocks)}]
                texts.append("\n".join(line for r in wanted for line in shown(blocks, r["depth"], r["first"], r["n"])))
            yield pa.RecordBatch.from_arrays([*[get(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema.fields])

    return parts.mapInArrow(run, schema)


def extract_pages(pages: DataFrame, url: str = "url", content: str = "html") -> DataFrame:
    """``pages`` without ``content``, with text and n_chars (its code points).

    A null or empty page has an empty text. Pages without a host form a host of their own. Repeated rows are pages of
    their own and vote as such; an empty table stays empty. Columns called text and n_chars are replaced; none may be
    called _html, _host, _row, _blocks, _cuts, _spans, _vote, _weight, _path or _ranges. Every path with a vote counts, and a page takes
    the one of its paths with the largest share, ties to the heavier vote and the larger digest. A page none of whose containers shows text
    has the text outside of suspect elements. A host with a third of all pages can be split in the join of paths.
    """
    names = [c for c in pages.columns if c not in (content, "text", "n_chars")]
    hosted = pages.select(*names, F.col(content).cast("string").alias("_html"), host_of(F.col(url)).alias("_host"), F.monotonically_increasing_id().alias("_row"))
    parsed = stage(_parsed(hosted, [*names, "_host", "_row"]), "page-parts")
    weight = F.col("_weight").cast("decimal(28,6)")
    held = parsed.select("_row", "_host", weight.alias("weight"), "_vote", F.inline("_spans").alias("_path", "_ranges"))
    won = F.when(F.col("_path") == F.col("_vote"), F.col("weight"))
    sums = held.groupBy("_host", "_path").agg(F.sum("weight").cast("double").alias("held"), F.sum(won).cast("double").alias("won"), F.count(won).alias("n")).where("n > 0")
    paths = sums.select("_host", "_path", (F.col("won") / (F.col("held") + F.col("won") / F.col("n"))).alias("rate"), "won")
    best = held.select("_row", "_host", "_path", "_ranges").join(paths, ["_host", "_path"]).groupBy("_row").agg(F.max(F.struct("rate", "won", "_path", "_ranges")).alias("best"))
    parts = parsed.select(*names, "_row", "_blocks", "_cuts").join(best.select("_row", F.col("best._ranges").alias("_ranges")), "_row", "left")
    return _cut(parts, names)
