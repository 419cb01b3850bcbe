"""Main-text extraction with wrappers inferred from the pages of a host.

A page is read as a nested token stream: tags that make structure, and the text blocks between them. A wrapper
is a union-free regular expression over such streams: a sequence of nodes, each once, optional, repeated or both,
with text slots that are fixed (every page had the same text there) or free. Wrappers are inferred by alignment:

* inside a stream, neighbouring equal nodes and short runs of nodes that follow each other fold into one repeated
  node or group, their contents aligned with each other;
* two sequences are aligned along their longest common subsequence of node labels; what only one of them has
  becomes optional, what both have is aligned inside; two texts that differ become a free slot.

Alignment is iterated page by page in each task, then over the tasks' wrappers of a host in salted groups and
over the salts, so a host with a third of all pages is inferred by many tasks and only wrappers, never pages,
meet in one. Each page is then matched with its host's wrapper.

A repeated slot holds several texts, so its fixed texts are counted: a text that stands in one slot (path of labels)
on at least FIXED pages and on half of the host's pages that have the slot is fixed there (``slot_texts``).

A text block belongs to the article unless an element around it is boilerplate by its kind or name. If the page
has an article or main element, only its blocks count. Fixed texts go if enough of the page's other text is free;
pages that share nearly all of their text are copies of an article, and show no template. Without an article or main
element, blocks in fixed slots of the wrapper go as well, unless nothing else is left.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page; the tokenizer jumps over them.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object", "canvas")
#: Elements inside a line of text: they neither end a block nor make structure.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source map area".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article; header only counts outside one.
APART = frozenset("nav footer aside form button dialog menu label fieldset input head datalist output".split())
#: Names in class, id and role that mark an element as no part of an article.
NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer "
    "comment comments commentlist disqus respond replies discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations widget toolbar pagination pager search complementary contentinfo".split()
)
#: Words that a name may be joined with and still be the element's name: sidebar-left, comment-list; not no-sidebar or related-work.
LAYOUT = frozenset(
    "area bar block body bottom box button buttons container content footer form group header icon icons inner item items left link links list main outer page panel primary right row secondary "
    "section site slot text title top unit wrap wrapper".split()
)
MAIN = ("article", "main")
#: Elements that hold the page or the article, which no name sets apart; elements whose id is an anchor in the text.
WHOLE, ANCHORED = frozenset(("html", "body", "main", "article")), frozenset("section h1 h2 h3 h4 h5 h6 p".split())
#: Opening one of these ends the open element of the listed names, as in HTML.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS_P = frozenset(("html", "head", "body", "br", "input", "label", "button"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?!(?<=svg)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORDS = re.compile(r"[^a-z0-9]+")
#: Longest run of sibling nodes that is looked for as a repeated group; distinct pages that make a text fixed.
GROUP, FIXED = 4, 3
#: Deepest level of the structure: what is nested deeper stands side by side there, as in browsers; texts are all kept.
DEPTH = 100
#: A fixed text goes if at least one character in so many of the page's other text is free: copies share more.
FREE = 3


class Node:
    """Element of a page's stream: label, children, and whether it is apart from (1 by name only, 2 by kind) or holds the article. Text has label #."""

    __slots__ = ("label", "name", "children", "text", "apart", "main", "home")

    def __init__(self, label: str, name: str, apart: int, main: bool, text: str | None = None):
        self.label, self.name, self.apart, self.main, self.text = label, name, apart, main, text
        self.children: list[Node] = []
        self.home = self  # where the children go


def stream_of(page: str | None) -> Node:
    """Nested token stream of a page; unclosed and stray tags are taken as browsers do."""
    root = Node("", "", 0, False)
    stack, pieces, at, text = [root], [], 0, page or ""

    def flush() -> None:
        if pieces:
            block = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if block:
                top = stack[-1]
                top.home.children.append(Node("#", "#", top.apart, top.main, block))

    def close(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in stop:
                return

    for m in TOKEN.finditer(text):
        if m.start() > at:
            pieces.append(text[at : m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if name in INLINE and (m.group("end") or not _named_apart(name, m.group("rest"))):
            if m.group("end") and stack[-1].name == name:  # ends an inline element that was named as boilerplate
                flush()
                stack.pop()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        flush()
        if m.group("end"):
            close((name,), ())
            continue
        rest = m.group("rest")
        if name in INLINE:
            # an inline element named as boilerplate: its text is a block of its own
            pass
        elif name in ENDS:
            close(ENDS[name], ("ul", "ol", "dl", "table"))
        elif name not in KEEPS_P:
            close(("p",), ("article", "td", "th", "table", "button", "li"))
        top = stack[-1]
        named = _names(rest)
        main = top.main or name in MAIN or "main" in named and "role" in rest.lower()
        if name in APART or (name == "header" and not top.main) or (rest and HIDDEN.search(rest)):
            apart = 2
        else:
            apart = max(top.apart, int(_named_apart(name, rest)))
        node = Node(name + "".join("." + w for w in sorted(_class_words(rest))), name, apart, main)
        top.home.children.append(node)
        if len(stack) >= DEPTH:
            node.home = top.home
        if name not in VOID and not rest.endswith("/"):
            stack.append(node)
    if len(text) > at:
        pieces.append(text[at:])
    flush()
    return root


def _named_apart(name: str, rest: str) -> bool:
    """Whether a whole class, id or role names the element as no part of an article."""
    if not rest or "=" not in rest or name in WHOLE:
        return False
    for m in NAMED.finditer(rest):
        if name in ANCHORED and m.group()[:2].lower() == "id":
            continue
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = {w for w in WORDS.split(token) if w and not w.isdigit()}
            if parts & NAMES and parts <= NAMES | LAYOUT:
                return True
    return False


def _names(rest: str) -> set[str]:
    if not rest or "=" not in rest:
        return set()
    found: set[str] = set()
    for a, b, c in NAMED.findall(rest):
        found.update(WORDS.split((a or b or c).lower()))
    found.discard("")
    return found


def _class_words(rest: str) -> set[str]:
    """Words of class and role that pages share: ids and words with digits (post-17) differ from page to page."""
    if not rest or "=" not in rest:
        return set()
    found = (m for m in NAMED.finditer(rest) if m.group()[:2].lower() != "id")
    return {w for m in found for w in WORDS.split((m[1] or m[2] or m[3] or "").lower()) if w and not any(map(str.isdigit, w))}


# A wrapper node is [label, optional, many, content]: content is a list of nodes, or a text's hash (0: free slot).


def _fixed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) | 1


def pattern_of(node: Node) -> list:
    """Folded wrapper nodes of a stream's children."""
    return fold([["#", 0, 0, _fixed(c.text)] if c.label == "#" else [c.label, 0, 0, pattern_of(c)] for c in node.children])


def merge(a: list, b: list) -> list:
    """Two nodes of one label as one."""
    inner = (a[3] if a[3] == b[3] else 0) if a[0] == "#" else align(a[3], b[3])
    return [a[0], a[1] | b[1], a[2] | b[2], inner]


def _alike(a: list, b: list) -> bool:
    """Whether two neighbours of one label repeat each other: most kinds of children in common."""
    if a[0] != b[0] or a[0] == "#":
        return a[0] == b[0]
    x, y = {n[0] for n in a[3]}, {n[0] for n in b[3]}
    return 2 * len(x & y) >= len(x | y)


def fold(nodes: list) -> list:
    """Neighbouring repetitions as repeated nodes (runs of one) and repeated groups (runs of up to GROUP)."""
    if len(nodes) < 2:
        return nodes
    for width in range(1, GROUP + 1):
        out: list = []
        for node in nodes:
            out.append(node)
            while len(out) >= 2 * width and all(map(_alike, out[-width:], out[-2 * width : -width])):
                if width == 1 and out[-1][0] == "#":
                    break  # neighbouring texts are one block already
                first, second = out[-2 * width : -width], out[-width:]
                both = [merge(x, y) for x, y in zip(first, second)]
                if width == 1:
                    both[0][2] = 1
                    out[-2:] = both
                else:
                    out[-2 * width :] = [["()", 0, 1, both]]
            if width > 1 and len(out) > width and out[-1][0] != "()":
                # a group that is already repeated takes in one more run
                head = out[-width - 1]
                if head[0] == "()" and len(head[3]) == width and all(map(_alike, head[3], out[-width:])):
                    out[-width - 1 :] = [["()", head[1], 1, [merge(x, y) for x, y in zip(head[3], out[-width:])]]]
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """Alignment of two sequences along their longest common subsequence of labels; the rest becomes optional."""
    if a == b:
        return a
    la, lb = [n[0] for n in a], [n[0] for n in b]
    if la == lb:
        return [merge(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if la[i] == lb[j] else below[j] if below[j] >= row[j + 1] else row[j + 1]
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and la[i] == lb[j]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], 1, a[i][2], a[i][3]])
            i += 1
        else:
            out.append([b[j][0], 1, b[j][2], b[j][3]])
            j += 1
    return fold(out)


def _merge_wrappers(a: tuple[int, list], b: tuple[int, list]) -> tuple[int, list]:
    """(distinct pages, nodes) of two wrappers; a page equal to another counts once."""
    if a[0] == b[0] == 1 and a[1] == b[1]:
        return a
    return a[0] + b[0], align(a[1], b[1])


def _infer(batches: Iterator[pd.DataFrame], most: int = 20_000) -> Iterator[pd.DataFrame]:
    """(host, html) in; (host, wrapper) out, one per host met (given out early beyond ``most`` hosts)."""
    met: dict[str, tuple[int, list]] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame({"host": list(met), "wrapper": [json.dumps(w, separators=(",", ":")) for w in met.values()]}, dtype=object)

    for pdf in batches:
        for host, page in zip(pdf["host"], pdf["html"]):
            own = (1, pattern_of(stream_of(page)))
            old = met.get(host)
            met[host] = own if old is None else _merge_wrappers(old, own)
        if len(met) > most:
            yield out()
            met.clear()
    yield out()


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, wrapper) sorted by host in; one wrapper per host out, holding one at a time."""
    host, now = None, None
    for pdf in batches:
        done: list[tuple[str, str]] = []
        for h, text in zip(pdf["host"], pdf["wrapper"]):
            own = tuple(json.loads(text))
            if h != host and host is not None:
                done.append((host, json.dumps(now, separators=(",", ":"))))
            now = own if h != host else _merge_wrappers(now, own)
            host = h
        yield pd.DataFrame(done, columns=["host", "wrapper"], dtype=object)
    if host is not None:
        yield pd.DataFrame([(host, json.dumps(now, separators=(",", ":")))], columns=["host", "wrapper"], dtype=object)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without port; empty when there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 16) -> DataFrame:
    """(host, wrapper): the wrapper of all pages of each host, as JSON [distinct pages, nodes]."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    partial = rows.mapInPandas(_infer, "host string, wrapper string")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper")
    merged = salted.mapInPandas(_combine, "host string, wrapper string")
    return merged.repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(_combine, "host string, wrapper string")


def _slots(node: Node, path: int = 0, apart: int = 0) -> Iterator[tuple[Node, int]]:
    """The text blocks below ``node`` that no element sets apart (``apart`` 1: by kind), each with the slot it stands in."""
    for c in node.children:
        if c.apart > apart:
            continue
        at = _long(f"{path}/{c.label}")
        if c.label == "#":
            yield c, at
        else:
            yield from _slots(c, at, apart)


def _long(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _slot_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, html) in; (host, slot, text) out, once a page: text is the hash of a block, or null for the slot itself."""
    for pdf in batches:
        rows: list[tuple] = []
        for host, page in zip(pdf["host"], pdf["html"]):
            found = {(slot, _long(c.text)) for c, slot in _slots(stream_of(page))}
            rows += [(host, slot, text) for slot, text in found] + [(host, slot, None) for slot in {slot for slot, _ in found}]
        hosts, slots, texts = zip(*rows) if rows else ((), (), ())
        yield pd.DataFrame({"host": pd.Series(hosts, dtype=object), "slot": pd.Series(slots, dtype="int64"), "text": pd.Series(texts, dtype="Int64")})


def slot_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, fixed): [slot, text, pages] of every text that is fixed in a slot of the host; hosts without any are left out.

    A slot has at most twice as many fixed texts as blocks a page, so a host's list does not grow with its pages.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    counts = rows.mapInPandas(_slot_rows, "host string, slot long, text long")
    # the aggregate t keeps the filters below from moving into the pages: one shuffle serves both sides of the join
    counts = counts.groupBy("host", "slot", "text").agg(F.count("*").alias("n"), F.max("text").alias("t")).where(F.col("n") >= FIXED)
    slots = counts.where("t is null").select("host", "slot", F.col("n").alias("of"))
    fixed = counts.where("t is not null").join(slots, ["host", "slot"]).where(2 * F.col("n") >= F.col("of"))
    return fixed.groupBy("host").agg(F.collect_list(F.array("slot", "t", "n")).alias("fixed"))


def _template(texts: list[Node], slots: dict[int, int], fixed: dict[tuple[int, int], int]) -> set[int]:
    """Ids of the text nodes whose fixed text is the host's template and not an article that has copies."""
    size = [(fixed.get((slots[id(t)], _long(t.text)), 0), len(t.text), id(t)) for t in texts]
    total = sum(n for _, n, _ in size)
    free = {pages: sum(n for other, n, _ in size if 2 * other <= pages) for pages in {p for p, _, _ in size if p}}
    return {i for pages, n, i in size if pages and free[pages] and FREE * free[pages] >= total - n}


def _fixed_texts(node: Node, nodes: list, found: set[int]) -> None:
    """Ids of the text nodes below ``node`` that stand in a fixed slot of the wrapper nodes, optional ones left out: what
    a single page adds is no template."""
    flat = []
    for w in nodes:
        flat.extend(w[3] if w[0] == "()" else [w])
    at = 0
    for child in node.children:
        k = next((k for k in range(at, len(flat)) if flat[k][0] == child.label), None)
        if k is None:
            k = next((k for k in range(at) if flat[k][0] == child.label), None)
            if k is None:
                continue
        w = flat[k]
        at = k if w[2] else k + 1
        if w[1]:
            continue
        if child.label == "#":
            if w[3] and not w[2] and w[3] == _fixed(child.text):
                found.add(id(child))
        elif isinstance(w[3], list):
            _fixed_texts(child, w[3], found)


def extract(page: str | None, wrapper: tuple[int, list] | None, fixed: dict[tuple[int, int], int] | None = None) -> list[str]:
    """Article blocks of one page in page order; ``fixed`` has the pages of each fixed (slot, text)."""
    root = stream_of(page)
    slots = {}
    texts: list[Node] = []
    for c, slot in list(_slots(root)) or _slots(root, apart=1):  # names that take the whole page say nothing
        texts.append(c)
        slots[id(c)] = slot
    inside = [t for t in texts if t.main]
    template = _template(inside or texts, slots, fixed) if fixed else set()
    if inside:
        return [t.text for t in inside if id(t) not in template]
    texts = [t for t in texts if id(t) not in template]
    if wrapper is not None and wrapper[0] >= FIXED:
        found: set[int] = set()
        _fixed_texts(root, wrapper[1], found)
        free = [t for t in texts if id(t) not in found]
        texts = free or texts
    return [t.text for t in texts]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks), one row per input row.

    Blocks are joined by one line feed; white space inside a block is one space; character references are decoded.
    Null and empty html has empty text. Pages with a null or unreadable url share the empty host. Rows that repeat
    a page have one row each; other columns are not read; an empty table gives an empty result. Tags may be nested
    to any depth; beyond ``DEPTH`` levels they count as neighbours.
    """
    wrappers = infer_wrappers(pages, url_col, html_col).join(slot_texts(pages, url_col, html_col), "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, tuple] = {}
        for pdf in batches:
            blocks = []
            for page, host, text, fixed in zip(pdf["html"], pdf["host"], pdf["wrapper"], pdf["fixed"]):
                if host not in read:
                    if len(read) > 1000:
                        read.clear()
                    read[host] = tuple(json.loads(text)), {(int(s), int(t)): int(n) for s, t, n in fixed} if fixed is not None else {}
                blocks.append(extract(page, *read[host]))
            joined = ["\n".join(b) for b in blocks]
            yield pd.DataFrame(
                {"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": joined, "n_chars": [len(t) for t in joined], "n_blocks": [len(b) for b in blocks]}
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    joined = rows.join(wrappers, "host").select("page_id", "url", "html", "host", "wrapper", "fixed")
    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long, n_blocks long")
