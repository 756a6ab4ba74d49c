"""Operator 12, main text of HTML pages by wrapper induction.

Pages of one host share a template.  Their DOM trees are aligned by simple tree matching; a slot whose text is the same on
nearly all pages of the host is template, a slot whose text varies may be content.

1. Every page is parsed into text blocks and a skeleton: the tree of its containers, where like neighbours are folded and the
   parts of a container that hold text (paragraphs, headings, lists) are leaves.  One short row a page is kept: its host, skeleton, the
   slots and hashes of its blocks, and its lead (the hash of its longest block).
2. The distinct skeletons of a host are merged by simple tree matching, some MERGE of them in a group; what comes out is merged
   again until each host has one template.  No group holds more, whatever the number of pages.
3. Pages are aligned with the template of their host.  Joint counts over all pages give constant texts (by slot, in leads, so that copies
   of one page are one witness) and the amount of varying text under each node.
4. Pages are parsed again and joined with the findings of their host.  Blocks in navigation, headers, footers, sidebars, notices,
   adverts, forms and comments go by their element, role, class or id even where their text varies; constant slots go; of the rest the
   article stays: article elements, else main, else an element named as content, each only if it has the varying text of the host; else the node
   that most varying text hangs below, without blocks that are links.

The join by host carries short tables; Spark broadcasts them below its own threshold, and beyond it splits hosts that have many pages.

Defined cases: null or empty html gives an empty text; a null url, or one without a host, is judged by its page alone; pages with repeated
ids are pages each by themselves; markup that is broken is read as far as it goes, with the implied ends of paragraphs, list items
and cells; elements nested deeper than DEEPEST count as part of the one above, with their text; very long pages are read whole; an empty table gives
an empty result; other columns do not matter.
"""

from __future__ import annotations

import html as entities
import itertools
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, arrow, rows_of

#: Skeletons, or templates, merged in one group.
MERGE = 16
#: A text is constant if this share of a host's leads has it, of at least so many leads; inside an article more of both.
CONSTANT, LEADS = 0.8, 3
CONSTANT_INSIDE, LEADS_INSIDE = 0.9, 20
#: Share of the host's varying text that an article, main or content element must have to be the region.
REGION = 0.3
#: Share of the varying text below a node that makes it the region where no element is named.
BELOW = 0.9
#: A block with more of its characters in links is a menu, outside articles.
LINKS = 0.6
DEEPEST = 64

# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
MUTE = frozenset("audio button canvas datalist label map noscript object option select svg template video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html head body div section article main nav header footer aside form center table thead tbody tfoot tr td th details fieldset dialog menu".split())
BLOCK = CONTAINERS | HEADINGS | frozenset("address blockquote caption dd dl dt figcaption figure hgroup legend li ol p pre summary ul".split())
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
GONE = frozenset("nav footer aside form head dialog menu".split())
GONE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: What a new element ends, up to the elements behind the bar.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("table",)), "th": ("td th", ("table",)), "tr": ("tr", ("table",))} | {t: ("thead tbody tfoot", ("table",)) for t in ("thead", "tbody", "tfoot")}
# words of class and id
READERS = frozenset("comment comments commentlist disqus respond replies".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promoted promotion".split())
NAMED = READERS | ADVERTS | frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager masthead topbar banner footer copyright colophon sidebar sidenav aside widget widgets rail cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search searchform related recommended recommendations share sharing social toolbar hidden".split())
HEADERS = frozenset(["header"])
CONTENT = frozenset("content article story post entry articlebody maincontent".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?:/([a-zA-Z][^\s/>]*)[^>]*|([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)|[!?/][^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TELLING = re.compile(r"class|id|role|style|hidden", re.I)
#: Parsed attributes that a task remembers.
REMEMBERED = 50_000

# kinds of an element: KEEP, or gone (GO); gone unless an article is inside (GO_OUTER); a header, whose headings stay in an article; ARTICLE, MAIN, NAMED_CONTENT
KEEP, GO, GO_OUTER, HEADER, ARTICLE, MAIN, NAMED_CONTENT = range(7)


def kind_of(tag: str, attributes: str) -> tuple[int, str]:
    """(kind, name) of an element; the name is made of the words of class and id."""
    if not attributes or not TELLING.search(attributes):
        found: dict[str, str] = {}
    else:
        found = {}
        for key, value in ATTRIBUTE.findall(attributes):
            found.setdefault(key.lower(), entities.unescape(value.strip("\"'")))
    words = [w.lower() for key in ("class", "id") for w in NAME_WORD.findall(found.get(key, ""))]
    name, have = ".".join(dict.fromkeys(words)), set(words)
    role = found.get("role", "").strip().lower()
    style = re.sub(r"\s", "", found.get("style", "").lower())
    if tag in ("html", "body"):
        return KEEP, ""
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return GO, name
    if have & READERS:
        return GO, name
    if tag == "main" or role == "main":
        return MAIN, name
    if tag == "article" or role == "article":
        return (GO if have & (ADVERTS | {"related", "recommended"}) else ARTICLE), name
    if tag in GONE or role in GONE_ROLES or have & NAMED:
        return GO_OUTER, name
    if tag == "header" or have & HEADERS:
        return HEADER, name
    if tag in CONTAINERS and (have & CONTENT or found.get("itemprop", "").lower() == "articlebody"):
        return NAMED_CONTENT, name
    return KEEP, name


class Page:
    """The elements and text blocks of a page.

    tags, names, kinds, parents: of block elements, parents first; blocks: (element, text, characters in links).
    """

    def __init__(self, source: str, memory: dict) -> None:
        self.tags, self.names, self.kinds, self.parents, self.depth = ["html"], [""], [KEEP], [-1], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._open: list[tuple[str, int, bool, bool]] = []  # (tag, element, block, mute)
        self._at, self._mute, self._links = 0, 0, 0
        self._held: list[str] = []
        self._linked = 0
        self._read(source, memory)

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            if text:
                self.blocks.append((self._at, text, self._linked))
            self._held, self._linked = [], 0

    def _text(self, data: str) -> None:
        if self._mute or not data:
            return
        if "&" in data:
            data = entities.unescape(data)
        self._held.append(data)
        if self._links:
            self._linked += len(" ".join(data.split()))

    def _pop(self, n: int) -> None:
        """Close the innermost elements down to n open ones."""
        if any(block for _, _, block, _ in self._open[n:]):
            self._flush()
        for tag, _, _, mute in self._open[n:]:
            self._mute -= mute
            self._links -= tag == "a"
        del self._open[n:]
        self._at = next((e for _, e, block, _ in reversed(self._open) if block), 0)

    def _close(self, tags, bars) -> bool:
        for k in range(len(self._open) - 1, -1, -1):
            tag = self._open[k][0]
            if tag in tags:
                self._pop(k)
                return True
            if tag in bars:
                return False
        return False

    def _start(self, tag: str, attributes: str, memory: dict) -> None:
        key = (tag, attributes)
        known = memory.get(key)
        if known is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            known = memory[key] = kind_of(tag, attributes)
        kind, name = known
        if tag not in BLOCK:
            mute = tag in MUTE or kind in (GO, GO_OUTER)
            self._mute += mute
            self._links += tag == "a"
            self._open.append((tag, self._at, False, mute))
            return
        if tag in ("html", "body"):
            self._flush()
            self._close(("head",), ())
            return
        self._flush()
        self._close(("p",), ("td", "th", "button", "caption", "object"))
        if tag in HEADINGS and self._open and self._open[-1][0] in HEADINGS:
            self._pop(len(self._open) - 1)
        if tag in ENDS:
            self._close(ENDS[tag][0].split(" "), ENDS[tag][1])
        if self._open and self._open[-1][0] == "head":
            self._pop(len(self._open) - 1)
        self._flush()
        element = len(self.tags)
        self.tags.append(tag)
        self.names.append(name)
        self.kinds.append(kind)
        self.parents.append(self._at)
        self.depth.append(self.depth[self._at] + 1)
        self._open.append((tag, element, True, False))
        self._at = element

    def _read(self, source: str, memory: dict) -> None:
        at, size, lowered = 0, len(source), None
        while at < size:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            end, start, attributes = m.groups()
            if start:
                tag = start.lower()
                if tag in RAW:
                    if lowered is None:
                        lowered = source.lower() if len(source.lower()) == size else re.sub("[A-Z]+", lambda x: x[0].lower(), source)
                    at = lowered.find(f"</{tag}", at)
                    if at < 0:
                        break
                    after = source.find(">", at)
                    at = size if after < 0 else after + 1
                elif tag in VOID:
                    if tag == "hr":
                        self._flush()
                    elif tag == "br" and not self._mute:
                        self._held.append(" ")
                elif self._open and self._open[-1][0] == "head" and tag not in IN_HEAD and tag not in BLOCK:
                    self._pop(len(self._open) - 1)
                    self._start(tag, attributes, memory)
                else:
                    self._start(tag, attributes, memory)
            elif end:
                tag = end.lower()
                if tag == "br":
                    self._held.append(" ")
                elif tag in ("html", "body"):
                    self._flush()
                elif tag in BLOCK:
                    self._flush()
                    bars = () if tag in ("table", "thead", "tbody", "tfoot", "tr", "td", "th") else ("td", "th", "table")
                    self._close(HEADINGS if tag in HEADINGS else (tag,), bars)
                else:
                    self._close((tag,), BLOCK)
        self._flush()

    def judged(self) -> tuple[list[bool], list[int]]:
        """(gone, region) of each element: whether it and all below it goes; ARTICLE, MAIN or NAMED_CONTENT that it is in as bits 1, 2, 4."""
        n = len(self.tags)
        holds, titled = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            if holds[i] or self.kinds[i] in (ARTICLE, MAIN):
                holds[p] = True
            if titled[i] or self.tags[i] == "h1":
                titled[p] = True
        gone, region, header = [False] * n, [0] * n, [False] * n
        for i in range(1, n):
            p, kind = self.parents[i], self.kinds[i]
            region[i] = region[p] | {ARTICLE: 1, MAIN: 2, NAMED_CONTENT: 4}.get(kind, 0)
            out = kind == GO or kind == GO_OUTER and not holds[i] and not (self.tags[i] == "form" and titled[i])
            header[i] = header[p] and kind not in (ARTICLE, MAIN) or kind == HEADER and not holds[i]
            inside = region[i] & 1 or region[i] & 4 and titled[i]
            if header[i] and not inside:
                out = True
            elif header[i] and self.tags[i] not in CONTAINERS and self.tags[i] not in HEADINGS and self.tags[i] != "hgroup":
                out = True
            gone[i] = gone[p] or out
        return gone, region

    def skeleton(self) -> tuple[str, list[int]]:
        """(JSON of the labels and parents of the folded tree, parents first; the node of each element)."""
        n = len(self.tags)
        children: list[list[int]] = [[] for _ in range(n)]
        owner = list(range(n))  # elements that are no nodes belong to the one above
        for i in range(1, n):
            p = owner[self.parents[i]]
            if self.depth[i] > DEEPEST or self.tags[p] not in CONTAINERS:
                owner[i] = p
            else:
                children[p].append(i)
        label = [t if t not in CONTAINERS or not name else f"{t}.{name}" for t, name in zip(self.tags, self.names, strict=True)]
        shapes: dict[tuple, int] = {}
        shape, folded = [0] * n, [[] for _ in range(n)]  # folded: groups of like children
        for i in range(n - 1, -1, -1):
            if owner[i] != i:
                continue
            leaves: dict[str, list[int]] = {}
            for c in children[i]:
                if self.tags[c] not in CONTAINERS and label[c] in leaves:
                    leaves[label[c]].append(c)
                elif self.tags[c] in CONTAINERS and folded[i] and shape[folded[i][-1][0]] == shape[c]:
                    folded[i][-1].append(c)
                else:
                    folded[i].append([c])
                    if self.tags[c] not in CONTAINERS:
                        leaves[label[c]] = folded[i][-1]
            key = (label[i], *(shape[g[0]] for g in folded[i]))
            shape[i] = shapes.setdefault(key, len(shapes) + 1)
        labels, above, node = [], [], [-1] * n
        todo = [([0], -1)]
        while todo:  # like elements take the same node, and so do what stands below them in the same order
            group, parent = todo.pop()
            for i in group:
                node[i] = len(labels)
            me = len(labels)
            labels.append(label[group[0]])
            above.append(parent)
            todo += [([c for i in group for c in folded[i][k]], me) for k in range(len(folded[group[0]]) - 1, -1, -1)]
        return json.dumps([labels, above], separators=(",", ":")), [node[owner[i]] for i in range(n)]


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Tree:
    """Labels and children of a template or skeleton."""

    def __init__(self, text: str) -> None:
        self.labels, self.parents = json.loads(text)
        self.children: list[list[int]] = [[] for _ in self.labels]
        for i, p in enumerate(self.parents):
            if p >= 0:
                self.children[p].append(i)

    def text(self) -> str:
        """JSON with parents first, children in order, so that equal trees have equal texts."""
        order, todo = [], [0]
        while todo:
            i = todo.pop()
            order.append(i)
            todo += reversed(self.children[i])
        place = {i: k for k, i in enumerate(order)}
        return json.dumps([[self.labels[i] for i in order], [place.get(self.parents[i], -1) for i in order]], separators=(",", ":"))


def matching(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the largest mapping of nodes of b to nodes of a that keeps labels, parents and the order of children.

    Equal subtrees are of one class, and a pair of classes is counted once.  Of the table of two lists of children every so many rows are
    kept, and those between are made again on the way back, so that lists of any length are matched in little space.
    """
    numbers: dict[tuple, int] = {}

    def classes(t: Tree) -> list[int]:
        out = [0] * len(t.labels)
        for i in range(len(out) - 1, -1, -1):  # parents have the smaller numbers
            out[i] = numbers.setdefault((t.labels[i], *(out[c] for c in t.children[i])), len(numbers))
        return out

    of_a, of_b = classes(a), classes(b)
    memo: dict[tuple[int, int], int] = {}

    def best(x: int, y: int) -> int:
        """Matched pairs below and with x and y, of the same label."""
        key = of_a[x], of_b[y]
        if key not in memo:
            row = None
            if a.children[x] and b.children[y]:
                for row in table(x, y):
                    pass
            memo[key] = 1 if row is None else 1 + int(row[-1])
        return memo[key]

    def table(x: int, y: int, start: int = 0, row: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Matched pairs of the children of x up to each, from start and its row on, with those of y up to each."""
        ys = b.children[y]
        first: dict[int, int] = {}
        for v in ys:
            first.setdefault(of_b[v], v)
        at = {c: i for i, c in enumerate(first)}
        place = np.array([at[of_b[v]] for v in ys])
        gains: dict[int, np.ndarray] = {}
        row = np.zeros(len(ys) + 1, np.int64) if row is None else row
        yield row
        for u in a.children[x][start:]:
            if of_a[u] not in gains:
                gains[of_a[u]] = np.array([best(u, v) if a.labels[u] == b.labels[v] else 0 for v in first.values()])[place]
            after = row.copy()
            np.maximum(after[1:], row[:-1] + gains[of_a[u]], out=after[1:])
            row = np.maximum.accumulate(after)
            yield row

    def pairs(x: int, y: int) -> list[tuple[int, int]]:
        xs, ys = a.children[x], b.children[y]
        if not xs or not ys:
            return []
        span = math.isqrt(len(xs)) + 1
        kept = [row for i, row in enumerate(table(x, y)) if i % span == 0]
        out, j = [], len(ys)
        for k in range((len(xs) - 1) // span, -1, -1):
            rows = list(itertools.islice(table(x, y, k * span, kept[k]), min(span, len(xs) - k * span) + 1))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    out.append((xs[k * span + i - 1], ys[j - 1]))
                    i, j = i - 1, j - 1
        return out

    out, todo = {0: 0}, [(0, 0)]
    while todo:
        for u, v in pairs(*todo.pop()):
            out[v] = u
            todo.append((u, v))
    return out


def merged_tree(texts: list[str]) -> str:
    """The template of some skeletons: matched nodes are one, others are put behind the last matched neighbour before them."""
    a = Tree(texts[0])
    for text in texts[1:]:
        b = Tree(text)
        to = matching(a, b)
        for v in range(1, len(b.labels)):
            if v in to:
                continue
            p, u = to[b.parents[v]], len(a.labels)
            a.labels.append(b.labels[v])
            a.parents.append(p)
            a.children.append([])
            before = [w for w in b.children[b.parents[v]] if w < v]
            at = a.children[p].index(to[before[-1]]) + 1 if before else 0
            a.children[p].insert(at, u)
            to[v] = u
    return a.text()


def host_of(url: str):
    """Host and port, lowered; null where the url has none."""
    host = F.lower(F.regexp_extract(F.col(url), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#\s]+)", 1))
    return F.when(host != "", host)


PARSED = pa.schema([("host", pa.string()), ("tree", pa.string()), ("lead", pa.int64()), ("nodes", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("inside", pa.list_(pa.int8()))])


def parsed(pages: DataFrame) -> DataFrame:
    """A short row for each page with a host: skeleton, lead, and node, hash, size and region of its blocks that may be content."""

    def run(batches):
        memory: dict = {}
        for rows in rows_of(batches, "host", "html"):
            out = []
            for host, source in rows:
                page = Page(source or "", memory)
                gone, region = page.judged()
                tree, node = page.skeleton()
                left = [(node[e], hash_of(text), len(text), region[e]) for e, text, linked in page.blocks if not gone[e] and (region[e] & 1 or linked <= LINKS * len(text))]
                lead = max(left, key=lambda x: (x[2], x[1]), default=(0, 0, 0, 0))[1]
                out.append((host, tree, lead, [x[0] for x in left], [x[1] for x in left], [x[2] for x in left], [x[3] for x in left]))
            yield arrow(PARSED, out)

    return pages.where("host is not null").select("host", "html").mapInArrow(run, "host string, tree string, lead long, nodes array<int>, hashes array<long>, sizes array<int>, inside array<tinyint>")


def templates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, template) of rows (host, tree): merged in groups of about MERGE, until each host has one."""
    trees = scratch.keep(rows.select("host", "tree").distinct(), "trees0")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tree": [merged_tree(sorted(pdf["tree"]))]})

    for k in range(1, 64):
        n = trees.groupBy("host").agg(F.count("*").alias("_n"))
        if n.where("_n > 1").isEmpty():
            break
        several = n.where("_n > 1")
        dealt = trees.join(several, "host").withColumn("_g", F.pmod(F.xxhash64("tree", F.lit(k)), F.ceil(F.col("_n") / MERGE)))
        one = dealt.groupBy("host", "_g").applyInPandas(merge, "host string, tree string").distinct()
        trees = scratch.keep(one.unionByName(trees.join(several, "host", "left_anti")), f"trees{k}")
    return trees.withColumnRenamed("tree", "template")


def aligned(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(host, lead, node, hash, size, inside): the blocks of all pages by the node of their host's template."""
    schema = pa.schema([("host", pa.string()), ("lead", pa.int64()), ("node", pa.int32()), ("hash", pa.int64()), ("size", pa.int32()), ("inside", pa.int8())])

    def run(batches):
        known: dict = {}
        for batch in rows_of(batches, "host", "tree", "template", "lead", "nodes", "hashes", "sizes", "inside"):
            out = []
            for host, tree, template, lead, nodes, hashes, sizes, inside in batch:
                if (tree, template) not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[tree, template] = matching(Tree(template), Tree(tree))
                to = known[tree, template]
                out += [(host, lead, to.get(v, -1), h, size, i) for v, h, size, i in zip(nodes, hashes, sizes, inside, strict=True)]
            yield arrow(schema, out)

    return rows.join(made, "host").mapInArrow(run, "host string, lead long, node int, hash long, size int, inside tinyint")


def findings(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, template, constants, volumes): array of (node, hash) of constant texts; characters of varying text by node and region."""
    rows = scratch.keep(parsed(pages), "pages", "zstd")
    made = templates(rows, scratch)
    blocks = scratch.keep(aligned(rows, made), "blocks", "zstd")
    leads = rows.groupBy("host").agg(F.count_distinct("lead").alias("_leads"))
    seen = blocks.groupBy("host", "node", "hash").agg(F.count_distinct("lead").alias("_n"), F.max(F.col("inside").bitwiseAND(F.lit(1))).alias("_in"), F.sum("size").alias("_chars"))
    enough = F.when(F.col("_in") == 1, (F.col("_n") >= F.col("_leads") * CONSTANT_INSIDE) & (F.col("_leads") >= LEADS_INSIDE)).otherwise((F.col("_n") >= F.col("_leads") * CONSTANT) & (F.col("_leads") >= LEADS))
    constant = seen.where("_n > 1").join(leads, "host").where(enough).select("host", "node", "hash", "_chars")
    constant = scratch.keep(constant, "constants")
    same = constant.groupBy("host").agg(F.collect_list(F.struct("node", "hash")).alias("constants"))  # a few for each page of a host at most
    volume = blocks.groupBy("host", "node", "inside").agg(F.sum("size").alias("chars"))
    fixed = constant.groupBy("host", "node").agg(F.sum("_chars").alias("_fixed"))
    volume = volume.join(fixed, ["host", "node"], "left").select("host", "node", "inside", F.greatest(F.lit(0), F.col("chars") - F.coalesce("_fixed", F.lit(0))).alias("chars"))
    sums = volume.groupBy("host").agg(F.collect_list(F.struct("node", "inside", "chars")).alias("volumes"))  # nodes of one template
    return scratch.keep(made.join(same, "host", "left").join(sums, "host", "left"), "findings")


def region_of(tree: Tree, volumes: list[tuple[int, int, int]]) -> tuple[int, set[int]]:
    """(bit of the region, or 0; the nodes below the chosen node) by volumes (node, region bits, characters)."""
    every = sum(v for _, _, v in volumes)
    for bit in (1, 2, 4):
        if every and sum(v for _, r, v in volumes if r & bit) >= REGION * every:
            return bit, set()
    weight = [0] * len(tree.labels)
    for node, _, v in volumes:
        if node >= 0:
            weight[node] += v
    for i in range(len(weight) - 1, 0, -1):
        weight[tree.parents[i]] += weight[i]
    at = 0
    while not any(tree.labels[c] == "h1" for c in tree.children[at]):
        down = [c for c in tree.children[at] if tree.labels[c].split(".")[0] in CONTAINERS and weight[c] >= BELOW * max(1, weight[0])]
        if not down:
            break
        at = down[0]
    inside, todo = set(), [at]
    while todo:
        i = todo.pop()
        inside.add(i)
        todo += tree.children[i]
    return 0, inside


class Wrapper:
    """What is known of a host: its template, its constants, its region."""

    def __init__(self, template: str, constants: list, volumes: list) -> None:
        self.tree = Tree(template)
        self.constants = {(c["node"], c["hash"]) for c in constants or []}
        self.bit, self.inside = region_of(self.tree, [(v["node"], v["inside"], v["chars"]) for v in volumes or []])
        self.known: dict[str, dict[int, int]] = {}

    def nodes(self, tree: str) -> dict[int, int]:
        if tree not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[tree] = matching(self.tree, Tree(tree))
        return self.known[tree]


def main_text(source: str | None, wrapper: Wrapper | None, memory: dict) -> str:
    """The text of a page, by its host's wrapper or, without one, by the page alone."""
    page = Page(source or "", memory)
    gone, region = page.judged()
    tree, node = page.skeleton()
    if wrapper is None:
        left = [(node[e], region[e], len(text)) for e, text, linked in page.blocks if not gone[e] and linked <= LINKS * len(text)]
        bit, inside = region_of(Tree(tree), left)
        to, constants = {}, frozenset()
    else:
        bit, inside, to, constants = wrapper.bit, wrapper.inside, wrapper.nodes(tree), wrapper.constants
    out = []
    rest = []  # for pages that do not have the region of their host
    for e, text, linked in page.blocks:
        if gone[e]:
            continue
        at = to.get(node[e], -1) if wrapper else node[e]
        if constants and (at, hash_of(text)) in constants:
            continue
        if not region[e] & 1 and linked > LINKS * len(text):
            continue
        rest.append(text)
        if bit and region[e] & bit or not bit and (at in inside or at < 0):
            out.append(text)
    return "\n\n".join(out or rest)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    scratch = Scratch(pages.sparkSession, "html")
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    found = findings(source, scratch)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        wrappers: dict[str, Wrapper] = {}
        for rows in rows_of(batches, "page_id", "url", "html", "host", "template", "constants", "volumes"):
            out = []
            for key, url, text, host, template, constants, volumes in rows:
                if template is not None and host not in wrappers:
                    if len(wrappers) >= 1000:
                        wrappers.clear()
                    wrappers[host] = Wrapper(template, constants, volumes)
                got = main_text(text, wrappers.get(host) if template is not None else None, memory)
                out.append((key, url, got, len(got)))
            yield arrow(schema, out)

    joined = source.withColumn("page_id", F.col("page_id").cast("long")).join(found, "host", "left")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
