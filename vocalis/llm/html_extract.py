"""HTML extraction by wrapper induction: same-host DOM trees aligned by simple
tree matching.

1. A page is read once into a tree of its block elements.  Repeated siblings
   (paragraphs, list items, rows, more than ``RUN`` equal containers in a row)
   share one node, an iterator, so a tree is small however long the page is.
2. The distinct trees of a host, counted, are aligned by simple tree matching
   and merged into one wrapper: in parts of ``PART`` trees, the merged trees
   again in parts, until one is left.  A node that fewer than one in ``RARE``
   of the pages have leaves the wrapper; what a page has there is matched to
   the node above.
3. Every page is aligned with its host's wrapper, which gives each of its text
   blocks a slot.  Over all pages of the host a text that stands in the same
   slot of ``CONSTANT`` of them or more is template, whatever varies is content.
   Pages with equal texts count once, and a host with fewer than ``MIN_PAGES``
   different ones has no template texts.
4. The content region of a host is the wrapper node under which the varying
   text gathers: from the root on, the child that holds most of it.  Navigation,
   forms, adverts, comments and the like (fixed names of elements and of words
   in class, id and role) are never part of it.
5. A page's text is its content blocks in page order.

Wrappers are joined to the pages by host: broadcast up to a counted size, else
with a host's pages dealt over salts.

Cases: a null, empty or text-less page has the empty text.  A null url, or one
without a host, belongs to the host ''.  Repeated rows and equal ids stay rows
of their own.  Elements below ``DEPTH`` open blocks belong to the block at that
depth.  Equal pages of a host do not make each other template; if more than a
third of the text of a host's region looks like template, its pages are copies
and all of it stays.  An empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import CLOSE, CLOSES_P, OPEN, RAW, VOID, scan
from .common import read_table, stored

RUN = 4
PART = 64
RARE = 200
DEPTH = 48
CONSTANT = 0.8
MIN_PAGES = 5
#: share of the text of a page up to which a marked element may be left out
MOST = 0.7
#: bytes of wrappers that are broadcast; pages of one host and salt beyond it
BROADCAST_BYTES = 16 << 20
SALT_PAGES = 20_000

# fixed values: elements that never hold text of the article
SILENT = frozenset(["head", "title", "script", "style", "noscript", "template", "svg", "iframe", "object",
                    "button", "select", "option", "textarea", "audio", "video", "canvas"])
# elements and words of class, id and role that mark other parts of a page
MARKED = frozenset(["nav", "footer", "aside", "form", "header", "dialog", "menu"])
MARK_WORDS = frozenset("""
    ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice alert newsletter subscribe subscription signup popup modal overlay
    share sharing social follow comment comments disqus respond reply replies discussion feedback
    related recommended recommendations teaser trending sidebar widget toolbar
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead footer header topbar
    login search searchbox complementary contentinfo skip tagcloud paywall outbrain taboola
""".split())
# elements without a block of their own
INLINE = frozenset("""
    a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr
""".split())
# siblings of these names share one node of the tree
FLOW = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "tr", "td", "th", "ul", "ol", "dl",
                  "table", "tbody", "blockquote", "pre", "figure", "hr"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# an end tag closes no element beyond these
CELLS = frozenset(["td", "th", "table"])
TABLE = frozenset(["table"])
ROWS = frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption"])
# elements that leave the head open
OF_HEAD = frozenset(["title", "meta", "link", "script", "style", "base", "noscript", "template"])

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tree:
    """A node of a page's tree or of a wrapper: key, number of pages, children."""

    __slots__ = ("key", "pages", "children", "slot")

    def __init__(self, key: str, pages: int = 1, children: list | None = None):
        self.key, self.pages, self.children, self.slot = key, pages, children or [], -1

    def packed(self) -> list:
        return [self.key, self.pages, [c.packed() for c in self.children]]

    @staticmethod
    def unpacked(x: list) -> "Tree":
        return Tree(x[0], x[1], [Tree.unpacked(c) for c in x[2]])

    def numbered(self) -> list["Tree"]:
        """All nodes in page order; ``slot`` becomes their number."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            node.slot = len(out)
            out.append(node)
            stack.extend(reversed(node.children))
        return out


class Block:
    __slots__ = ("node", "text", "linked", "marks", "articles", "tag")

    def __init__(self, node, text, linked, marks, articles, tag):
        self.node, self.text, self.linked, self.marks, self.articles, self.tag = node, text, linked, marks, articles, tag


def _key(tag: str, attrs: dict) -> str:
    """Element name with the words of class and id; numbers are left out."""
    names = " ".join(x for x in (attrs.get("class"), attrs.get("id")) if x)
    return f"{tag}.{'.'.join(sorted(set(re.sub(r'[0-9]+', '', names).lower().split())))}" if names else tag


def _marked(tag: str, attrs: dict) -> int:
    """0: no mark, 1: marked, 2: marked as a header only."""
    if tag in ("html", "body", "main"):
        return 0                               # what holds the page is no mark
    if tag in MARKED and tag != "header":
        return 1
    found = 2 if tag == "header" else 0
    for name in ("class", "id", "role"):
        value = attrs.get(name)
        if value:
            words = {w.lower() for w in _WORD.findall(value)} & MARK_WORDS
            if words - {"header"}:
                return 1
            if words:
                found = 2
    return found


def read_page(html: str) -> tuple[Tree, list[Block]]:
    """The tree of a page's block elements and its text blocks in page order."""
    root = Tree("#page")
    blocks: list[Block] = []
    text: list[str] = []
    linked = 0
    # open elements: name, node, own mark or None, article or None, silent
    stack: list[tuple] = [("#page", root, None, None, False)]
    marks: tuple = ()
    articles: tuple = ()
    silent = n_marks = n_articles = 0
    is_open: Counter = Counter()

    def push(name, node, mark=None, article=None, quiet=False):
        is_open[name] += 1
        stack.append((name, node, mark, article, quiet))

    def flush():
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                at = next(x for x in reversed(stack) if x[1] is not None)
                blocks.append(Block(at[1], whole, linked, marks, articles, at[0]))
            text.clear()
        linked = 0

    def pop():
        nonlocal marks, articles, silent
        name, node, mark, article, quiet = stack.pop()
        if mark is not None:
            marks = marks[:-1]
        if article is not None:
            articles = articles[:-1]
        silent -= quiet
        is_open[name] -= 1

    def close(names, stop=frozenset()):
        """Closes the innermost open element of ``names``, unless one of ``stop`` is met first."""
        if not any(is_open[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                if any(x[1] is not None for x in stack[k:]):
                    flush()
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in stop:
                return

    for kind, value, attrs in scan(html):
        if kind == OPEN:
            name = value
            if name in INLINE:
                if name == "a" and "href" in attrs and not silent:
                    close(("a",))
                    push("a", None)
                elif name == "span" and (is_open["span"] or attrs and _marked(name, attrs)):
                    mark = None
                    if attrs and _marked(name, attrs):
                        flush()
                        mark = n_marks = n_marks + 1
                        marks += (mark,)
                    push("span", None, mark)
                continue
            if name == "br":
                text.append(" ")
                continue
            if is_open["head"] and name not in OF_HEAD:
                close(("head",))
            if name in CLOSES_P:
                close(("p",), CELLS)
            if name == "li":
                close(("li",), frozenset(["ul", "ol", "menu"]))
            elif name in ("dt", "dd"):
                close(("dt", "dd"), frozenset(["dl"]))
            elif name in ("td", "th"):
                close(("td", "th"), TABLE)
            elif name == "tr":
                close(("tr",), TABLE)
            elif name == "option":
                close(("option",), frozenset(["select"]))
            flush()
            if name in VOID:
                continue
            parent = next(x[1] for x in reversed(stack) if x[1] is not None)
            if len(stack) > DEPTH:
                node = parent
            else:
                key, kids = _key(name, attrs), parent.children
                node = None
                if name in FLOW:
                    node = next((c for c in kids if c.key == key), None)
                elif len(kids) >= RUN and all(c.key == key for c in kids[-RUN:]):
                    node = kids[-1]
                if node is None:
                    node = Tree(key)
                    kids.append(node)
            mark = article = None
            if name in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody":
                n_articles += 1
                article = n_articles
                articles += (article,)
            quiet = name in SILENT or "hidden" in attrs or bool(_HIDDEN.search(attrs.get("style") or ""))
            if not quiet and (how := _marked(name, attrs)):
                n_marks += 1
                # a header inside an article may hold its headline
                mark = -n_marks if how == 2 and articles else n_marks
                marks += (mark,)
            silent += quiet
            push(name, node, mark, article, quiet)
        elif kind == CLOSE:
            if value in ("a", "span") or value not in INLINE:
                close((value,), frozenset() if value == "table" else TABLE if value in ROWS else CELLS)
        elif kind == RAW:
            continue
        elif not silent:
            text.append(value)
            if is_open["a"]:
                linked += len(value.strip())
    flush()
    return root, blocks


def content_blocks(blocks: list[Block]) -> tuple[list[Block], list[bool]]:
    """Blocks outside marked parts, and which of them lie in the article.  A
    mark on most of a page's text is none."""
    total = sum(len(b.text) for b in blocks)
    size: Counter = Counter()
    for b in blocks:
        for m in set(b.marks):
            size[m] += len(b.text)
    kept = []
    for b in blocks:
        marks = [m for m in b.marks if size[m] <= MOST * total]
        if not marks or (b.tag in HEADINGS and all(m < 0 for m in marks)):
            kept.append(b)
    of_article: Counter = Counter()
    for b in kept:
        for a in b.articles:
            of_article[a] += len(b.text)
    chosen = None
    if of_article:
        most = max(of_article.values())
        # inner elements have larger numbers: the innermost that holds half
        chosen = max(a for a, n in of_article.items() if 2 * n >= most)
    return kept, [chosen in b.articles for b in kept]


# -- simple tree matching ------------------------------------------------------

def _matching(a: Tree, b: Tree, memo: dict) -> int:
    """Nodes of the largest order-preserving matching of two trees."""
    if a.key != b.key:
        return 0
    at = (id(a), id(b))
    if at not in memo:
        memo[at] = 1 + (_table(a.children, b.children, memo)[-1][-1] if a.children and b.children else 0)
    return memo[at]


def _table(xs: list[Tree], ys: list[Tree], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        last, row = rows[-1], [0]
        for j, y in enumerate(ys):
            best = last[j + 1] if last[j + 1] > row[j] else row[j]
            if x.key == y.key:
                best = max(best, last[j] + _matching(x, y, memo))
            row.append(best)
        rows.append(row)
    return rows


def pairs_of(xs: list[Tree], ys: list[Tree], memo: dict) -> list[tuple[int, int]]:
    """The matched children of two matched nodes."""
    rows, out = _table(xs, ys, memo), []
    i, j = len(xs), len(ys)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(a: Tree, b: Tree, memo: dict | None = None) -> Tree:
    """One wrapper for two trees with the same root key."""
    memo = {} if memo is None else memo
    out = Tree(a.key, a.pages + b.pages)
    i = j = 0
    for x, y in [*pairs_of(a.children, b.children, memo), (len(a.children), len(b.children))]:
        out.children += a.children[i:x] + b.children[j:y]
        if x < len(a.children):
            out.children.append(merge(a.children[x], b.children[y], memo))
        i, j = x + 1, y + 1
    return out


def without_rare(t: Tree, pages: int) -> Tree:
    t.children = [without_rare(c, pages) for c in t.children if c.pages * RARE >= pages]
    return t


def aligned(page: Tree, wrapper: Tree) -> dict[int, int]:
    """Slot by node of the page; a node without a match has that of the node above."""
    memo: dict = {}
    out = {id(page): wrapper.slot}
    stack: list[tuple[Tree, Tree, bool]] = [(page, wrapper, True)]
    while stack:
        x, w, exact = stack.pop()
        match = dict(pairs_of(x.children, w.children, memo)) if exact else {}
        for k, c in enumerate(x.children):
            hit = match.get(k)
            to = w if hit is None else w.children[hit]
            out[id(c)] = to.slot
            stack.append((c, to, hit is not None))
    return out


# -- the steps in Spark ----------------------------------------------------------

def host_of(url) -> F.Column:
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def _trees(batches):
    for batch in batches:
        count = Counter(zip(batch.column("host").to_pylist(),
                            (json.dumps(read_page(h.as_py() or "")[0].packed(), separators=(",", ":"))
                             for h in batch.column("html"))))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in count], pa.string()),
                                          pa.array([t for _, t in count], pa.string()),
                                          pa.array(list(count.values()), pa.int64())], ["host", "tree", "pages"])


def _with_pages(tree: list, pages: int) -> Tree:
    t = Tree.unpacked(tree)
    for node in t.numbered():
        node.pages *= pages
    return t


def _merge_part(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["tree"].to_pylist(), table["weight"].to_pylist()), key=lambda r: (-r[1], r[0]))
    whole = None
    for tree, weight in rows:
        t = _with_pages(json.loads(tree), weight)
        whole = t if whole is None else merge(whole, t)
    whole = without_rare(whole, whole.pages)
    return pa.table({"host": pa.array([table["host"][0].as_py()], pa.string()),
                     "tree": pa.array([json.dumps(whole.packed(), separators=(",", ":"))], pa.string())})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, tree): the wrapper of each host of ``pages`` (host, html)."""
    trees = pages.select("host", "html").mapInArrow(_trees, "host string, tree string, pages long")
    trees = trees.groupBy("host", "tree").agg(F.sum("pages").alias("weight"))
    trees = stored(trees, "trees")
    while True:
        of_host = trees.groupBy("host").agg(F.count("*").alias("_n"))
        most = of_host.agg(F.max("_n").alias("m")).first().m or 0
        # parts by hash: a host's trees are dealt, whatever their number
        parts = F.ceil(F.col("_n") / PART).cast("int")
        trees = (trees.join(of_host, "host")
                 .withColumn("part", F.pmod(F.xxhash64("tree"), parts))
                 .select("host", "tree", "weight", "part").groupBy("host", "part")
                 .applyInArrow(_merge_part, "host string, tree string"))
        if most <= PART:
            return stored(trees, "wrappers")
        # the trees of a merged wrapper are counted in it
        trees = stored(trees.withColumn("weight", F.lit(1).cast("long")), "trees")


BLOCKS = "array<struct<slot:int,chars:int,linked:int,article:boolean,text:string>>"


def _blocks(keep: list[str]):
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("chars", pa.int32()), ("linked", pa.int32()),
                               ("article", pa.bool_()), ("text", pa.string())]))

    def run(batches):
        known: dict[str, Tree] = {}
        for batch in batches:
            if len(known) > 1_000:
                known.clear()
            rows = []
            for html, tree in zip(batch.column("html"), batch.column("tree")):
                wrapper = known.get(tree := tree.as_py())
                if wrapper is None:
                    wrapper = known[tree] = Tree.unpacked(json.loads(tree))
                    wrapper.numbered()
                root, blocks = read_page(html.as_py() or "")
                slots = aligned(root, wrapper)
                kept, article = content_blocks(blocks)
                rows.append([{"slot": slots[id(b.node)], "chars": len(b.text), "linked": b.linked,
                              "article": a, "text": b.text} for b, a in zip(kept, article)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, kind)],
                                             [*keep, "blocks"])
    return run


def by_host(pages: DataFrame, of_host: DataFrame, n_bytes: int) -> DataFrame:
    """``pages`` joined with the one row of their host."""
    if n_bytes <= BROADCAST_BYTES:
        return pages.join(F.broadcast(of_host), "host")
    salts = pages.groupBy("host").agg(F.ceil(F.count("*") / SALT_PAGES).cast("int").alias("_salts"))
    spread = of_host.join(salts, "host").withColumn("_salt", F.explode(F.sequence(F.lit(1), "_salts")))
    dealt = pages.join(salts, "host").withColumn(
        "_salt", (F.floor(F.rand(7) * F.col("_salts")) + 1).cast("int")).drop("_salts")
    return dealt.join(spread.drop("_salts"), ["host", "_salt"]).drop("_salt")


def _regions(batches):
    """Per host: slots of the content region and whether its template counts."""
    for batch in batches:
        out = []
        for host, tree, stats in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "stats"))):
            root = Tree.unpacked(json.loads(tree))
            nodes = root.numbered()
            all_, same = [0.0] * len(nodes), [0.0] * len(nodes)
            for s in stats or []:
                all_[s["slot"]], same[s["slot"]] = float(s["chars"]), float(s["constant"])
            region, templated = _region(nodes, all_, same), True
            if 3 * sum(same[k] for k in region) > sum(all_[k] for k in region):
                region, templated = _region(nodes, all_, [0.0] * len(nodes)), False
            out.append((host, region, templated))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.list_(pa.int32())),
             pa.array([r[2] for r in out], pa.bool_())], ["host", "region", "templated"])


def _region(nodes: list[Tree], all_: list[float], same: list[float]) -> list[int]:
    """From the root to the child that holds more than 60 % of the varying
    text, down to an article or a node whose text is spread; its slots and the
    headline above it."""
    weight = [a - s for a, s in zip(all_, same)]
    end = [0] * len(nodes)
    for node in reversed(nodes):                     # children have larger numbers
        end[node.slot] = end[node.children[-1].slot] if node.children else node.slot + 1
    before = [0.0]
    for w in weight:
        before.append(before[-1] + w)

    def held(node):
        return before[end[node.slot]] - before[node.slot]

    at, extra = nodes[0], []
    while at.key.split(".")[0] not in ("article", "main"):
        below = [c for c in at.children if c.key.split(".")[0] not in FLOW]
        best = max(below, key=held, default=None)
        if best is None or held(best) <= 0.6 * held(at):
            break
        extra += [c.slot for c in at.children if c.key.split(".")[0] in ("h1", "h2") and c.slot < best.slot]
        at = best
    return sorted({*extra, *range(at.slot, end[at.slot])})


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, url, text): the main text of every row of ``pages``."""
    source = pages.select(*[F.col(c) for c in keep], F.col(url).alias("url"), F.col(html).alias("html"),
                          host_of(F.col(url)).alias("host"))
    wrapper = wrappers(source)
    n_bytes = wrapper.agg(F.sum(F.octet_length("tree") + F.octet_length("host") + 64)).first()[0] or 0
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("html").schema)
    names = [f.name for f in source.drop("html").schema]
    read = by_host(source, wrapper, n_bytes).mapInArrow(_blocks(names), f"{kinds}, blocks {BLOCKS}")
    read = stored(read, "blocks")

    # texts of a slot by page; equal pages count once
    small = F.transform("blocks", lambda b: F.struct(
        b.slot.alias("slot"), (b.chars - F.least(b.linked, b.chars)).alias("plain"), F.xxhash64(b.text).alias("value")))
    one = read.select("host", F.xxhash64(F.array_join("blocks.text", "\n")).alias("page"), small.alias("blocks"))
    seen = one.dropDuplicates(["host", "page"]).select("host", "page", F.inline("blocks"))
    values = seen.groupBy("host", "slot", "value").agg(
        F.count_distinct("page").alias("n"), F.sum("plain").alias("plain"))
    slots = seen.groupBy("host", "slot").agg(F.count_distinct("page").alias("n_slot"))
    values = values.join(slots, ["host", "slot"]).withColumn(
        "constant", (F.col("n_slot") >= MIN_PAGES) & (F.col("n") >= CONSTANT * F.col("n_slot")))
    values = stored(values.select("host", "slot", "value", "plain", "constant"), "values")
    per_slot = values.groupBy("host", "slot").agg(
        F.sum("plain").alias("chars"),
        F.coalesce(F.sum(F.when(F.col("constant"), F.col("plain"))), F.lit(0)).alias("constant"))
    stats = per_slot.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "constant")).alias("stats"))
    regions = wrapper.join(stats, "host", "left").mapInArrow(
        _regions, "host string, region array<int>, templated boolean")
    fixed = values.filter("constant").groupBy("host").agg(F.collect_list(F.struct("slot", "value")).alias("fixed"))
    of_host = stored(regions.join(fixed, "host", "left").select(
        "host", "region", F.when(F.col("templated"), F.col("fixed")).alias("fixed")), "regions")
    n_bytes = of_host.agg(F.sum(F.lit(64) + 4 * F.size("region") + 16 * F.coalesce(
        F.size("fixed"), F.lit(0)))).first()[0] or 0

    def varying(b):
        fixed = F.coalesce(F.col("fixed"), F.array().cast("array<struct<slot:int,value:bigint>>"))
        return ~F.array_contains(fixed, F.struct(b.slot.alias("slot"), F.xxhash64(b.text).alias("value")))

    in_region = lambda b: F.array_contains("region", b.slot)
    own = F.filter("blocks", lambda b: b.article & varying(b))
    ways = {"a": F.filter(own, in_region), "b": own,
            "c": F.filter("blocks", lambda b: in_region(b) & varying(b) & (10 * b.linked < 6 * b.chars)),
            "d": F.filter("blocks", varying)}
    text = F.lit("")
    for way in reversed(ways.values()):
        text = F.when(F.size(way) > 0, F.array_join(F.transform(way, lambda b: b.text), " ")).otherwise(text)
    return by_host(read, of_host, n_bytes).select(*keep, "url", text.alias("text"))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read_table(spark, sf_dir, "pages"), keep=("page_id",))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
