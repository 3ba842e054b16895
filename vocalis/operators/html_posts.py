"""Forum HTML read in one pass: posts of thread pages (UDF-3, NRM-1) and links
of board pages (NRM-7), per page, inside Arrow batches.

Only what Spark cannot express runs in Python: walking the tokens of
``functions.markup.scan`` with a stack of open elements.  No tree is built.
An open table or cell carries the first author link and the first date seen in
it; a post remembers its cell and its table and is resolved when the page
ends.  So a page takes time in proportion to its length, whatever the number
of posts in one table and whatever is left unclosed.  Cleaning, hashing, date
parsing, filters and casts happen afterwards as Spark columns
(``normalize.forum_posts``, ``normalize.page_links``).
"""

from __future__ import annotations

from collections import Counter

from ..functions.markup import CLOSE, CLOSES_P, OPEN, TEXT, VOID, scan

#: an open link ends where one of these begins
ENDS_LINK = frozenset(["a", "fieldset", "table", "td", "th"])


class _Place:
    """First author, date and likes texts inside an element, as (from, to) of
    the page's strings."""

    __slots__ = ("found",)

    def __init__(self):
        self.found = {}

    def pass_to(self, outer: "_Place | None") -> None:
        if outer is not None:
            for what, span in self.found.items():
                outer.found.setdefault(what, span)


def parse_posts(html: str, tag: str = "div", cls: str | None = "narrow"):
    """Yield (ordinal, text, author, date, likes_raw) for each post element:
    author and date are the first ``a.user`` and ``span.s`` of the enclosing
    ``td``, else of the enclosing ``table``, likes the first ``span.likes``
    inside the post.  Any markup is accepted."""
    strings: list[str] = []
    posts: list[list] = []                  # own place, first string, end, td, table
    # open elements: tag, post or None, what it may be the first of
    stack: list[tuple] = []
    tds: list[_Place] = []
    tables: list[_Place] = []
    inner: list[list] = []                  # open posts
    is_open: Counter = Counter()
    open_p = [0]                            # open <p> by enclosing cell or table

    def pop():
        name, post, what = stack.pop()
        is_open[name] -= 1
        if what is not None:
            kind, start = what
            span = (start, len(strings))
            if kind == "likes":
                if inner:
                    inner[-1][0].found.setdefault(kind, span)
            else:
                for places in (tds, tables):
                    if places:
                        places[-1].found.setdefault(kind, span)
        if post is not None:
            post[2] = len(strings)
            inner.pop()
            post[0].pass_to(inner[-1][0] if inner else None)
        if name == "td":
            tds.pop().pass_to(tds[-1] if tds else None)
        elif name == "table":
            tables.pop().pass_to(tables[-1] if tables else None)
        if name in ("td", "table"):
            open_p.pop()
        elif name == "p":
            open_p[-1] -= 1

    def close(name):
        while True:
            last = stack[-1][0]
            pop()
            if last == name:
                return

    for kind, value, attrs in scan(html or ""):
        if kind == TEXT:
            part = value.strip()
            if part:
                strings.append(part)
        elif kind == OPEN:
            if value in CLOSES_P and open_p[-1]:
                close("p")
            if value in VOID:
                continue
            classes = (attrs.get("class") or "").split()
            what = None
            if value == "a" and "user" in classes:
                what = ("user", len(strings))
            elif value == "span" and "s" in classes:
                what = ("date", len(strings))
            elif value == "span" and "likes" in classes:
                what = ("likes", len(strings))
            if value == "td":
                tds.append(_Place())
            elif value == "table":
                tables.append(_Place())
            post = None
            if value == tag and (cls is None or cls in classes):
                post = [_Place(), len(strings), 0, tds[-1] if tds else None, tables[-1] if tables else None]
                posts.append(post)
                inner.append(post)
            if value in ("td", "table"):
                open_p.append(0)
            elif value == "p":
                open_p[-1] += 1
            is_open[value] += 1
            stack.append((value, post, what))
        elif kind == CLOSE and is_open[value]:
            close(value)
    while stack:
        pop()

    def text(span, sep=""):
        return sep.join(strings[span[0]:span[1]])

    for k, (place, start, end, td, table) in enumerate(posts):
        spans = {what: next((p.found[what] for p in (td, table) if p is not None and what in p.found), None)
                 for what in ("user", "date")}
        yield (k, text((start, end), " "),
               None if spans["user"] is None else text(spans["user"]),
               None if spans["date"] is None else text(spans["date"]),
               text(place.found["likes"]) if "likes" in place.found else None)


def parse_links(html: str):
    """Yield (ordinal, href, title) of each ``<a href>``: the title is its
    stripped strings joined, lower-cased.  A link that is not closed ends with
    the element around it, at the next link, table, cell or fieldset, or with
    the page.  Links in comments, scripts and other raw text are none."""
    is_open: Counter = Counter()
    inside: Counter = Counter()
    href, strings, k = None, [], 0

    def title():
        return "".join(strings).lower()

    for kind, value, attrs in scan(html or ""):
        if kind == TEXT:
            if href is not None:
                strings.append(value.strip())
        elif kind == OPEN:
            if href is not None and value in ENDS_LINK:
                yield k, href, title()
                href, k = None, k + 1
                is_open.update(inside)
            if value == "a":
                if "href" in attrs:
                    href, strings, inside = attrs["href"], [], Counter()
            elif value not in VOID:
                (is_open if href is None else inside)[value] += 1
        elif kind == CLOSE:
            if href is not None and inside[value]:
                inside[value] -= 1
            elif href is not None and (value == "a" or is_open[value]):
                yield k, href, title()
                href, k = None, k + 1
                is_open.update(inside)
            if href is None and is_open[value]:
                is_open[value] -= 1
    if href is not None:
        yield k, href, title()


def raw_posts(pages, tag: str = "div", cls: str | None = "narrow"):
    """``(page_id, url, scope, html)`` -> one raw row per post element.

    Batches are Arrow record batches of whole pages; a page is parsed on its
    own, so memory is bounded by the batch size
    (``spark.sql.execution.arrow.maxRecordsPerBatch``), never by a site."""
    return _per_page(pages.select("page_id", "url", "scope", "html"),
                     lambda html: parse_posts(html, tag, cls),
                     "ord int, text_raw string, author_raw string, date_raw string, likes_raw string")


def raw_links(pages, keep: tuple[str, ...] = ()):
    """``(page_id, url, *keep, html)`` -> ``(page_id, url, *keep, ord, href, title)``."""
    return _per_page(pages.select("page_id", "url", *keep, "html"), parse_links,
                     "ord int, href string, title string")


def _per_page(pages, parse, found: str):
    """Rows of ``parse(html)`` next to the page's other columns."""
    import pyarrow as pa

    keep = [f for f in pages.schema if f.name != "html"]
    names, kinds = zip(*(x.split() for x in found.split(", ")))
    kinds = [pa.int32() if k == "int" else pa.string() for k in kinds]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, html in enumerate(batch.column("html")):
                for row in parse(html.as_py()):
                    at.append(i)
                    rows.append(row)
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name).take(pa.array(at, pa.int64())) for f in keep),
                 *(pa.array(c, k) for c, k in zip(columns, kinds))], [*(f.name for f in keep), *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return pages.mapInArrow(run, f"{kept}, {found}")
