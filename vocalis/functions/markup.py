"""One-pass scanner of HTML: text, start tags and end tags in page order.

A small state machine.  Every character is looked at a bounded number of
times, whatever is left open: an unclosed comment, attribute value or raw-text
element ends with the page, as in a browser.  Comments, declarations and
processing instructions are left out, quoted values may hold ``>``, and the
content of raw-text elements is never read as tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

__all__ = ["CLOSE", "OPEN", "RAW", "TEXT", "VOID", "CLOSES_P", "scan", "unescape"]

TEXT, OPEN, CLOSE, RAW = 0, 1, 2, 3

# fixed values: element names of the HTML standard
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                  "param", "source", "track", "wbr"])
CLOSES_P = frozenset(["address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer",
                      "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav",
                      "ol", "p", "pre", "section", "table", "ul"])
RAW_TEXT = ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title")
#: raw-text elements whose character references count
ESCAPABLE = frozenset(["textarea", "title"])

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
_GAP = re.compile(r"[\s/]*")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT}


def _attributes(html: str, i: int) -> tuple[dict[str, str], int]:
    """Attributes from ``i`` on and the place behind the tag's ``>``; -1 if
    the page ends inside the tag.  The first of equal names counts."""
    found: dict[str, str] = {}
    n = len(html)
    while True:
        i = _GAP.match(html, i).end()
        if i >= n:
            return found, -1
        if html[i] == ">":
            return found, i + 1
        m = _ATTR.match(html, i)
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        i = m.end()
        if value is None and "=" in m[0] and html.startswith(('"', "'"), i):
            return found, -1                      # a quote that nothing closes
        found.setdefault(m[1].lower(), unescape(value) if value and "&" in value else value or "")


def scan(html: str) -> Iterator[tuple[int, str, dict | None]]:
    """(TEXT, text, None), (RAW, text, None) for the content of a raw-text
    element, (OPEN, name, attributes) and (CLOSE, name, None)."""
    i, start, n = 0, 0, len(html)
    while True:
        at = html.find("<", i)
        if at < 0 or at + 1 >= n:
            break
        c = html[at + 1]
        if not (c.isascii() and c.isalpha()) and c not in "/!?":
            i = at + 1
            continue
        if c == "/" and at + 2 >= n:
            break
        if at > start:
            yield TEXT, unescape(html[start:at]) if "&" in (t := html[start:at]) else t, None
        if c == "/":
            m = _NAME.match(html, at + 2)
            if m is None:                          # a comment by mistake
                end = html.find(">", at + 2)
            else:
                _, end = _attributes(html, m.end())
                end -= 1
            if end < 0:
                return
            if m is not None:
                yield CLOSE, m[0].lower(), None
            i = start = end + 1
        elif c in "!?":
            if html.startswith("<!--", at):
                if html.startswith((">", "->"), at + 4):
                    end = html.find(">", at + 4)
                else:
                    end = html.find("-->", at + 4)
                    odd = html.find("--!>", at + 4, end if end >= 0 else n)
                    end = odd + 3 if odd >= 0 else end + 2 if end >= 0 else -1
            else:
                end = html.find(">", at + 2)
            if end < 0:
                return
            i = start = end + 1
        else:
            m = _NAME.match(html, at + 1)
            name = m[0].lower()
            attrs, end = _attributes(html, m.end())
            if end < 0:
                return
            yield OPEN, name, attrs
            i = start = end
            if name in _END_OF:
                stop = _END_OF[name].search(html, end)
                to = stop.start() if stop else n
                if to > end:
                    body = html[end:to]
                    yield RAW, unescape(body) if name in ESCAPABLE else body, None
                i = start = to
    if start < n:
        yield TEXT, unescape(html[start:]) if "&" in (t := html[start:]) else t, None
