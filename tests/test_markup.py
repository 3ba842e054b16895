import time

import pytest

from vocalis.functions.markup import CLOSE, OPEN, RAW, TEXT, scan


@pytest.mark.parametrize("html, tokens", [
    ('<a title="a>b" href="/3/c">x</a>', [(OPEN, "a", {"title": "a>b", "href": "/3/c"}), (TEXT, "x", None), (CLOSE, "a", None)]),
    ("<p>x<!-- <a href=1>c</a> -->y", [(OPEN, "p", {}), (TEXT, "x", None), (TEXT, "y", None)]),
    ("<!-->z<!--->w", [(TEXT, "z", None), (TEXT, "w", None)]),
    ('<SCRIPT>t="</p>";</Script >q', [(OPEN, "script", {}), (RAW, 't="</p>";', None), (CLOSE, "script", None), (TEXT, "q", None)]),
    ("<title>a<b>&amp;</title>", [(OPEN, "title", {}), (RAW, "a<b>&", None), (CLOSE, "title", None)]),
    ("<a B='1' c=2 d b=3/>t</a >", [(OPEN, "a", {"b": "1", "c": "2", "d": ""}), (TEXT, "t", None), (CLOSE, "a", None)]),
    ("1 < 2 &amp; &#38;lt; <3", [(TEXT, "1 < 2 & &lt; <3", None)]),
    ('<a href="x?a=1&amp;b=&#9999999;">', [(OPEN, "a", {"href": "x?a=1&b=�"})]),
    ('<b>k</b><a href="x>un', [(OPEN, "b", {}), (TEXT, "k", None), (CLOSE, "b", None)]),
    ("x<!-- open", [(TEXT, "x", None)]),
    ("<!DOCTYPE html><?pi x?>x</", [(TEXT, "x</", None)]),
    ("", []),
])
def test_tokens(html, tokens):
    assert list(scan(html)) == tokens


@pytest.mark.parametrize("part", ["<a ", "<!--", '<a href="', "<script>", "</", "<", "&#", '<a href="x">one ', "<a b='\"", "<a b="])
def test_time_follows_the_length(part):
    def seconds(n):
        began = time.process_time()
        for _ in scan(part * n):
            pass
        return time.process_time() - began
    assert seconds(160_000) < 40 * max(seconds(10_000), 0.02)
