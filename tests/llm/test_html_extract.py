import html as references
import itertools
import random
import time

import pytest

from tests.llm import cases
from vocalis.llm import html_extract as X

HOSTS = ("news.example.com", "plain.example.org", "old.example.net")


def article(rng, k):
    """Headline and paragraphs of page k; every third page ends with a line that others share."""
    paragraphs = [cases.sentence(rng, rng.randrange(12, 60), 900) for _ in range(rng.randrange(2, 7))]
    if k % 3 == 0:
        paragraphs.append("All rights reserved & licensed.")
    return cases.sentence(rng, 6, 900), paragraphs


def news(rng, k, head, paragraphs):
    """Named parts around an article, reader comments inside it."""
    menu = "".join(f"<li><a href='/{w}'>{w}</a>" for w in cases.sentence(rng, 5).split())
    body = "".join(f"<p>{references.escape(p)}" + ("</p>" if i % 2 else "") for i, p in enumerate(paragraphs))
    return (f"<!doctype html><html><head><title>{head}</title><style>p{{}}</style></head><body class='with-sidebar'>"
            f"<header><a href='/'>The News</a></header><nav><ul>{menu}</ul></nav>"
            f"<div id='cookie-consent'>We use cookies.</div><article><header><h1>{head}</h1><i>by {rng.random()}</i></header>"
            f"{body}<div class='ad'>{cases.sentence(rng, 9)}</div><form><input>Your mail <button>Go</button></form>"
            f"<section class='comments'><h2>Comments</h2><p>{cases.sentence(rng, 15)}</p></section></article>"
            f"<aside><p>{cases.sentence(rng, 10)}</p></aside><footer>&copy; {k}</footer><script>x='</p>'</script>")


def plain(rng, k, head, paragraphs):
    """No name says what is what: template by alignment alone."""
    links = "".join(f"<div><a href='#'>{w}</a></div>" for w in cases.sentence(rng, 4).split())
    body = "".join(f"<div class='t{k}'>{references.escape(p)}</div>" for p in paragraphs)
    return (f"<html><body><div class='a1'>Plain daily, since 1999</div><div class='b2'>{links}</div>"
            f"<div class='c3'><div class='d4'>Read our terms of use</div><h1>{head}</h1><div class='e5'>{body}"
            f"<div class='z'>Thank you for reading this page.</div></div></div><div class='f6'>Printed in the town of Nowhere</div>")


def old(rng, k, head, paragraphs):
    """Tables for layout, with end tags left out."""
    body = "<br>".join(references.escape(p) for p in paragraphs)
    return (f"<table><tr><td><a href=/>Home</a><td><h1>{head}</h1><p>{body}</table>"
            f"<table><tr><td>Webmaster: mail us</td></tr></table>")


def site():
    rng = random.Random(4)
    out = []
    for k, (host, make) in itertools.product(range(24), zip(HOSTS, (news, plain, old))):
        head, paragraphs = article(rng, k)
        out.append((len(out), f"https://{host}/{k}.html", make(rng, k, head, paragraphs),
                    " ".join(" ".join([head, *paragraphs]).split())))
    return out


def frame(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")


def texts(df):
    return {r.page_id: r.text for r in X.extract(df, keep=("page_id",)).collect()}


@pytest.mark.parametrize("part, broadcast", [(64, 16 << 20), (3, 0)])
def test_articles_of_three_layouts(spark, monkeypatch, part, broadcast):
    monkeypatch.setattr(X, "PART", part)
    monkeypatch.setattr(X, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(X, "SALT_PAGES", 7)
    rows = site()
    got = texts(cases.clashing(frame(spark, rows)).withColumn("host", X.F.lit(1)).repartition(5))
    for k, url, _, text in rows:
        assert got[k] == text, url


def test_copies_and_shared_lines_stay(spark):
    rng = random.Random(8)
    same = [cases.sentence(rng, 30) for _ in range(4)]
    rows = [(k, "http://copies.example.com/x", news(rng, 0, "One head", [*same, f"Edition {k}."]),
             " ".join(["One head", *same, f"Edition {k}."])) for k in range(12)]
    exact = news(rng, 1, "Same", same)
    rows += [(100 + k, "http://equal.example.com/", exact, " ".join(["Same", *same])) for k in range(12)]
    got = texts(frame(spark, rows))
    assert all(got[k] == text for k, _, _, text in rows)


def test_odd_rows(spark, tmp_path):
    deep = "<div>" * 3_000 + "<p>deep text</p>"
    rows = [(1, None, "<p>no url</p>"), (2, "not a url", "<p>a&nbsp;b &eacute;&#233;&#x41; &am</p>"), (3, "http://a/", None),
            (4, "http://a/", ""), (5, "http://a/", "   "), (6, "http://a/", "<!-- only -->"), (None, None, None),
            (7, "http://a/", "just text"), (7, "http://a/", "just text"), (8, "http://b/", deep),
            (9, "http://b/", "<p>" + "word " * 200_000), (10, "http://b/", "<a <a <a"), (11, "http://c", "x<br>y<b>z</b>w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    cases.clashing(df).write.parquet(f"{tmp_path}/pages.parquet")
    out = X.op11_html_extract(spark, str(tmp_path))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    got = sorted(((r.page_id, r.text) for r in out.collect() if r.page_id not in (None, 9)), key=repr)
    assert got == sorted([(1, "no url"), (2, "a b ééA &am"), (3, ""), (4, ""), (5, ""), (6, ""), (7, "just text"),
                          (7, "just text"), (8, "deep text"), (10, ""), (11, "x yzw")], key=repr)
    assert out.count() == len(rows) and out.filter("page_id = 9").first().n_chars == 5 * 200_000 - 1
    assert out.filter("page_id is null").first().text == ""
    assert X.extract(df.filter("page_id > 99")).count() == 0


def best_by_hand(a, b):
    """Largest matching by trying every order-preserving set of child pairs."""
    if a.key != b.key:
        return 0
    best = 0
    n = min(len(a.children), len(b.children))
    for size in range(1, n + 1):
        for xs in itertools.combinations(a.children, size):
            for ys in itertools.combinations(b.children, size):
                parts = [best_by_hand(x, y) for x, y in zip(xs, ys)]
                if all(parts):
                    best = max(best, sum(parts))
    return 1 + best


def random_tree(rng, depth=3):
    return X.Tree(rng.choice("ab"), 1, [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else [])


def test_simple_tree_matching_is_the_largest_matching():
    rng = random.Random(6)
    for _ in range(150):
        a, b = X.Tree("r", 1, [random_tree(rng) for _ in range(2)]), X.Tree("r", 1, [random_tree(rng) for _ in range(3)])
        best = X._matching(a, b, {})
        assert best == best_by_hand(a, b)
        both = X.merge(a, b)
        size = [len(t.numbered()) for t in (a, b, both)]
        assert size[2] == size[0] + size[1] - best
        assert sum(n.pages == 2 for n in both.numbered()) == best
        slots = X.aligned(a, both)
        assert len(set(slots.values())) == size[0]             # every node of a has its own slot


def test_time_follows_the_page():
    def seconds(n):
        began = time.process_time()
        X.read_page("<div><p><b><a href=x>one</a> two" * n)
        X.read_page("<ul>" + "<li><span class=ad>x" * n)
        return time.process_time() - began
    assert seconds(24_000) < 25 * max(seconds(3_000), 0.05)
