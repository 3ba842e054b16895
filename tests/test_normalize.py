"""Landed payloads -> posts (HTML forum pages, submissions, comments, tweets,
page posts) and link extraction."""

import time

import pytest
from pyspark.sql import functions as F

from helpers import EP
from vocalis.operators import normalize as N
from vocalis.operators.html_posts import parse_links, parse_posts

P = EP.with_(as_of="2025-02-20", months=12)

THREAD = """<html><body><table>
<tr><td><a class="user" href="/u/a">Alice</a> <span class="s">1:01pmOnFeb 12</span></td></tr>
<tr><td><div class="narrow">Babajide Sanwo-Olu is the Lagos governor <b>again</b>
<span class="likes">12 Likes</span></div></td></tr>
<tr><td><div class="narrow">short</div></td></tr>
</table>
<script>var t = "<div class='narrow'>not a post</div>";</script>
<div class="narrow">A post without author and without date here</div>
</body></html>"""


def test_parse_posts_tree():
    got = list(parse_posts(THREAD))
    assert len(got) == 3
    k, text, author, date, likes = got[0]
    assert author == "Alice" and date == "1:01pmOnFeb 12" and likes == "12 Likes"
    assert text.startswith("Babajide Sanwo-Olu is the Lagos governor again")
    assert got[2][2] is None and got[2][3] is None


def test_unclosed_p_and_script():
    html = '<script>var t="</p>";</script><p>one <b>x</b><p>two</p>'
    assert [t for _, t, *_ in parse_posts(html, "p", None)] == ["one x", "two"]


def test_forum_posts(spark):
    pages = spark.createDataFrame([(1, "https://forum.example/123/thread", THREAD)],
                                  "page_id long, url string, html string")
    rows = N.forum_posts(pages, "Lagos", P).orderBy("post_id").collect()
    assert len(rows) == 2                       # "short" is under 20 characters
    r = rows[0]
    assert r["likes"] == 12 and r["shares"] == 0 and r["author"] != "anonymous"
    assert r["date"] == "2025-02-12 13:01:00" and r["keyword"] == "Lagos governorship election"
    assert rows[1]["author"] == "anonymous" and rows[1]["date"] is None


def test_submissions_and_comments(spark):
    subs = spark.createDataFrame(
        [(1, "Who will be governor", "Long body text", "u1", 1739000000, 7, 3, "/r/x/1"),
         (2, "Old thread title that is long", "", "u2", 1600000000, 1, 0, "/r/x/2")],
        N.SUBMISSION_SCHEMA)
    rows = N.submission_posts(subs, "Lagos", "kw", P).collect()
    assert [(r["text"], r["likes"], r["shares"]) for r in rows] == \
        [("Who will be governor Long body text", 7, 3)]
    com = spark.createDataFrame(
        [(1, i, 100 + i, f"comment number {i} is long enough", "c", 1739000000, i, f"/r/x/1/{i}")
         for i in range(12)], N.COMMENT_SCHEMA)
    out = N.comment_posts(com, "Lagos", "kw", P, max_comments=10)
    assert out.count() == 10


def test_tweets_nested(spark):
    tw = spark.createDataFrame([(5, "Governor race heats up in Lagos", "2025-02-01T10:00:00.000Z", 9, "en", None,
                                 {"like_count": 4, "retweet_count": 2, "reply_count": 0, "quote_count": 0}),
                                (6, "Tweet without a date but long", None, 9, None, None, None)], N.TWEET_SCHEMA)
    rows = {r["post_id"]: r for r in N.tweet_posts(tw, "Lagos", "kw", P).collect()}
    assert rows[5]["likes"] == 4 and rows[5]["shares"] == 2
    assert rows[6]["likes"] == 0 and rows[6]["date"] == ""


def test_page_posts_and_comments(spark):
    g = spark.createDataFrame([("p1", "A page post about the governor", "2025-02-01T10:00:00+0000",
                                {"name": None, "id": "u9"}, None, {"count": 3})], N.PAGE_POST_SCHEMA)
    r = N.page_posts(g, "Lagos", "kw", P).first()
    assert r["likes"] == 0 and r["shares"] == 3 and r["date"] == "2025-02-01 10:00:00"
    c = spark.createDataFrame([("p1", i, f"c{i}", f"comment {i} ok", None, None, "u", i) for i in range(25)],
                              N.PAGE_COMMENT_SCHEMA)
    assert N.page_comment_posts(c, "Lagos", "kw", P).count() == 20


def test_links_and_thread_urls(spark):
    html = ('<a href="/123/lagos-governor">Lagos Governor Race</a><a href="">x</a>'
            '<a href="https://forum.example/45">Kano</a><a href="/topics">Topics</a>'
            '<a href="/123/lagos-governor">again</a>')
    pages = spark.createDataFrame([(1, "https://forum.example/board", html)], "page_id long, url string, html string")
    links = N.absolute_links(N.page_links(pages))
    rows = [(r["abs_url"], r["title"], r["is_thread"]) for r in links.orderBy("ord").collect()]
    assert rows[0] == ("https://forum.example/123/lagos-governor", "lagos governor race", True)
    assert rows[1] == ("https://forum.example/45", "kano", True)
    assert rows[2][2] is False
    assert N.distinct_links(links).count() == 3
    t = pages.select(N.relevant_title(F.lit("lagos governor race"), F.lit("Lagos"), ["governor"]).alias("r"))
    assert t.first()["r"]


def test_keyword_expansion_and_majority(spark):
    scopes = spark.createDataFrame([("Lagos",)], "scope string")
    kws = [r["keyword"] for r in N.expand_keywords(scopes, ["{state} governor", "x {state}"]).orderBy("ordinal").collect()]
    assert kws == ["Lagos governor", "x Lagos"]
    posts = spark.createDataFrame([(1, "the lagos governor election 2027 race"), (2, "lagos governor 2027"),
                                   (3, "nothing")], "post_id long, text string")
    got = N.first_matching_keyword(posts, ["Lagos governorship election", "Lagos governor 2027"]).collect()
    # post 1: 2 of 3 terms of the first template suffice (first in template order wins)
    assert sorted((r["post_id"], r["matched_keyword"]) for r in got) == \
        [(1, "Lagos governorship election"), (2, "Lagos governor 2027")]


def test_tally_and_first_seen(spark):
    posts = spark.createDataFrame([("t", "L"), ("t", "L"), ("r", "K")], "platform string, scope string")
    rows = {(r["platform"], r["scope"]): r["posts"] for r in N.run_tally(posts).collect()}
    assert rows[("t", "L")] == 2 and rows[(None, None)] == 3
    ids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "id long, ordinal long, keyword string")
    got = {r["id"]: r["keyword"] for r in N.first_seen(ids, ["id"], ["ordinal"]).collect()}
    assert got == {1: "a", 2: "c"}


def test_page_posts_keyword_majority(spark):
    rows = [("p1", "The Lagos governorship race is heating up now", "2025-02-01T10:00:00+0000",
             {"name": "a", "id": "1"}, None, None),
            ("p2", "Nothing relevant in this page post at all here", "2025-02-01T10:00:00+0000",
             {"name": "b", "id": "2"}, None, None)]
    g = spark.createDataFrame(rows, N.PAGE_POST_SCHEMA)
    out = N.page_posts(g, "Lagos", None, P, templates=["{state} governorship election",
                                                        "{state} governor 2027"]).collect()
    assert [(r["url"], r["keyword"]) for r in out] == [("https://facebook.com/p1", "Lagos governorship election")]


def test_collect_search_hits(spark):
    rows = []
    for kw in range(3):                                  # 3 keywords x 4 results, ids overlap
        for rank in range(4):
            rows.append(("twitter", "Lagos", kw, rank, (kw + rank) % 6))
    hits = spark.createDataFrame(rows, "platform string, scope string, keyword_ordinal int, "
                                       "hit_rank int, id long")
    got = N.collect_search_hits(hits, range(3), per_keyword_cap=2, total_cap=5).orderBy(
        "keyword_ordinal", "hit_rank").collect()
    # keyword 0 takes ids 0, 1 (2, 3 are cut, so still free); keyword 1 skips
    # id 1 and takes 2, 3; keyword 2 skips 2, 3 and takes 4 (5 is over the total cap)
    assert [(r["keyword_ordinal"], r["id"]) for r in got] == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)]


def test_collect_search_hits_repeated_id_within_keyword(spark):
    rows = [("t", "L", 0, 0, 7), ("t", "L", 0, 1, 7), ("t", "L", 0, 2, 8), ("t", "L", 1, 0, 8),
            ("t", "L", 1, 1, 9)]
    hits = spark.createDataFrame(rows, "platform string, scope string, keyword_ordinal int, "
                                       "hit_rank int, id long")
    got = N.collect_search_hits(hits, [0, 1], per_keyword_cap=2, total_cap=10).orderBy(
        "keyword_ordinal", "hit_rank").collect()
    assert [(r["keyword_ordinal"], r["id"]) for r in got] == [(0, 7), (0, 8), (1, 9)]


def test_link_forms_and_entities(spark):
    html = ("<a href='/12/t'>One</a><a class=x href=/13/u?a=1&amp;b=2>Two</a>"
            '<a href="/14/v?q=&#39;&#x263A;&lt;&amp;amp;">Three</a><a name="x">no</a>')
    pages = spark.createDataFrame([(1, "https://f.example/", html)], "page_id long, url string, html string")
    got = [(r.href, r.title) for r in N.page_links(pages).orderBy("ord").collect()]
    assert got == [("/12/t", "one"), ("/13/u?a=1&b=2", "two"), ("/14/v?q='\u263a<&amp;", "three")]


def test_pair_ids_are_unique(spark):
    df = spark.range(40).selectExpr("id a").crossJoin(spark.range(40).selectExpr("id b"))
    assert df.select(N.pair_id("a", "b").alias("i")).distinct().count() == 1600


def test_reposts_and_other_languages_are_left_out(spark):
    rows = [(1, "an original tweet about it", None, 1, "en", None), (2, "a repost of this one", None, 1, "en", [("retweeted", 5)]),
            (3, "ein deutscher Beitrag hier", None, 1, "de", None), (4, "quoting another tweet now", None, 1, None, [("quoted", 5)])]
    df = spark.createDataFrame(rows, "id long, text string, created_at string, author_id long, lang string, "
                               "referenced_tweets array<struct<type:string,id:long>>")
    assert sorted(r.id for r in N.original_tweets(df).collect()) == [1, 4]
    assert sorted(r.id for r in N.original_tweets(df, None).collect()) == [1, 3, 4]


def test_search_scans_grow_with_the_keywords(spark):
    """Each step reads the stored hits and the stored steps before it."""
    hits = spark.createDataFrame([("p", "s", i % 7, i, i) for i in range(60)],
                                 "platform string, scope string, keyword_ordinal int, id long, hit_rank int")
    scans = []
    for k in (3, 7):
        plan = N.collect_search_hits(hits, range(k), 5, 100)._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("LogicalRDD") + plan.count("LocalRelation"))
    assert scans == [3, 7]


@pytest.mark.parametrize("html, links", [
    ('<a href="/1/a?x=&#9999999;">k</a>', [("/1/a?x=\ufffd", "k")]),
    ('<a href="/1/a?x=&#38;lt;">k</a>', [("/1/a?x=&lt;", "k")]),
    ('<!-- <a href="/2/b">gone</a> --><a href="/2/c">K<b> l</b></a>', [("/2/c", "kl")]),
    ('<a title="a>b" href="/3/c">k</a>', [("/3/c", "k")]),
    ('<a href="/4/d">one <a href="/5/e">two</a>', [("/4/d", "one"), ("/5/e", "two")]),
    ('<ul><li><a href=/6>six</li><li>no</ul><p><a href=/7>seven</p>no', [("/6", "six"), ("/7", "seven")]),
    ('<a href=/8><div>eight</div> more</a><a href="">x</a><a href=/9> </a><a name=n>n</a>', [("/8", "eightmore")]),
    ("", []), (None, []),
])
def test_links_as_a_parser_sees_them(html, links):
    assert [(h, t) for _, h, t in parse_links(html) if h and t] == links


@pytest.mark.parametrize("page", ['<a href="/1/x">one ' * 100_000, "<a href=/1>" + "<div>" * 100_000, "<a " * 100_000])
def test_unclosed_links_take_time_in_proportion(page):
    began = time.process_time()
    assert sum(1 for _ in parse_links(page)) in (0, 1, 100_000)
    assert time.process_time() - began < 4


def test_twenty_thousand_posts_in_one_table():
    post = '<tr><td><div class="narrow">post {0}<span class="likes">{0} Likes</span></div></td></tr>'
    page = '<table><tr><td><a class="user">ann</a> <span class="s">9:00am</span></td></tr>' + "".join(
        post.format(i) for i in range(20_000)) + "</table>"
    began = time.process_time()
    got = list(parse_posts(page))
    assert time.process_time() - began < 5
    assert got[7] == (7, "post 7 7 Likes", "ann", "9:00am", "7 Likes") and len(got) == 20_000


def test_author_and_date_come_from_the_cell_then_the_table():
    page = ('<table><tr><td><div class=narrow>a</div><td><span class=s>d1</span><a class="x user">u1</a>'
            '<div class=narrow>b<div class=narrow>c<span class=likes>3</span></div></div>'
            '<table><tr><td><a class=user>u2</a></table></table><div class=narrow>d</div>')
    assert list(parse_posts(page)) == [(0, "a", "u1", "d1", None), (1, "b c 3", "u1", "d1", "3"),
                                       (2, "c 3", "u1", "d1", "3"), (3, "d", None, None, None)]


def test_pair_ids_never_fail(spark):
    rows = [(10**12, 5), (5, 10**12), (-1, 2), (2**62, 2**62), (3 * 10**9, 0), (0, 3 * 10**9), (None, 1)]
    got = [r.i for r in spark.createDataFrame(rows, "a long, b long").select(N.pair_id("a", "b").alias("i")).collect()]
    assert got[-1] is None and len(set(got)) == 7 and all(x < 0 for x in got[:4]) and min(got[4:6]) > 0
