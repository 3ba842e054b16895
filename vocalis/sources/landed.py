"""Landed platform payloads derived from the driver tables.

The original collects payloads over the network; here each platform's
payload shape is re-created from a driver table so the normalizers run on
data that grows with the tables:

* submissions / comments  <- ``conversations`` (turn 0 / turns >= 1)
* tweets (nested JSON)    <- ``events``
* page posts (Graph JSON) <- ``documents``; page comments <- ``conversations``
* forum pages             <- ``pages`` (raw HTML)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import hours
from ..operators.normalize import TWEET_SCHEMA, pair_id

# 2024-02-12 00:00:00 UTC: submissions are dated conv_id hours before it.
ANCHOR_EPOCH = 1707696000


def submissions(conversations: DataFrame) -> DataFrame:
    c = conversations
    n = (c.filter(F.col("turn") >= 1).groupBy("conv_id")
         .agg(F.count(F.lit(1)).alias("num_comments")))
    nl = F.instr("text", "\n")
    t0 = c.filter(F.col("turn") == 0).join(n, "conv_id", "left")
    return t0.select(
        F.col("conv_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(nl > 0, F.substring("text", nl + 1, 1 << 30)).otherwise(F.lit("")).alias("selftext"),
        F.col("role").alias("author"),
        (F.lit(ANCHOR_EPOCH) - F.col("conv_id") * 3600).alias("created_utc"),
        (F.length("text") % 50).cast("long").alias("score"),
        F.coalesce("num_comments", F.lit(0)).cast("long").alias("num_comments"),
        F.concat(F.lit("/r/forum/comments/"), F.col("conv_id").cast("string")).alias("permalink"))


def comments(conversations: DataFrame) -> DataFrame:
    c = conversations.filter(F.col("turn") >= 1)
    return c.select(
        F.col("conv_id").alias("parent_id"), F.col("turn").alias("ord"),
        pair_id("conv_id", "turn").alias("id"),
        F.col("text").alias("body"), F.col("role").alias("author"),
        (F.lit(ANCHOR_EPOCH) - F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_utc"),
        (F.length("text") % 10).cast("long").alias("score"),
        F.concat(F.lit("/r/forum/comments/"), F.col("conv_id").cast("string"), F.lit("/c"),
                 F.col("turn").cast("string")).alias("permalink"))


def tweets(events: DataFrame) -> DataFrame:
    """Tweets as landed JSON text, read back with the explicit nested schema."""
    e = events
    payload = F.to_json(F.struct(
        F.col("event_id").alias("id"),
        F.concat(F.col("event_type"), F.lit(" event from user "), F.col("user_id").cast("string"),
                 F.lit(" in session "), (F.col("event_id") % 100).cast("string")).alias("text"),
        F.when(F.col("event_id") % 11 != 0,
               F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("created_at"),
        F.col("user_id").alias("author_id"),
        F.when(F.col("event_id") % 17 == 0, "de").when(F.col("event_id") % 19 != 0, "en").alias("lang"),
        F.when(F.col("event_id") % 13 == 0, F.array(F.struct(
            F.when(F.col("event_id") % 2 == 0, "retweeted").otherwise("quoted").alias("type"),
            F.col("user_id").alias("id")))).alias("referenced_tweets"),
        F.struct(F.from_json("props", "k long")["k"].alias("like_count"),
                 (F.col("user_id") % 7).alias("retweet_count")).alias("public_metrics")))
    return e.select(F.from_json(payload, TWEET_SCHEMA).alias("t")).select("t.*")


def page_posts(documents: DataFrame) -> DataFrame:
    """Graph-style page posts with the nested ``from`` / ``reactions`` /
    ``shares`` shape of ``PAGE_POST_SCHEMA``, built as structs directly (the
    tweets above exercise the JSON text round trip; whole document texts are
    not serialised here)."""
    d = documents
    ts = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
          + hours("doc_id"))
    g = F.struct(
        F.concat(F.lit("page_"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("message"),
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000")).alias("created_time"),
        F.struct(F.when(F.col("doc_id") % 3 != 0,
                        F.concat(F.lit("user"), (F.col("doc_id") % 50).cast("string"))).alias("name"),
                 F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("id")).alias("from"),
        F.when(F.col("doc_id") % 5 != 0,
               F.struct(F.struct((F.col("n_chars") % 97).alias("total_count")).alias("summary")))
         .alias("reactions"),
        F.when(F.col("doc_id") % 4 != 0, F.struct((F.col("doc_id") % 13).alias("count"))).alias("shares"),
    )
    return d.select(F.col("lang").alias("scope"), g.alias("g")).select("scope", "g.*")


def page_comments(conversations: DataFrame) -> DataFrame:
    c = conversations
    return c.filter(F.col("turn") >= 1).select(
        F.concat(F.lit("page_"), F.col("conv_id").cast("string")).alias("parent_id"),
        F.col("turn").alias("ord"),
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("message"), F.lit(None).cast("string").alias("created_time"),
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("from_name"),
        F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("from_id"),
        (F.length("text") % 7).cast("long").alias("like_count"))


def forum_pages(documents: DataFrame) -> DataFrame:
    """Thread pages in the forum's markup, two documents' worth of posts each:
    a header cell with the author link and the date, a body cell with the post
    and its likes.  Even documents have a date and likes in the forum's forms."""
    d = documents
    esc = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")),
                              F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ts = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz") + hours(F.col("doc_id") % 480)
    date = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lower(F.date_format(ts, "h:mma")), F.lit("On"),
                                                     F.date_format(ts, "MMM dd")))
    post = F.concat(
        F.lit('<table summary="posts"><tr><td><a class="user" href="/u">user'),
        (F.col("doc_id") % 50).cast("string"), F.lit("</a>"),
        F.coalesce(F.concat(F.lit(' <span class="s">'), date, F.lit("</span>")), F.lit("")),
        F.lit('<div class="narrow">'), esc,
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<span class="likes">'), (F.col("doc_id") % 9).cast("string"),
                                                 F.lit(" Likes</span>"))).otherwise(F.lit("")),
        F.lit("</div></td></tr></table>"))
    page = F.floor(F.col("doc_id") / 2)
    pages = (d.groupBy(page.alias("page_id"), "lang")
             .agg(F.array_sort(F.collect_list(F.struct("doc_id", post.alias("post")))).alias("posts")))
    html = F.concat(F.lit('<html lang="'), F.col("lang"), F.lit('"><body>'),
                    F.array_join(F.transform("posts", lambda p: p["post"]), ""), F.lit("</body></html>"))
    return pages.select("page_id", F.concat(F.lit("https://forum.example/"), F.col("page_id").cast("string"))
                        .alias("url"), html.alias("html"))


#: put at the start of every body: a link in a comment, a value that holds '>'
#: with references (one out of range, one that must be decoded once only), and
#: links that are not closed
ODD_LINKS = ('<!-- <a href="/1/gone">gone</a> --><script>x = \'<a href="/2/s">s</a>\'</script>'
             '<a title="a>b" href="/3/c?x=&#9999999;&#38;lt;">Three<a href=/4/d>four <i> and a half</i>'
             '<table><tr><td><a href=\'/5/e\'>five<td>no link</table>')


def links_in_other_forms(pages: DataFrame) -> DataFrame:
    """The pages with their link targets in single quotes, bare or in double
    quotes by page, each with an encoded query, every fifth page without end
    tags of links, and ``ODD_LINKS``."""
    k = F.col("page_id") % 3
    old = r'href="([^"\s]+)"'
    html = (F.when(k == 0, F.regexp_replace("html", old, "href='$1?a=1&amp;b=2'"))
            .when(k == 1, F.regexp_replace("html", old, "href=$1?a=1&#38;b=2"))
            .otherwise(F.regexp_replace("html", old, 'href="$1?a=1&#x26;b=2"')))
    html = F.when(F.col("page_id") % 5 == 0, F.replace(html, F.lit("</a>"), F.lit(""))).otherwise(html)
    return pages.withColumn("html", F.replace(html, F.lit("<body>"), F.lit("<body>" + ODD_LINKS)))


def page_lang(html) -> F.Column:
    return F.regexp_extract(html, r'<html[^>]*\blang="([^"]*)"', 1)
