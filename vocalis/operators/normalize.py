"""Landed platform payloads -> the normalized ``posts`` schema (NRM-1 .. NRM-9).

Each normalizer is one DataFrame transformation ending in ``to_posts``:
cleaning (FN-1), minimum length (FLT-1), author hashing (FN-2), date
parsing (FN-3) and the time-range filter (FLT-2), engagement casts.  The
network clients of the original are not rebuilt; these read what any
crawler landed (JSON with an explicit nested schema, or raw HTML).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import epoch_to_ntz, format_date, parse_date, within_range
from ..functions.text import (absolute_url, anonymize_author, clean_text, col_, majority_match,
                              parse_like_count)
from ..params import Params
from ..session import cut_lineage
from .html_posts import raw_links, raw_posts

POST_SCHEMA = T.StructType([
    T.StructField("post_id", T.LongType()), T.StructField("platform", T.StringType()),
    T.StructField("scope", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("author", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("url", T.StringType()),
    T.StructField("likes", T.LongType()), T.StructField("shares", T.LongType()),
    T.StructField("keyword", T.StringType()),
])

# Landed payload schemas (explicit: no inference on the hot path)
SUBMISSION_SCHEMA = ("id long, title string, selftext string, author string, created_utc long, "
                     "score long, num_comments long, permalink string")
COMMENT_SCHEMA = ("parent_id long, ord long, id long, body string, author string, "
                  "created_utc long, score long, permalink string")
TWEET_SCHEMA = ("id long, text string, created_at string, author_id long, lang string, "
                "referenced_tweets array<struct<type:string, id:long>>, "
                "public_metrics struct<like_count:long, retweet_count:long, reply_count:long, "
                "quote_count:long>")
PAGE_POST_SCHEMA = ("id string, message string, created_time string, "
                    "from struct<name:string, id:string>, "
                    "reactions struct<summary:struct<total_count:long>>, shares struct<count:long>")
PAGE_COMMENT_SCHEMA = ("parent_id string, ord long, id string, message string, created_time string, "
                       "from_name string, from_id string, like_count long")


def to_posts(df: DataFrame, *, post_id, platform, scope, text, author, date_raw, url,
             likes, shares, keyword, p: Params, min_chars: int | None = None,
             time_filter: bool = True, ts: Column | None = None) -> DataFrame:
    """Common tail of every normalizer: clean, filter, hash, parse, cast."""
    min_chars = p.min_post_chars if min_chars is None else min_chars
    parsed = parse_date(date_raw, p.as_of) if ts is None else ts
    out = df.select(
        col_(post_id).cast("long").alias("post_id"),
        (F.lit(platform) if isinstance(platform, str) else platform).alias("platform"),
        (F.lit(scope) if isinstance(scope, str) else scope).alias("scope"),
        clean_text(text).alias("text"),
        anonymize_author(author).alias("author"),
        col_(date_raw).cast("string").alias("date_raw"),
        parsed.alias("ts"),
        col_(url).alias("url"),
        F.coalesce(col_(likes).cast("long"), F.lit(0).cast("long")).alias("likes"),
        F.coalesce(col_(shares).cast("long"), F.lit(0).cast("long")).alias("shares"),
        (F.lit(keyword) if isinstance(keyword, str) else keyword).alias("keyword"),
    )
    out = out.filter(F.length("text") >= min_chars)
    if time_filter:
        out = out.filter(within_range("ts", p.as_of, p.months))
    return out.select("post_id", "platform", "scope", "text", "author",
                      format_date("ts", "date_raw").alias("date"), "ts", "url", "likes",
                      "shares", "keyword")


#: largest sum of two numbers whose Cantor number fits into a long
MAX_PAIR_SUM = 3_000_000_000


def pair_id(a, b) -> Column:
    """One long for two: the Cantor number, which no two pairs share, for
    non-negative numbers up to ``MAX_PAIR_SUM`` in sum; for others a negative
    64-bit hash."""
    a, b = col_(a).cast("long"), col_(b).cast("long")
    fits = a.between(0, MAX_PAIR_SUM) & b.between(0, MAX_PAIR_SUM)
    x, y = F.when(fits, a), F.when(fits, b)
    s = F.when(x + y <= MAX_PAIR_SUM, x + y)
    return F.when(a.isNotNull() & b.isNotNull(),
                  F.coalesce(F.shiftright(s * (s + 1), 1) + y, F.xxhash64(a, b).bitwiseOR(F.lit(-(1 << 63)))))


# NRM-1 ----------------------------------------------------------------------
def forum_posts(pages: DataFrame, scope, p: Params, tag: str = "div", cls: str | None = "narrow",
                keyword: Column | str | None = None) -> DataFrame:
    """Thread pages ``(page_id, url, html)`` -> posts; the native id pairs page
    and ordinal, whatever the number of posts on a page."""
    sc = F.lit(scope) if isinstance(scope, str) else scope
    raw = raw_posts(pages.withColumn("scope", sc.cast("string")), tag, cls)
    kw = keyword if keyword is not None else F.concat(F.col("scope"), F.lit(" governorship election"))
    return to_posts(raw, post_id=pair_id("page_id", "ord"), platform="nairaland",
                    scope=F.col("scope"), text=F.col("text_raw"), author=F.col("author_raw"),
                    date_raw=F.col("date_raw"), url=F.col("url"),
                    likes=parse_like_count(F.col("likes_raw")), shares=F.lit(0), keyword=kw, p=p)


# NRM-2 ----------------------------------------------------------------------
def submission_posts(subs: DataFrame, scope, keyword, p: Params) -> DataFrame:
    """Landed submissions -> posts: title + ' ' + body (when non-empty)."""
    text = F.concat_ws(" ", F.col("title"), F.nullif(F.col("selftext"), F.lit("")))
    ts = epoch_to_ntz("created_utc")
    return to_posts(subs, post_id=F.col("id"), platform="reddit", scope=scope, text=text,
                    author=F.col("author"), date_raw=F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
                    url=F.concat(F.lit("https://reddit.com"), F.col("permalink")),
                    likes=F.col("score"), shares=F.col("num_comments"), keyword=keyword, p=p, ts=ts)


# NRM-3 / WIN-6 ------------------------------------------------------------------
def comment_posts(comments: DataFrame, scope, keyword, p: Params, max_comments: int = 10) -> DataFrame:
    """Flat landed comments ``(parent_id, ord, id, body, author, created_utc,
    score, permalink)``: the first ``max_comments`` per submission (by ord,
    cap applied before the length and date filters), as posts.  The cap is a
    ``row_number() <= k`` filter, planned as a window group limit, so a huge
    thread is never gathered into one row or task."""
    c = cap_per_group(comments, ["parent_id"], [F.col("ord").asc(), F.col("id").asc()], max_comments)
    ts = epoch_to_ntz("created_utc")
    return to_posts(c, post_id=F.col("id"), platform="reddit", scope=scope, text=F.col("body"),
                    author=F.col("author"), date_raw=F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
                    url=F.concat(F.lit("https://reddit.com"), F.col("permalink")),
                    likes=F.col("score"), shares=F.lit(0), keyword=keyword, p=p, ts=ts)


# NRM-4 ----------------------------------------------------------------------
def original_tweets(tweets: DataFrame, lang: str | None = "en") -> DataFrame:
    """FLT-3: no reposts, and one language (None: any).  A tweet that carries
    no language or no references passes, as a search result does that never had
    the field."""
    refs = F.coalesce(F.exists("referenced_tweets", lambda r: r["type"] == "retweeted"), F.lit(False))
    out = tweets.filter(~refs)
    return out if lang is None else out.filter(F.coalesce(F.col("lang"), F.lit(lang)) == lang)


def tweet_posts(tweets: DataFrame, scope, keyword, p: Params, originals_only: bool = True,
                lang: str | None = "en") -> DataFrame:
    """Landed tweets (nested ``public_metrics``) -> posts; an empty date is
    allowed; reposts and other languages are left out (FLT-3)."""
    if originals_only:
        tweets = original_tweets(tweets, lang)
    m = F.col("public_metrics")
    return to_posts(tweets, post_id=F.col("id"), platform="twitter", scope=scope,
                    text=F.col("text"), author=F.col("author_id").cast("string"),
                    date_raw=F.coalesce(F.col("created_at"), F.lit("")),
                    url=F.concat(F.lit("https://twitter.com/i/web/status/"), F.col("id").cast("string")),
                    likes=m["like_count"], shares=m["retweet_count"], keyword=keyword, p=p)


# NRM-5 ----------------------------------------------------------------------
def page_posts(graph: DataFrame, scope, keyword, p: Params,
               templates: list[str] | None = None) -> DataFrame:
    """Graph-style page posts -> posts (author = from.name else from.id).

    With ``templates`` (keyword templates with a ``{state}`` placeholder), a
    post is kept only when the majority of some expanded keyword's terms occur
    in its lower-cased message; the first such keyword (template order)
    becomes the post's keyword (JOIN-4).  Expansion is per row, from the
    scope, so there is no join."""
    f = F.col("from")
    sc = F.lit(scope) if isinstance(scope, str) else scope
    if templates:
        arr = F.array(*[F.struct(F.lit(i).alias("i"), F.replace(F.lit(t), F.lit("{state}"), sc).alias("kw"))
                        for i, t in enumerate(templates)])
        ml = F.lower(F.coalesce(F.col("message"), F.lit("")))
        hits = F.filter(arr, lambda k: majority_match(ml, F.lower(k["kw"])))
        graph = graph.withColumn("_kw", hits[0]["kw"]).filter(F.size(hits) > 0)
        keyword = F.col("_kw")
    return to_posts(graph, post_id=F.xxhash64("id"), platform="facebook", scope=sc,
                    text=F.col("message"), author=F.coalesce(f["name"], f["id"]),
                    date_raw=F.col("created_time"),
                    url=F.when(F.col("id").isNotNull() & (F.col("id") != ""),
                               F.concat(F.lit("https://facebook.com/"), F.col("id"))).otherwise(""),
                    likes=F.col("reactions.summary.total_count"), shares=F.col("shares.count"),
                    keyword=keyword, p=p)


# NRM-6 ----------------------------------------------------------------------
def page_comment_posts(comments: DataFrame, scope, keyword, p: Params, max_comments: int = 20) -> DataFrame:
    """Flat page comments ``(parent_id, ord, id, message, created_time,
    from_name, from_id, like_count)``: up to ``max_comments`` per page post,
    length >= 10, **no** time filter, shares 0."""
    c = cap_per_group(comments, ["parent_id"], [F.col("ord").asc(), F.col("id").asc()], max_comments)
    return to_posts(c, post_id=F.xxhash64("id"), platform="facebook", scope=scope,
                    text=F.col("message"), author=F.coalesce(F.col("from_name"), F.col("from_id")),
                    date_raw=F.col("created_time"),
                    url=F.concat(F.lit("https://facebook.com/"), F.coalesce(F.col("id"), F.lit(""))),
                    likes=F.col("like_count"), shares=F.lit(0), keyword=keyword, p=p,
                    min_chars=p.min_comment_chars, time_filter=False)


# NRM-7 / FLT-5 / FN-10 ------------------------------------------------------------
def page_links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All ``<a href>`` of each page with their lower-cased text: ``(page_id,
    url, *keep, ord, href, title)``; empty href or title skipped.  ``ord``
    counts the links with a href."""
    return raw_links(pages, keep).filter((F.col("href") != "") & (F.col("title") != ""))


def base_of(url) -> Column:
    return F.regexp_extract(col_(url), r"^(https?://[^/?#]+)", 1)


def is_thread_url(href, base) -> Column:
    """After removing the base url the path starts with '/' and its first
    segment is all digits."""
    path = F.replace(col_(href), col_(base), F.lit(""))
    return path.rlike(r"^/+[0-9]+(/|$)")


def absolute_links(links: DataFrame) -> DataFrame:
    base = base_of("url")
    return (links.withColumn("abs_url", absolute_url("href", base))
            .withColumn("is_thread", is_thread_url("href", base)))


def distinct_links(links: DataFrame, keys=("page_id",)) -> DataFrame:
    """Order-preserving distinct: the first ordinal of each url per key."""
    return links.groupBy(*keys, "abs_url").agg(F.min("ord").alias("ord"))


# FLT-4 ----------------------------------------------------------------------
def relevant_title(title, scope, words) -> Column:
    from ..functions.text import contains_any
    t = col_(title)
    return (F.instr(t, F.lower(col_(scope))) > 0) & contains_any(t, words)


# JOIN-4 ---------------------------------------------------------------------
def first_matching_keyword(posts: DataFrame, keywords: list[str]) -> DataFrame:
    """The first keyword (template order) whose terms occur by majority in the
    lower-cased text; posts matching none are dropped.  The keyword list is a
    small array literal tested per row -- no join."""
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kw"), F.lit(k.lower()).alias("kl"))
                    for i, k in enumerate(keywords)])
    tl = F.lower("text")
    hits = F.filter(arr, lambda k: majority_match(tl, k["kl"]))
    return (posts.withColumn("_h", hits).filter(F.size("_h") > 0)
            .withColumn("matched_keyword", F.col("_h")[0]["kw"]).drop("_h"))


# SRC-8 ----------------------------------------------------------------------
def expand_keywords(scopes: DataFrame, templates: list[str]) -> DataFrame:
    """Templates x scopes with ``{state}`` replaced; keeps the template ordinal.
    The template list is an array literal, exploded per scope row."""
    arr = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("template"))
                    for i, t in enumerate(templates)])
    e = scopes.select("scope", F.explode(arr).alias("t"))
    return e.select("scope", F.col("t.ordinal").alias("ordinal"),
                    F.replace(F.col("t.template"), F.lit("{state}"), F.col("scope")).alias("keyword"))


# NRM-8 / NRM-9 ------------------------------------------------------------------
def union_posts(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def run_tally(posts: DataFrame) -> DataFrame:
    """Posts per (platform, scope), per platform and in total (rollup)."""
    return posts.rollup("platform", "scope").agg(F.count(F.lit(1)).alias("posts"))


# WIN-7 / WIN-8 ----------------------------------------------------------------------
def cap_per_group(df: DataFrame, keys, order, cap: int) -> DataFrame:
    """Exact ``row_number() <= cap`` per group (planned as a window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def first_seen(df: DataFrame, keys, order_cols) -> DataFrame:
    """Keep the first row per key (e.g. the first keyword that found an id):
    ``min_by`` over an order struct, a partial (map-side) aggregate."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_cols])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def collect_search_hits(hits: DataFrame, keyword_ordinals, per_keyword_cap: int = 100,
                        total_cap: int = 500, run_keys=("platform", "scope"), id_col: str = "id",
                        ordinal_col: str = "keyword_ordinal", rank_col: str = "hit_rank") -> DataFrame:
    """Landed search results -> the hits a collection run keeps (WIN-7, WIN-8).

    ``hits`` has one row per (keyword, result): the keyword's template
    ordinal and the result's rank.  Keywords are taken in template order;
    each keeps its first ``per_keyword_cap`` results whose id no earlier
    keyword took (so an id found by several keywords keeps the first one
    that took it, and results cut by a keyword's cap stay available to later
    keywords); then at most ``total_cap`` hits per run (platform, scope) in
    keyword-then-rank order.  ``keyword_ordinals`` is the (small) template
    ordinal list: one anti-join + window-group-limited cap per keyword, no
    driver-side data.  Apply the validity filters (length, time range) to
    ``hits`` first: validity depends on the hit only, so an invalid id can
    never be taken by any keyword and filtering early is equivalent."""
    keys = list(run_keys)
    # an id repeated within one keyword's results counts once (first rank).  The
    # hits are scanned once; each keyword's step is stored, so step k reads the
    # stored hits and the k - 1 stored steps before it.
    hits = cut_lineage(first_seen(hits, keys + [ordinal_col, id_col], [rank_col]))
    taken: list[DataFrame] = []
    for k in sorted(keyword_ordinals):
        cand = hits.filter(F.col(ordinal_col) == k)
        if taken:
            before = reduce(DataFrame.unionByName, [t.select(*keys, id_col) for t in taken])
            cand = cand.join(before, keys + [id_col], "left_anti")
        taken.append(cut_lineage(cap_per_group(cand, keys, [F.col(rank_col), F.col(id_col)],
                                               per_keyword_cap)))
    if not taken:
        return hits.limit(0)
    taken = reduce(DataFrame.unionByName, taken)
    return cap_per_group(taken, keys, [F.col(ordinal_col), F.col(rank_col), F.col(id_col)], total_cap)
