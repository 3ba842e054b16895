"""Registered source, normalizer, filter, set and window queries
(SRC-1..5, 7..9, NRM-1..9, FLT-1..6, SET-1..2, WIN-6..11, JOIN-4, JOIN-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import within_range
from ..operators import normalize as N
from ..operators.proximity import scope_variants_col
from ..sources import landed
from ..sources import posts as S
from ..sources.tables import read_table
from . import oracle as O
from .catalog import P, analysis, posts, register
from .q_sentiment import full_sql

POST_COLS = ("post_id", "platform", "scope", "text", "author", "ts", "url", "likes", "shares", "keyword")
NORM_COLS = ("platform", "scope", "text", "author", "date", "ts", "url", "likes", "shares", "keyword")
START = "TIMESTAMP '2024-01-13 00:00:00'"   # as_of 2024-02-12 minus 30 days (months = 1)


def CLEAN(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), 'http\\S+|www\\.\\S+', '', 'g'), "
            f"'\\s+', ' ', 'g'))")


def ANON(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 'anonymous' ELSE substr(sha256({x}), 1, 12) END)"


def VSQL(select: str) -> str:
    return f"WITH {O.POSTS_V}\n{select}"


def _posts_select(alias: str = "") -> str:
    return ", ".join(f"{alias}{c}" for c in POST_COLS)


# SRC-1 / SRC-2 / SRC-3 ------------------------------------------------------------
@register("src1_scope_posts", VSQL(f"SELECT {_posts_select()} FROM posts_v WHERE scope = 'en'"))
def src1_scope_posts(spark, sf):
    return S.posts_by_scope(posts(spark, sf), "en")


@register("src2_platform_posts", VSQL(f"SELECT {_posts_select()} FROM posts_v WHERE platform = 'src3'"))
def src2_platform_posts(spark, sf):
    return S.posts_by_platform(posts(spark, sf), "src3")


@register("src3_all_posts", VSQL(f"SELECT {_posts_select()} FROM posts_v"))
def src3_all_posts(spark, sf):
    return S.all_posts(posts(spark, sf))


# SRC-4 ----------------------------------------------------------------------
@register("src4_mentioning", VSQL("""SELECT post_id, scope, platform FROM posts_v
WHERE scope = 'en' AND contains(lower(text), 'apache license')"""))
def src4_mentioning(spark, sf):
    return S.posts_mentioning(posts(spark, sf), "Apache License", "en").select(
        "post_id", "scope", "platform")


@register("src4_mentioning_any_scope", VSQL("""SELECT post_id, scope, platform FROM posts_v
WHERE contains(lower(text), 'general public license')"""))
def src4_mentioning_any_scope(spark, sf):
    return S.posts_mentioning(posts(spark, sf), "General Public License").select(
        "post_id", "scope", "platform")


# SRC-5 ----------------------------------------------------------------------
@register("src5_entities_scope", full_sql("""SELECT scope, name, mention_count FROM entities
WHERE scope = 'en'"""))
def src5_entities_scope(spark, sf):
    e = analysis(spark, sf).entities
    return S.entities_by_scope(e, "en").select("scope", "name", "mention_count")


# SRC-7 ----------------------------------------------------------------------
@register("src7_post_count", VSQL("SELECT count(*) AS post_count FROM posts_v"))
def src7_post_count(spark, sf):
    return S.post_count(posts(spark, sf))


# SRC-8: keyword templates x scopes of the data -----------------------------------------
_TEMPLATES_VALUES = ", ".join(f"({i}, {O.q(t)})" for i, t in enumerate(P.keyword_templates))


@register("src8_keywords", f"""SELECT s.scope, t.ordinal, replace(t.template, '{{state}}', s.scope) AS keyword
FROM (SELECT DISTINCT lang AS scope FROM documents) s, (VALUES {_TEMPLATES_VALUES}) t(ordinal, template)""")
def src8_keywords(spark, sf):
    scopes = read_table(spark, sf, "documents").select(F.col("lang").alias("scope")).distinct()
    return N.expand_keywords(scopes, list(P.keyword_templates))


# SRC-9 ----------------------------------------------------------------------
_PLATS = [f"src{i}" for i in range(1, 6)]


@register("src9_restrict", VSQL(f"""SELECT post_id, scope, platform FROM posts_v
WHERE scope IN ('en', 'de') AND platform IN ({", ".join(O.q(x) for x in _PLATS)})"""))
def src9_restrict(spark, sf):
    return S.restrict(posts(spark, sf), ["en", "de"], _PLATS).select("post_id", "scope", "platform")


# NRM-1: thread pages in the forum's markup, made from the documents --------------------------
FORUM_SQL = """fp AS (
  SELECT doc_id, lang, text, doc_id // 2 AS page_id,
    row_number() OVER (PARTITION BY doc_id // 2, lang ORDER BY doc_id) - 1 AS ord,
    TIMESTAMP '2024-01-20 00:00:00' + (doc_id % 480) * INTERVAL 1 HOUR AS ts0 FROM documents)"""
N1_SQL = f"""n1 AS (
  SELECT ((page_id + ord) * (page_id + ord + 1) // 2 + ord)::BIGINT AS post_id, 'nairaland' AS platform, lang AS scope,
    {CLEAN("coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' ' || (doc_id % 9)::VARCHAR || ' Likes' ELSE '' END")} AS text,
    {ANON("'user' || (doc_id % 50)::VARCHAR")} AS author,
    CASE WHEN doc_id % 2 = 0 THEN ts0 END AS ts, 'https://forum.example/' || page_id::VARCHAR AS url,
    CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 ELSE 0 END::BIGINT AS likes, 0::BIGINT AS shares,
    lang || ' governorship election' AS keyword
  FROM fp)"""


@register("nrm1_forum_html", f"""WITH {FORUM_SQL}, {N1_SQL}
SELECT post_id, platform, scope, text, author, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, ts, url, likes, shares, keyword
FROM n1 WHERE length(text) >= 20 AND (ts IS NULL OR ts >= {START})""")
def nrm1_forum_html(spark, sf):
    pages = landed.forum_pages(read_table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return N.forum_posts(pages, landed.page_lang(F.col("html")), P)


# the same parser on the driver's raw pages: the post element is <p>, whose end tag may be missing
@register("nrm1_page_paragraphs", f"""WITH pp AS (
  SELECT page_id, url, regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1) AS scope,
    string_split(html, '<p>')[2:] AS ps FROM pages),
p0 AS (SELECT page_id, url, scope, unnest(ps) AS h, unnest(generate_series(0, len(ps) - 1)) AS ord FROM pp),
p1 AS (SELECT *, regexp_replace(regexp_extract(h, '(?s)^(.*?)(?:</p>|</article>|$)', 1), '<[^>]*>', ' ', 'g') AS t FROM p0),
p2 AS (
  SELECT ((page_id + ord) * (page_id + ord + 1) // 2 + ord)::BIGINT AS post_id, 'nairaland' AS platform, scope,
    {CLEAN("replace(replace(replace(replace(t, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")} AS text,
    url FROM p1)
SELECT post_id, platform, scope, text, {ANON("NULL::VARCHAR")} AS author, NULL::VARCHAR AS date, NULL::TIMESTAMP AS ts,
  url, 0::BIGINT AS likes, 0::BIGINT AS shares, scope || ' governorship election' AS keyword
FROM p2 WHERE length(text) >= 20""")
def nrm1_page_paragraphs(spark, sf):
    pages = read_table(spark, sf, "pages")
    return N.forum_posts(pages, landed.page_lang(F.col("html")), P.with_(months=1200),
                         tag="p", cls=None)


# NRM-2: submissions -------------------------------------------------------------------
SUBS_SQL = """subs AS (
  SELECT c.conv_id AS id, split_part(c.text, chr(10), 1) AS title,
    CASE WHEN strpos(c.text, chr(10)) > 0 THEN substr(c.text, strpos(c.text, chr(10)) + 1) ELSE '' END AS selftext,
    c.role AS author, 1707696000 - c.conv_id * 3600 AS created_utc, (length(c.text) % 50)::BIGINT AS score,
    coalesce(n.num_comments, 0)::BIGINT AS num_comments, '/r/forum/comments/' || c.conv_id::VARCHAR AS permalink
  FROM conversations c
  LEFT JOIN (SELECT conv_id, count(*) AS num_comments FROM conversations WHERE turn >= 1 GROUP BY conv_id) n
    ON n.conv_id = c.conv_id
  WHERE c.turn = 0)"""
N2_SQL = f"""n2 AS (
  SELECT id AS post_id, 'reddit' AS platform, 'en' AS scope,
    {CLEAN("CASE WHEN selftext IS NULL OR selftext = '' THEN title ELSE title || ' ' || selftext END")} AS text,
    {ANON('author')} AS author, make_timestamp(created_utc * 1000000) AS ts,
    'https://reddit.com' || permalink AS url, score AS likes, num_comments AS shares, 'en release' AS keyword
  FROM subs)"""
TAIL = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS date"


@register("nrm2_submissions", f"""WITH {SUBS_SQL}, {N2_SQL}
SELECT post_id, platform, scope, text, author, {TAIL}, ts, url, likes, shares, keyword
FROM n2 WHERE length(text) >= 20 AND ts >= {START}""")
def nrm2_submissions(spark, sf):
    subs = landed.submissions(read_table(spark, sf, "conversations"))
    return N.submission_posts(subs, "en", "en release", P)


# NRM-3 / WIN-6: comments, first 10 per submission -------------------------------------------
COM_SQL = """com AS (
  SELECT conv_id AS parent_id, turn AS ord, ((conv_id + turn) * (conv_id + turn + 1) // 2 + turn)::BIGINT AS id, text AS body, role AS author,
    1707696000 - conv_id * 3600 + turn * 60 AS created_utc, (length(text) % 10)::BIGINT AS score,
    '/r/forum/comments/' || conv_id::VARCHAR || '/c' || turn::VARCHAR AS permalink
  FROM conversations WHERE turn >= 1),
capped AS (SELECT * FROM com QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY ord, id) <= 10)"""
N3_SQL = f"""n3 AS (
  SELECT id AS post_id, 'reddit' AS platform, 'en' AS scope, {CLEAN('body')} AS text, {ANON('author')} AS author,
    make_timestamp(created_utc * 1000000) AS ts, 'https://reddit.com' || permalink AS url,
    score AS likes, 0::BIGINT AS shares, 'en release' AS keyword
  FROM capped)"""


@register("nrm3_comments", f"""WITH {COM_SQL}, {N3_SQL}
SELECT post_id, platform, scope, text, author, {TAIL}, ts, url, likes, shares, keyword
FROM n3 WHERE length(text) >= 20 AND ts >= {START}""")
def nrm3_comments(spark, sf):
    com = landed.comments(read_table(spark, sf, "conversations"))
    return N.comment_posts(com, "en", "en release", P, max_comments=10)


@register("win6_comment_cap", f"WITH {COM_SQL} SELECT parent_id, ord FROM capped")
def win6_comment_cap(spark, sf):
    com = landed.comments(read_table(spark, sf, "conversations"))
    return N.cap_per_group(com, ["parent_id"], [F.col("ord").asc(), F.col("id").asc()], 10) \
        .select("parent_id", "ord")


# NRM-4: tweets (nested JSON) ------------------------------------------------------------
TW_SQL = """tw AS (
  SELECT event_id AS id,
    event_type || ' event from user ' || user_id::VARCHAR || ' in session ' || (event_id % 100)::VARCHAR AS text,
    CASE WHEN event_id % 11 <> 0 THEN date_trunc('millisecond', ts) END AS ts0,
    user_id AS author_id, json_extract(props, '$.k')::BIGINT AS like_count, user_id % 7 AS retweet_count
  FROM events
  WHERE event_id % 17 <> 0 AND NOT (event_id % 13 = 0 AND event_id % 2 = 0))"""
N4_SQL = f"""n4 AS (
  SELECT id AS post_id, 'twitter' AS platform, 'en' AS scope, {CLEAN('text')} AS text,
    {ANON('author_id::VARCHAR')} AS author, ts0 AS ts,
    'https://twitter.com/i/web/status/' || id::VARCHAR AS url,
    coalesce(like_count, 0)::BIGINT AS likes, coalesce(retweet_count, 0)::BIGINT AS shares,
    'en release' AS keyword
  FROM tw)"""


@register("nrm4_tweets", f"""WITH {TW_SQL}, {N4_SQL}
SELECT post_id, platform, scope, text, author, coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '') AS date,
  ts, url, likes, shares, keyword
FROM n4 WHERE length(text) >= 20 AND (ts IS NULL OR ts >= {START})""")
def nrm4_tweets(spark, sf):
    tw = landed.tweets(read_table(spark, sf, "events"))
    return N.tweet_posts(tw, "en", "en release", P)


# NRM-5: page posts (Graph JSON) ------------------------------------------------------------
PP_SQL = """pp AS (
  SELECT lang AS scope, 'page_' || doc_id::VARCHAR AS id, text AS message,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS ts0,
    CASE WHEN doc_id % 3 <> 0 THEN 'user' || (doc_id % 50)::VARCHAR END AS from_name,
    'u' || (doc_id % 50)::VARCHAR AS from_id,
    CASE WHEN doc_id % 5 <> 0 THEN n_chars % 97 END AS total_count,
    CASE WHEN doc_id % 4 <> 0 THEN doc_id % 13 END AS share_count
  FROM documents)"""
N5_SQL = f"""n5 AS (
  SELECT 'facebook' AS platform, scope, {CLEAN('message')} AS text,
    {ANON('coalesce(from_name, from_id)')} AS author, ts0 AS ts, 'https://facebook.com/' || id AS url,
    coalesce(total_count, 0)::BIGINT AS likes, coalesce(share_count, 0)::BIGINT AS shares,
    'en release' AS keyword
  FROM pp)"""


@register("nrm5_page_posts", f"""WITH {PP_SQL}, {N5_SQL}
SELECT platform, scope, text, author, {TAIL}, ts, url, likes, shares, keyword
FROM n5 WHERE length(text) >= 20 AND ts >= {START}""")
def nrm5_page_posts(spark, sf):
    g = landed.page_posts(read_table(spark, sf, "documents"))
    return N.page_posts(g, F.col("scope"), "en release", P).select(*NORM_COLS)


# NRM-6: page comments, at most 20, length >= 10, no time filter ------------------------------
PC_SQL = """pc AS (
  SELECT 'page_' || conv_id::VARCHAR AS parent_id, turn AS ord, conv_id::VARCHAR || '_' || turn::VARCHAR AS id,
    text AS message, CASE WHEN turn % 2 = 0 THEN role END AS from_name, 'r' || conv_id::VARCHAR AS from_id,
    (length(text) % 7)::BIGINT AS like_count
  FROM conversations WHERE turn >= 1
  QUALIFY row_number() OVER (PARTITION BY 'page_' || conv_id::VARCHAR ORDER BY turn, conv_id::VARCHAR || '_' || turn::VARCHAR) <= 20)"""
N6_SQL = f"""n6 AS (
  SELECT 'facebook' AS platform, 'en' AS scope, {CLEAN('message')} AS text,
    {ANON('coalesce(from_name, from_id)')} AS author, NULL::TIMESTAMP AS ts,
    'https://facebook.com/' || id AS url, coalesce(like_count, 0)::BIGINT AS likes, 0::BIGINT AS shares,
    'en release' AS keyword
  FROM pc)"""


@register("nrm6_page_comments", f"""WITH {PC_SQL}, {N6_SQL}
SELECT platform, scope, text, author, NULL::VARCHAR AS date, ts, url, likes, shares, keyword
FROM n6 WHERE length(text) >= 10""")
def nrm6_page_comments(spark, sf):
    c = landed.page_comments(read_table(spark, sf, "conversations"))
    return N.page_comment_posts(c, "en", "en release", P).select(*NORM_COLS)


# NRM-8: union of every platform's posts --------------------------------------------------------
_U = ("platform", "scope", "text", "author", "ts", "url", "likes", "shares", "keyword")
_UCOLS = ", ".join(_U)


@register("nrm8_union", f"""WITH {FORUM_SQL}, {N1_SQL}, {SUBS_SQL}, {N2_SQL}, {COM_SQL}, {N3_SQL}, {TW_SQL}, {N4_SQL},
{PP_SQL}, {N5_SQL}, {PC_SQL}, {N6_SQL}
SELECT {_UCOLS} FROM n1 WHERE length(text) >= 20 AND (ts IS NULL OR ts >= {START})
UNION ALL SELECT {_UCOLS} FROM n2 WHERE length(text) >= 20 AND ts >= {START}
UNION ALL SELECT {_UCOLS} FROM n3 WHERE length(text) >= 20 AND ts >= {START}
UNION ALL SELECT {_UCOLS} FROM n4 WHERE length(text) >= 20 AND (ts IS NULL OR ts >= {START})
UNION ALL SELECT {_UCOLS} FROM n5 WHERE length(text) >= 20 AND ts >= {START}
UNION ALL SELECT {_UCOLS} FROM n6 WHERE length(text) >= 10""")
def nrm8_union(spark, sf):
    frames = [nrm1_forum_html(spark, sf), nrm2_submissions(spark, sf), nrm3_comments(spark, sf),
              nrm4_tweets(spark, sf), nrm5_page_posts(spark, sf), nrm6_page_comments(spark, sf)]
    return N.union_posts(*[f.select(*_U) for f in frames])


# NRM-9: run tally with rollup ------------------------------------------------------------
@register("nrm9_tally", VSQL("""SELECT platform, scope, count(*) AS posts FROM posts_v
GROUP BY ROLLUP (platform, scope)"""))
def nrm9_tally(spark, sf):
    return N.run_tally(posts(spark, sf))


# NRM-7 / FN-10 / FLT-5: links of pages --------------------------------------------------------
LINKS_SQL = r"""lk0 AS (
  SELECT page_id, url, html,
    regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hs,
    regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS ts
  FROM pages),
lk1 AS (
  SELECT page_id, url, regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1) AS scope,
    unnest(hs) AS href, unnest(ts) AS t, unnest(generate_series(0, len(hs) - 1)) AS ord FROM lk0),
links AS (
  SELECT page_id, url, scope, ord, href, lower(trim(regexp_replace(t, '<[^>]*>', '', 'g'))) AS title,
    regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base
  FROM lk1 WHERE href <> '' AND lower(trim(regexp_replace(t, '<[^>]*>', '', 'g'))) <> ''),
alinks AS (
  SELECT *, CASE WHEN starts_with(href, 'http') THEN href ELSE base || href END AS abs_url,
    regexp_matches(replace(href, base, ''), '^/+[0-9]+(/|$)') AS is_thread
  FROM links)"""


def links_with_scope(spark, sf):
    pages = read_table(spark, sf, "pages").withColumn("scope", landed.page_lang(F.col("html")))
    return N.absolute_links(N.page_links(pages, keep=("scope",)))


@register("nrm7_links", f"""WITH {LINKS_SQL}
SELECT page_id, abs_url, min(ord)::BIGINT AS ord FROM alinks GROUP BY page_id, abs_url""")
def nrm7_links(spark, sf):
    l = N.absolute_links(N.page_links(read_table(spark, sf, "pages")))
    return N.distinct_links(l).select("page_id", "abs_url", F.col("ord").cast("long").alias("ord"))


# the forms of a link target, with encoded queries, unclosed links and odd ones; the SQL takes the plain pages
@register("nrm7_link_forms", f"""WITH {LINKS_SQL}
SELECT page_id, ord::BIGINT + 3 AS ord,
  CASE WHEN regexp_matches(href, '\\s') THEN href ELSE href || '?a=1&b=2' END AS href, title FROM alinks
UNION ALL SELECT page_id, o::BIGINT, h, t FROM pages,
  (VALUES (0, '/3/c?x=' || chr(65533) || '&lt;', 'three'), (1, '/4/d', 'fourand a half'), (2, '/5/e', 'five')) v(o, h, t)
WHERE contains(html, '<body>')""")
def nrm7_link_forms(spark, sf):
    pages = landed.links_in_other_forms(read_table(spark, sf, "pages"))
    return N.page_links(pages).select("page_id", F.col("ord").cast("long").alias("ord"), "href", "title")


@register("fn10_abs_url", f"""WITH {LINKS_SQL}
SELECT page_id, ord::BIGINT AS ord, href, title, abs_url FROM alinks""")
def fn10_abs_url(spark, sf):
    l = N.absolute_links(N.page_links(read_table(spark, sf, "pages")))
    return l.select("page_id", F.col("ord").cast("long").alias("ord"), "href", "title", "abs_url")


@register("flt5_thread_url", f"""WITH {LINKS_SQL}
SELECT page_id, ord::BIGINT AS ord, is_thread FROM alinks""")
def flt5_thread_url(spark, sf):
    l = N.absolute_links(N.page_links(read_table(spark, sf, "pages")))
    return l.select("page_id", F.col("ord").cast("long").alias("ord"), "is_thread")


# SET-1: distinct thread urls per scope across routes ---------------------------------------------
@register("set1_url_distinct", f"""WITH {LINKS_SQL}
SELECT DISTINCT scope, abs_url FROM alinks""")
def set1_url_distinct(spark, sf):
    return links_with_scope(spark, sf).select("scope", "abs_url").dropDuplicates(["scope", "abs_url"])


# FLT-4: title relevance on page titles --------------------------------------------------------
REL_WORDS = ("the", "und", "que", "les")


@register("flt4_title_relevance", f"""SELECT page_id FROM (
  SELECT page_id, lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title,
         regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1) AS scope FROM pages)
WHERE contains(title, lower(scope)) AND {O.any_in('title', REL_WORDS)}""")
def flt4_title_relevance(spark, sf):
    pages = read_table(spark, sf, "pages")
    t = pages.select("page_id",
                     F.lower(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"),
                     landed.page_lang(F.col("html")).alias("scope"))
    return t.filter(N.relevant_title("title", "scope", REL_WORDS)).select("page_id")


# FLT-1: minimum length ------------------------------------------------------------------
@register("flt1_min_length", VSQL("SELECT post_id, length(text)::BIGINT AS n FROM posts_v WHERE length(text) >= 20"))
def flt1_min_length(spark, sf):
    ps = posts(spark, sf)
    return ps.filter(F.length("text") >= P.min_post_chars).select(
        "post_id", F.length("text").cast("long").alias("n"))


# FLT-2: time range on events (as_of 2024-02-12, 1 month) -----------------------------------------
@register("flt2_time_range", f"SELECT event_id, ts FROM events WHERE ts IS NULL OR ts >= {START}")
def flt2_time_range(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.filter(within_range("ts", P.as_of, P.months)).select("event_id", "ts")


# FLT-3: originals, one language, exact phrase ---------------------------------------------
# A repost is a post whose exact text already appeared in an earlier post
# (the documents hold exact copies); the flag is derived with a partial
# aggregate on a 32-byte digest of the text, never on the text itself.
@register("flt3_originals", VSQL("""SELECT p.post_id FROM posts_v p
JOIN (SELECT sha256(text) AS h, min(post_id) AS first_id FROM posts_v GROUP BY sha256(text)) f
  ON f.h = sha256(p.text)
WHERE p.post_id = f.first_id AND p.scope = 'en' AND contains(lower(p.text), 'apache license')"""))
def flt3_originals(spark, sf):
    ps = posts(spark, sf).withColumn("h", F.sha2("text", 256))
    first = ps.groupBy("h").agg(F.min("post_id").alias("first_id"))
    flagged = ps.join(first, "h").withColumn("is_repost", F.col("post_id") != F.col("first_id"))
    return flagged.filter(~F.col("is_repost") & (F.col("scope") == "en")
                          & (F.instr(F.lower("text"), "apache license") > 0)).select("post_id")


# FLT-6: label filter on the fan-out ----------------------------------------------------------
@register("flt6_label_filter", full_sql("SELECT post_id, entity, score FROM fanout WHERE label = 'positive'"))
def flt6_label_filter(spark, sf):
    return analysis(spark, sf).sentiment.filter(F.col("label") == "positive").select(
        "post_id", "entity", "score")


# SET-2: duplicates kept by default; optional dedupe (first post id per key) --------------------
# the text enters the key as a 32-byte digest, so copies are grouped
# without shuffling whole texts
@register("set2_dedupe", VSQL("SELECT scope, min(post_id) AS post_id FROM posts_v GROUP BY scope, sha256(text)"))
def set2_dedupe(spark, sf):
    from ..sinks.io import dedupe_posts
    ps = posts(spark, sf).select("post_id", "scope", F.sha2("text", 256).alias("text_digest"))
    return dedupe_posts(ps, ["scope", "text_digest"]).select("scope", "post_id")


# WIN-7: caps per group ------------------------------------------------------------------
@register("win7_caps", VSQL("""SELECT post_id, platform, scope FROM posts_v
QUALIFY row_number() OVER (PARTITION BY platform, scope ORDER BY ts DESC, post_id) <= 10"""))
def win7_caps(spark, sf):
    ps = posts(spark, sf)
    return N.cap_per_group(ps, ["platform", "scope"], [F.col("ts").desc(), F.col("post_id")], 10) \
        .select("post_id", "platform", "scope")


# WIN-8: first-seen attribution (first keyword per id) ------------------------------------------
@register("win8_first_seen", """SELECT user_id, arg_min(event_type, (event_type, event_id)) AS event_type,
  arg_min(event_id, (event_type, event_id)) AS event_id
FROM events GROUP BY user_id""")
def win8_first_seen(spark, sf):
    ev = read_table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return N.first_seen(ev, ["user_id"], ["event_type", "event_id"])


# WIN-10: sample head -------------------------------------------------------------------
@register("win10_sample_head", VSQL("SELECT post_id, platform, scope FROM posts_v ORDER BY ts DESC, post_id LIMIT 5"))
def win10_sample_head(spark, sf):
    return S.all_posts(posts(spark, sf)).limit(5).select("post_id", "platform", "scope")


# WIN-11: top-5 entities per scope (logged) -------------------------------------------------
@register("win11_top5", full_sql("SELECT scope, name, rank::BIGINT AS rank FROM entities WHERE rank <= 5"))
def win11_top5(spark, sf):
    e = analysis(spark, sf).entities
    return e.filter(F.col("rank") <= 5).select("scope", "name", F.col("rank").cast("long").alias("rank"))


# JOIN-4: first keyword matched by majority of terms ---------------------------------------------
_KW = [t.replace("{state}", "en") for t in P.keyword_templates]


@register("join4_keyword_match", VSQL(f"""SELECT post_id, kw AS matched_keyword FROM (
  SELECT p.post_id, k.kw, row_number() OVER (PARTITION BY p.post_id ORDER BY k.i) AS r
  FROM posts_v p, (VALUES {", ".join(f"({i}, {O.q(k)})" for i, k in enumerate(_KW))}) k(i, kw)
  WHERE len(list_filter(string_split(lower(k.kw), ' '), lambda t: contains(lower(p.text), t)))
        >= len(string_split(lower(k.kw), ' ')) // 2 + 1)
WHERE r = 1"""))
def join4_keyword_match(spark, sf):
    return N.first_matching_keyword(posts(spark, sf), _KW).select("post_id", "matched_keyword")


# JOIN-8: scope list left-joined with its variants ---------------------------------------------
@register("join8_scope_variants", f"""SELECT scope, array_to_string(list_sort(list_distinct(
  list_concat([lower(scope)], CASE lower(scope) {" ".join(f"WHEN {O.q(k.lower())} THEN {O.lst(P.variants_for(k))}" for k in P.scope_variants)} ELSE []::VARCHAR[] END))), ',') AS variants
FROM (SELECT DISTINCT lang AS scope FROM documents)""")
def join8_scope_variants(spark, sf):
    scopes = read_table(spark, sf, "documents").select(F.col("lang").alias("scope")).distinct()
    v = scope_variants_col("scope", P)
    return scopes.select("scope", F.array_join(F.array_sort(F.array_distinct(v)), ",").alias("variants"))


# WIN-7 / WIN-8 / JOIN-4 together: a search run over the posts ------------------------------
# Each expanded keyword "searches" the posts of its scope (majority of terms,
# JOIN-4), results newest first; the run keeps them keyword by keyword with
# exact per-keyword and per-run caps (small caps so that they bind here).
_SEARCH_CAP, _SEARCH_TOTAL = 5, 8


# as many templates as a full run has
_SEVEN = (*P.keyword_templates, "licensed under {state}", "version of {state}", "the {state} work", "de la {state}")[:7]


def _search_sql(templates) -> str:
    tmpl = ", ".join(f"({i}, {O.q(t)})" for i, t in enumerate(templates))
    hits = f"""hits AS (
  SELECT p.scope, t.i AS keyword_ordinal, p.post_id AS id, p.ts
  FROM posts_v p, (VALUES {tmpl}) t(i, tmpl)
  WHERE p.scope IN ({", ".join(O.q(s) for s in P.scopes)})
    AND len(list_filter(string_split(lower(replace(t.tmpl, '{{state}}', p.scope)), ' '),
                        lambda w: contains(lower(p.text), w)))
        >= len(string_split(replace(t.tmpl, '{{state}}', p.scope), ' ')) // 2 + 1)"""
    steps, prev = [], []
    for i in range(len(templates)):
        anti = "".join(f" AND NOT EXISTS (SELECT 1 FROM k{j} WHERE k{j}.scope = h.scope AND k{j}.id = h.id)"
                       for j in prev)
        steps.append(f"""k{i} AS (
  SELECT scope, keyword_ordinal, id, ts FROM hits h WHERE keyword_ordinal = {i}{anti}
  QUALIFY row_number() OVER (PARTITION BY scope ORDER BY ts DESC, id) <= {_SEARCH_CAP})""")
        prev.append(i)
    union = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(templates)))
    return f"""WITH {O.POSTS_V}, {hits}, {", ".join(steps)}
SELECT scope, keyword_ordinal, id FROM ({union})
QUALIFY row_number() OVER (PARTITION BY scope ORDER BY keyword_ordinal, ts DESC, id) <= {_SEARCH_TOTAL}"""


def _search_run(spark, sf, templates):
    ps = posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    arr = F.array(*[F.struct(F.lit(i).alias("i"),
                             F.replace(F.lit(t), F.lit("{state}"), F.col("scope")).alias("kw"))
                    for i, t in enumerate(templates)])
    tl = F.lower("text")
    hits = (ps.select("scope", "post_id", "ts",
                      F.explode(F.filter(arr, lambda k: N.majority_match(tl, F.lower(k["kw"])))).alias("k"))
            .select(F.lit("search").alias("platform"), "scope",
                    F.col("k.i").alias("keyword_ordinal"), F.col("post_id").alias("id"),
                    # newest first, then id: an orderable value, no sort window
                    F.struct((-F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
                             .alias("t"), F.col("post_id").alias("p")).alias("hit_rank")))
    out = N.collect_search_hits(hits, range(len(templates)), per_keyword_cap=_SEARCH_CAP,
                                total_cap=_SEARCH_TOTAL)
    return out.select("scope", "keyword_ordinal", "id")


@register("win8_search_run", _search_sql(P.keyword_templates))
def win8_search_run(spark, sf):
    return _search_run(spark, sf, P.keyword_templates)


@register("win8_search_run_7", _search_sql(_SEVEN))
def win8_search_run_7(spark, sf):
    return _search_run(spark, sf, _SEVEN)
