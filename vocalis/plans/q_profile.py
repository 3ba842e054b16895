"""Registered profile queries (AGG-1..15, WIN-2..5, JOIN-5..10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as prof
from ..sources.tables import read_table
from . import oracle as O
from .catalog import P, analysis, joined, register
from .q_sentiment import full_sql

KEY = ("scope", "entity")

_cats = list(P.support_categories.items())
_CATS_VALUES = ", ".join(f"({O.q(c)}, {i}, {O.lst(kws)})" for i, (c, kws) in enumerate(_cats))
_REGS_VALUES = ", ".join(f"({O.q(r)}, {i})" for i, r in enumerate(P.region_keywords))

PROFILE_CTES = f"""ekeys AS (SELECT scope, name AS entity FROM entities),
es AS (SELECT * FROM fanout WHERE entity <> 'General'),
ep AS (
  SELECT e.post_id, e.scope, e.entity, p.platform, p.text, p.ts, p.likes, p.shares
  FROM ent_pairs e JOIN posts_v p ON p.post_id = e.post_id),
summary AS (
  SELECT k.scope, k.entity,
    coalesce({O.exact_mean('es.score', 4)}, 0.0::DOUBLE) AS overall_score,
    coalesce((CASE WHEN round_even(printf('%.25f', (count(es.post_id) FILTER (WHERE es.label = 'positive')::DOUBLE
                        / count(es.post_id)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (count(es.post_id) FILTER (WHERE es.label = 'positive')::DOUBLE
                        / count(es.post_id)::DOUBLE * 100)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (count(es.post_id) FILTER (WHERE es.label = 'positive')::DOUBLE
                        / count(es.post_id)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END), 0.0::DOUBLE) AS positive_pct,
    coalesce((CASE WHEN round_even(printf('%.25f', (count(es.post_id) FILTER (WHERE es.label = 'negative')::DOUBLE
                        / count(es.post_id)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (count(es.post_id) FILTER (WHERE es.label = 'negative')::DOUBLE
                        / count(es.post_id)::DOUBLE * 100)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (count(es.post_id) FILTER (WHERE es.label = 'negative')::DOUBLE
                        / count(es.post_id)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END), 0.0::DOUBLE) AS negative_pct,
    coalesce((CASE WHEN round_even(printf('%.25f', (count(es.post_id) FILTER (WHERE es.label = 'neutral')::DOUBLE
                        / count(es.post_id)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (count(es.post_id) FILTER (WHERE es.label = 'neutral')::DOUBLE
                        / count(es.post_id)::DOUBLE * 100)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (count(es.post_id) FILTER (WHERE es.label = 'neutral')::DOUBLE
                        / count(es.post_id)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END), 0.0::DOUBLE) AS neutral_pct,
    count(es.post_id) AS total_analyzed
  FROM ekeys k LEFT JOIN es USING (scope, entity) GROUP BY k.scope, k.entity),
pbreak AS (
  SELECT scope, entity, platform, {O.exact_mean('score', 4)} AS score, count(*) AS count,
    (CASE WHEN round_even(printf('%.25f', (count(*) FILTER (WHERE label = 'positive')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (count(*) FILTER (WHERE label = 'positive')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (count(*) FILTER (WHERE label = 'positive')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END) AS positive_pct,
    (CASE WHEN round_even(printf('%.25f', (count(*) FILTER (WHERE label = 'negative')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (count(*) FILTER (WHERE label = 'negative')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (count(*) FILTER (WHERE label = 'negative')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END) AS negative_pct
  FROM es GROUP BY scope, entity, platform),
excerpts AS (
  SELECT x.scope, x.entity, x.label, x.rank, x.post_id,
    CASE WHEN length(p.text) > {P.excerpt_chars} THEN substr(p.text, 1, {P.excerpt_chars}) || '...'
         ELSE p.text END AS text,
    x.platform, x.score, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS date
  FROM (SELECT scope, entity, label, post_id, platform, score,
          row_number() OVER (PARTITION BY scope, entity, label ORDER BY abs(score) DESC, post_id) AS rank
        FROM es WHERE label IN ('positive', 'negative') QUALIFY rank <= {P.excerpts_top}) x
  JOIN posts_v p ON p.post_id = x.post_id),
tok AS (
  SELECT scope, entity,
    unnest(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) AS token,
    list_transform(string_split(trim(regexp_replace(entity, '\\s+', ' ', 'g')), ' '), lambda w: lower(w)) AS nw
  FROM ep),
tcount AS (
  SELECT scope, entity, token, count(*) AS count FROM tok
  WHERE length(token) >= {P.theme_min_len} AND regexp_full_match(token, '\\p{{L}}+')
    AND NOT list_contains({O.lst(P.theme_stop_words)}, token) AND NOT list_contains(nw, token)
  GROUP BY scope, entity, token),
themes AS (
  SELECT scope, entity, token AS theme, count,
    row_number() OVER (PARTITION BY scope, entity ORDER BY count DESC, token) AS rank
  FROM tcount QUALIFY rank <= {P.themes_top}),
audience AS (
  SELECT scope, entity, platform, count(*) AS posts,
    (CASE WHEN round_even(printf('%.25f', (count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY scope, entity))::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY scope, entity))::DOUBLE * 100)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY scope, entity))::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END) AS share_pct
  FROM ep GROUP BY scope, entity, platform),
support AS (
  SELECT scope, entity, c.category, c.ordinal, count(*) AS mentions,
    CASE WHEN count(*) >= 3 THEN 'strong' WHEN count(*) >= 2 THEN 'moderate' ELSE 'weak' END AS strength
  FROM ep, (VALUES {_CATS_VALUES}) c(category, ordinal, kws)
  WHERE contains(lower(text), lower(entity))
    AND list_bool_or(list_transform(kws, lambda k: contains(lower(text), k)))
  GROUP BY scope, entity, c.category, c.ordinal),
region_hits AS (
  SELECT scope, entity, r.region, r.ordinal, count(*) AS mentions
  FROM ep, (VALUES {_REGS_VALUES}) r(region, ordinal)
  WHERE contains(lower(text), lower(entity)) AND contains(lower(text), r.region)
  GROUP BY scope, entity, r.region, r.ordinal),
regions AS (
  SELECT scope, entity, region, mentions,
    row_number() OVER (PARTITION BY scope, entity ORDER BY mentions DESC, ordinal) AS rank
  FROM region_hits QUALIFY rank <= {P.regions_top}),
engagement AS (
  SELECT k.scope, k.entity, coalesce(sum(ep.likes), 0)::BIGINT AS total_likes,
    coalesce(sum(ep.shares), 0)::BIGINT AS total_shares,
    coalesce((CASE WHEN round_even(printf('%.25f', (avg(ep.likes))::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (avg(ep.likes))::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (avg(ep.likes))::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END), 0.0::DOUBLE) AS avg_likes,
    count(ep.post_id) AS post_count
  FROM ekeys k LEFT JOIN ep USING (scope, entity) GROUP BY k.scope, k.entity)"""


def psql(select: str) -> str:
    return full_sql(select, PROFILE_CTES)


def A(spark, sf):
    return analysis(spark, sf)


# AGG-1 ----------------------------------------------------------------------
@register("agg1_summary", psql("SELECT * FROM summary"), headline=True)
def agg1_summary(spark, sf):
    return A(spark, sf).part("summary")


# AGG-2 ----------------------------------------------------------------------
@register("agg2_platforms", psql("SELECT * FROM pbreak"))
def agg2_platforms(spark, sf):
    return A(spark, sf).part("platforms")


# WIN-2 / FLT-6 / FN-5 --------------------------------------------------------------
@register("win2_excerpts", psql("SELECT * FROM excerpts"))
def win2_excerpts(spark, sf):
    return A(spark, sf).part("excerpts")


# AGG-3 / WIN-3 ----------------------------------------------------------------------
@register("agg3_themes", psql("SELECT scope, entity, rank::BIGINT AS rank, theme, count FROM themes"),
          headline=True)
def agg3_themes(spark, sf):
    return A(spark, sf).part("themes").withColumn("rank", F.col("rank").cast("long"))


# JOIN-7: tokens minus stop words and own-name words, counted --------------------------------
@register("join7_theme_tokens", psql("SELECT scope, entity, token, count FROM tcount"))
def join7_theme_tokens(spark, sf):
    return prof.theme_counts(A(spark, sf).by_post, P)


# AGG-4 ----------------------------------------------------------------------
@register("agg4_audience", psql("SELECT * FROM audience"))
def agg4_audience(spark, sf):
    return A(spark, sf).part("audience")


# AGG-5 / JOIN-5 -------------------------------------------------------------------
@register("agg5_support", psql("SELECT scope, entity, category, ordinal, mentions, strength FROM support"))
def agg5_support(spark, sf):
    return A(spark, sf).part("support").select(*KEY, "category", "ordinal", "mentions", "strength")


# JOIN-6: post x region keyword (every hit) ------------------------------------------------
@register("join6_region_hits", psql("SELECT scope, entity, region, mentions FROM region_hits"))
def join6_region_hits(spark, sf):
    a = A(spark, sf)
    p = P.with_(regions_top=len(P.region_keywords))
    return prof.regional_mentions(a.by_post, p).select(*KEY, "region", "mentions")


# AGG-6 / WIN-4 ----------------------------------------------------------------------
@register("agg6_regions", psql("SELECT scope, entity, region, mentions, rank::BIGINT AS rank FROM regions"))
def agg6_regions(spark, sf):
    return A(spark, sf).part("regions").withColumn("rank", F.col("rank").cast("long"))


# AGG-8 / AGG-9 ----------------------------------------------------------------------
@register("agg8_engagement", psql("SELECT scope, entity, total_likes, total_shares, avg_likes FROM engagement"))
def agg8_engagement(spark, sf):
    return A(spark, sf).part("engagement").drop("post_count")


@register("agg9_post_count", psql("SELECT scope, entity, post_count FROM engagement"))
def agg9_post_count(spark, sf):
    return A(spark, sf).part("engagement").select(*KEY, "post_count")


# AGG-7: demographic bundle, flattened to strings in display order -------------------------
@register("agg7_demographics", psql("""SELECT k.scope, k.entity,
  (SELECT string_agg(a.platform || ':' || a.posts || ':' || a.share_pct, ';' ORDER BY a.posts DESC, a.platform)
     FROM audience a WHERE a.scope = k.scope AND a.entity = k.entity) AS audience,
  (SELECT string_agg(s.category || ':' || s.mentions || ':' || s.strength, ';' ORDER BY s.mentions DESC, s.ordinal)
     FROM support s WHERE s.scope = k.scope AND s.entity = k.entity) AS support,
  (SELECT string_agg(r.region || ':' || r.mentions, ';' ORDER BY r.rank)
     FROM regions r WHERE r.scope = k.scope AND r.entity = k.entity) AS regions
FROM ekeys k"""))
def agg7_demographics(spark, sf):
    pr = A(spark, sf).part("profiles")
    d = F.col("demographic_insights")
    aud = F.map_entries(d["platform_audience"])
    fmt_aud = F.transform(aud, lambda e: F.concat_ws(":", e["key"], e["value"]["posts"].cast("string"),
                                                     e["value"]["share_pct"].cast("string")))
    fmt_sup = F.transform(d["support_indicators"], lambda s: F.concat_ws(
        ":", s["category"], s["mentions"].cast("string"), s["strength"]))
    fmt_reg = F.transform(d["regional_mentions"], lambda r: F.concat_ws(
        ":", r["region"], r["mentions"].cast("string")))

    def nz(c):
        return F.when(F.size(c) > 0, F.array_join(c, ";"))
    return pr.select(*KEY, nz(fmt_aud).alias("audience"), nz(fmt_sup).alias("support"),
                     nz(fmt_reg).alias("regions"))


# AGG-10 / JOIN-9: assembled profile, flattened --------------------------------------------
@register("agg10_profiles", psql("""SELECT k.scope, k.entity, e.mention_count,
  array_to_string(e.platforms, ',') AS platforms_found,
  s.overall_score, s.positive_pct, s.negative_pct, s.neutral_pct, s.total_analyzed,
  (SELECT count(*) FROM pbreak b WHERE b.scope = k.scope AND b.entity = k.entity) AS n_platforms,
  (SELECT count(*) FROM excerpts x WHERE x.scope = k.scope AND x.entity = k.entity AND x.label = 'positive') AS n_positive,
  (SELECT count(*) FROM excerpts x WHERE x.scope = k.scope AND x.entity = k.entity AND x.label = 'negative') AS n_negative,
  coalesce((SELECT string_agg(t.theme, ',' ORDER BY t.rank) FROM themes t
            WHERE t.scope = k.scope AND t.entity = k.entity), '') AS themes,
  g.total_likes, g.total_shares, g.avg_likes, g.post_count
FROM ekeys k JOIN entities e ON e.scope = k.scope AND e.name = k.entity
JOIN summary s ON s.scope = k.scope AND s.entity = k.entity
JOIN engagement g ON g.scope = k.scope AND g.entity = k.entity"""))
def agg10_profiles(spark, sf):
    pr = A(spark, sf).part("profiles")
    s, g = F.col("sentiment"), F.col("engagement")
    return pr.select(
        *KEY, "mention_count", joined("platforms_found"),
        s["overall_score"].alias("overall_score"), s["positive_pct"].alias("positive_pct"),
        s["negative_pct"].alias("negative_pct"), s["neutral_pct"].alias("neutral_pct"),
        s["total_analyzed"].alias("total_analyzed"),
        F.size(F.map_keys("platform_breakdown")).cast("long").alias("n_platforms"),
        F.size("top_positive_excerpts").cast("long").alias("n_positive"),
        F.size("top_negative_excerpts").cast("long").alias("n_negative"),
        F.array_join(F.transform("key_themes", lambda t: t["theme"]), ",").alias("themes"),
        g["total_likes"].alias("total_likes"), g["total_shares"].alias("total_shares"),
        g["avg_likes"].alias("avg_likes"), "post_count")


# AGG-10 / SNK-7: every nested value of the profiles, one row each ----------------------------
NESTED_SQL = """SELECT scope, entity, 'platforms' AS section, platform AS name, NULL::VARCHAR AS txt, count AS n,
  score AS x, positive_pct AS y, negative_pct AS z FROM pbreak
UNION ALL SELECT scope, entity, label, platform, text || ' @ ' || date, rank, score, NULL, NULL FROM excerpts
UNION ALL SELECT scope, entity, 'themes', theme, NULL, count, rank::DOUBLE, NULL, NULL FROM themes
UNION ALL SELECT scope, entity, 'audience', platform, NULL, posts, share_pct, NULL, NULL FROM audience
UNION ALL SELECT scope, entity, 'support', category, strength, mentions,
  (row_number() OVER (PARTITION BY scope, entity ORDER BY mentions DESC, ordinal))::DOUBLE, NULL, NULL FROM support
UNION ALL SELECT scope, entity, 'regions', region, NULL, mentions, rank::DOUBLE, NULL, NULL FROM regions
UNION ALL SELECT scope, entity, 'sentiment', NULL, NULL, total_analyzed, overall_score, positive_pct, negative_pct
  FROM summary
UNION ALL SELECT scope, entity, 'engagement', NULL, NULL, post_count, avg_likes, total_likes::DOUBLE, total_shares::DOUBLE
  FROM engagement"""


def nested_rows(pr):
    """(scope, entity, section, name, txt, n, x, y, z): the nested values of profile rows."""
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    d = F.col("demographic_insights")

    def rows(section, items, name, txt, n, x, y=None, z=None):
        v, i = F.col("v"), F.col("i") + 1
        e = pr.select(*KEY, F.posexplode(items).alias("i", "v"))
        pick = lambda f: none_s if f is None else f(v, i)
        num = lambda f: none_d if f is None else f(v, i).cast("double")
        return e.select(*KEY, F.lit(section).alias("section"), pick(name).alias("name"), pick(txt).alias("txt"),
                        n(v, i).cast("long").alias("n"), num(x).alias("x"), num(y).alias("y"), num(z).alias("z"))

    excerpt = lambda v, i: F.concat(v["text"], F.lit(" @ "), v["date"])
    parts = [
        rows("platforms", F.map_entries("platform_breakdown"), lambda v, i: v["key"], None,
             lambda v, i: v["value"]["count"], lambda v, i: v["value"]["score"],
             lambda v, i: v["value"]["positive_pct"], lambda v, i: v["value"]["negative_pct"]),
        *[rows(label, F.col(f"top_{label}_excerpts"), lambda v, i: v["platform"], excerpt, lambda v, i: i,
               lambda v, i: v["score"]) for label in ("positive", "negative")],
        rows("themes", F.col("key_themes"), lambda v, i: v["theme"], None, lambda v, i: v["count"], lambda v, i: i),
        rows("audience", F.map_entries(d["platform_audience"]), lambda v, i: v["key"], None,
             lambda v, i: v["value"]["posts"], lambda v, i: v["value"]["share_pct"]),
        rows("support", d["support_indicators"], lambda v, i: v["category"], lambda v, i: v["strength"],
             lambda v, i: v["mentions"], lambda v, i: i),
        rows("regions", d["regional_mentions"], lambda v, i: v["region"], None, lambda v, i: v["mentions"],
             lambda v, i: i),
        rows("sentiment", F.array("sentiment"), None, None, lambda v, i: v["total_analyzed"],
             lambda v, i: v["overall_score"], lambda v, i: v["positive_pct"], lambda v, i: v["negative_pct"]),
        rows("engagement", F.array(F.struct("engagement.*", "post_count")), None, None, lambda v, i: v["post_count"],
             lambda v, i: v["avg_likes"], lambda v, i: v["total_likes"], lambda v, i: v["total_shares"]),
    ]
    return reduce(DataFrame.unionAll, parts)


@register("agg10_nested", psql(NESTED_SQL))
def agg10_nested(spark, sf):
    return nested_rows(A(spark, sf).part("profiles"))


# WIN-5: profiles ranked by mean score within a scope ----------------------------------------
@register("win5_profile_rank", psql("""SELECT scope, entity, overall_score,
  row_number() OVER (PARTITION BY scope ORDER BY overall_score DESC, entity) AS profile_rank
FROM summary"""))
def win5_profile_rank(spark, sf):
    return prof.rank_profiles(A(spark, sf).part("summary")).select(
        *KEY, "overall_score", F.col("profile_rank").cast("long").alias("profile_rank"))


# AGG-11: executive summary per scope --------------------------------------------------------
@register("agg11_exec_summary", psql("""SELECT e.scope, count(*) AS entities,
  coalesce(sum(g.post_count), 0)::BIGINT AS total_posts,
  array_to_string(list_sort(list_distinct(flatten(list(e.platforms)))), ',') AS platforms
FROM entities e JOIN engagement g ON g.scope = e.scope AND g.entity = e.name
GROUP BY e.scope"""))
def agg11_exec_summary(spark, sf):
    a = A(spark, sf)
    return prof.executive_summary(a.entities, a.part("engagement")).select(
        "scope", "entities", "total_posts", joined("platforms"))


# AGG-12: distinct authors per scope -------------------------------------------------------
@register("agg12_authors", f"""WITH {O.POSTS_V}
SELECT scope, count(DISTINCT author) AS distinct_authors FROM posts_v GROUP BY scope""")
def agg12_authors(spark, sf):
    from .catalog import posts
    return prof.distinct_authors(posts(spark, sf))


# AGG-13: entity listing with the +-0.05 label ---------------------------------------------
@register("agg13_listing", psql("""SELECT e.scope, e.name AS entity, e.mention_count, s.overall_score,
  CASE WHEN s.overall_score > 0.05 THEN 'Positive' WHEN s.overall_score < -0.05 THEN 'Negative'
       ELSE 'Neutral' END AS listing_label
FROM entities e JOIN summary s ON s.scope = e.scope AND s.entity = e.name"""))
def agg13_listing(spark, sf):
    a = A(spark, sf)
    return prof.entity_listing(a.entities, a.part("summary"))


# AGG-14: platform set per scope (union of the entities' platform arrays) ----------------------
@register("agg14_platform_sets", psql("""SELECT scope,
  array_to_string(list_sort(list_distinct(flatten(list(platforms)))), ',') AS platforms
FROM merged GROUP BY scope"""))
def agg14_platform_sets(spark, sf):
    m = A(spark, sf).discovery.merged
    return (m.select("scope", F.explode("platforms").alias("p")).groupBy("scope")
            .agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("platforms")))


# AGG-15: breakdown listing with the first five themes ----------------------------------------
@register("agg15_breakdown", psql("""SELECT s.scope, s.entity, s.overall_score, s.positive_pct,
  s.negative_pct, s.neutral_pct,
  coalesce((SELECT string_agg(t.theme, ', ' ORDER BY t.rank) FROM themes t
            WHERE t.scope = s.scope AND t.entity = s.entity AND t.rank <= 5), '') AS themes
FROM summary s"""))
def agg15_breakdown(spark, sf):
    a = A(spark, sf)
    return prof.breakdown_listing(a.part("summary"), a.part("themes"))


# JOIN-10: every scope of the data, with its profiles (empty scope kept) ------------------------
@register("join10_scope_profiles", psql("""SELECT d.scope, s.entity, s.overall_score
FROM (SELECT DISTINCT lang AS scope FROM documents) d LEFT JOIN summary s USING (scope)"""))
def join10_scope_profiles(spark, sf):
    a = A(spark, sf)
    scopes = read_table(spark, sf, "documents").select(F.col("lang").alias("scope")).distinct()
    return scopes.join(a.part("summary").select(*KEY, "overall_score"), "scope", "left")


# JOIN-5: post x support category hits (before counting) -----------------------------------
@register("join5_support_hits", psql(f"""SELECT ep.post_id, ep.entity, c.category FROM ep,
  (VALUES {_CATS_VALUES}) c(category, ordinal, kws)
WHERE contains(lower(ep.text), lower(ep.entity))
  AND list_bool_or(list_transform(c.kws, lambda k: contains(lower(ep.text), k)))"""))
def join5_support_hits(spark, sf):
    ep = A(spark, sf).entity_posts
    tl = F.lower("text")
    cats = F.array(*[F.struct(F.lit(c).alias("category"), F.array(*[F.lit(k) for k in kws]).alias("kws"))
                     for c, kws in P.support_categories.items()])
    hits = F.filter(cats, lambda c: F.exists(c["kws"], lambda k: F.instr(tl, k) > 0))
    return (ep.filter(F.instr(tl, F.lower("entity")) > 0)
            .select("post_id", "entity", F.explode(hits).alias("c"))
            .select("post_id", "entity", F.col("c.category").alias("category")))


# WIN-9: the sorted sentiment export (scope, entity, score desc) ------------------------------
@register("win9_sorted_export", psql("""SELECT p.scope, f.entity, f.score, f.post_id
FROM fanout f JOIN posts_v p ON p.post_id = f.post_id"""))
def win9_sorted_export(spark, sf):
    from .catalog import posts
    a = A(spark, sf)
    p = posts(spark, sf).select("post_id", "scope")
    return (a.sentiment.select("post_id", "entity", "score").join(p, "post_id")
            .orderBy("scope", "entity", F.col("score").desc(), "post_id")
            .select("scope", "entity", "score", "post_id"))
