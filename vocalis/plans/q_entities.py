"""Registered entity-discovery queries (ENT-1 .. ENT-16, JOIN-2, JOIN-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.containment import contains_join, name_hits
from ..operators.entities import role_detection, stage_funnel
from ..operators.mentions import NAME_RE, extract_mentions
from ..operators.proximity import window_stats_join
from ..operators.variants import inclusion_edges, word_set
from . import oracle as O
from .catalog import P, discovery, joined, posts, register, stored_posts

TITLED = P.with_(title_prefixes=("general",))
ROLE_NAMES = ("apache license", "general public license", "gnu", "licensed")


# ENT-1: raw regex matches ------------------------------------------------------
@register("ent1_extract", "WITH " + O.mention_ctes(P) + """
SELECT scope, post_id, pos::BIGINT AS pos, match FROM m0""")
def ent1_extract(spark, sf):
    ps = posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    return ps.select("scope", "post_id", F.posexplode(
        F.regexp_extract_all("text", F.lit(NAME_RE), 1)).alias("pos", "match")) \
        .select("scope", "post_id", F.col("pos").cast("long").alias("pos"), "match")


# ENT-2: stop names removed (no titles configured) -------------------------------
@register("ent2_stop_names", "WITH " + O.mention_ctes(P) + """
SELECT scope, post_id, pos::BIGINT AS pos, name FROM m""")
def ent2_stop_names(spark, sf):
    m = extract_mentions(posts(spark, sf).filter(F.col("scope").isin(list(P.scopes))), P)
    return m.select("scope", "post_id", F.col("pos").cast("long").alias("pos"), "name")


# ENT-3: title stripping ('general' as a title) ----------------------------------
@register("ent3_titles", "WITH " + O.mention_ctes(TITLED) + """
SELECT scope, post_id, pos::BIGINT AS pos, raw, name FROM m""")
def ent3_titles(spark, sf):
    m = extract_mentions(posts(spark, sf).filter(F.col("scope").isin(list(P.scopes))), TITLED)
    return m.select("scope", "post_id", F.col("pos").cast("long").alias("pos"), "raw", "name")


# ENT-4 / AGG-14: mention aggregation -----------------------------------------------
@register("ent4_mentions", "WITH " + O.mention_ctes(P) + """
SELECT scope, name, cnt, array_to_string(platforms, ',') AS platforms,
       first_seen.t AS first_ts, -first_seen.p AS first_post, -first_seen.q AS first_pos
FROM names""")
def ent4_mentions(spark, sf):
    n = discovery(spark, sf).names
    return n.select("scope", "name", "cnt", joined("platforms"),
                    F.col("first_seen.t").alias("first_ts"),
                    (-F.col("first_seen.p")).alias("first_post"),
                    (-F.col("first_seen.q")).alias("first_pos"))


# JOIN-2: verified posts x names pairs ----------------------------------------------
@register("join2_contains", "WITH RECURSIVE " + O.mention_ctes(P) + ",\n" + O.pair_ctes(P) + """
SELECT post_id, scope, name, platform FROM pairs""")
def join2_contains(spark, sf):
    ps = stored_posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    names = discovery(spark, sf).names
    return contains_join(ps, names, names.count()).select("post_id", "scope", "name", "platform")


# ENT-5: case-insensitive recount ----------------------------------------------------
@register("ent5_recount", "WITH RECURSIVE " + O.mention_ctes(P) + ",\n" + O.pair_ctes(P) + """
SELECT scope, name, cnt, array_to_string(platforms, ',') AS platforms FROM nodes""")
def ent5_recount(spark, sf):
    return discovery(spark, sf).nodes.select("scope", "name", "cnt", joined("platforms"))


# JOIN-3: word-set inclusion edges ---------------------------------------------------
@register("join3_inclusion", "WITH " + O.mention_ctes(P) + """,
w AS (SELECT scope, name, list_distinct(string_split(lower(name), ' ')) AS words FROM names)
SELECT a.scope, a.name AS a, b.name AS b FROM w a JOIN w b
  ON a.scope = b.scope AND a.name <> b.name
 AND (list_has_all(a.words, b.words) OR list_has_all(b.words, a.words))""")
def join3_inclusion(spark, sf):
    names = discovery(spark, sf).names.withColumn("words", word_set())
    return inclusion_edges(names)


# ENT-6: variant merge -------------------------------------------------------------
@register("ent6_merge", "WITH RECURSIVE " + O.mention_ctes(P) + ",\n" + O.pair_ctes(P) + ",\n"
          + O.merge_ctes() + """
SELECT scope, name, cnt, array_to_string(platforms, ',') AS platforms FROM merged""")
def ent6_merge(spark, sf):
    return discovery(spark, sf).merged.select("scope", "name", "cnt", joined("platforms"))


# ENT-7: minimum mentions ----------------------------------------------------------
@register("ent7_min_mentions", "WITH RECURSIVE " + O.mention_ctes(P) + ",\n" + O.pair_ctes(P)
          + ",\n" + O.merge_ctes() + f"""
SELECT scope, name, cnt FROM merged WHERE cnt >= {P.min_mentions}""")
def ent7_min_mentions(spark, sf):
    return discovery(spark, sf).merged.filter(F.col("cnt") >= P.min_mentions) \
        .select("scope", "name", "cnt")


# ENT-8: overlapping occurrences per pair ---------------------------------------------
@register("ent8_windows", "WITH RECURSIVE " + O.mention_ctes(P) + ",\n" + O.pair_ctes(P) + """
SELECT post_id, scope, name, count(*)::BIGINT AS occ, min(pos)::BIGINT AS first_pos,
       max(pos)::BIGINT AS last_pos
FROM occ GROUP BY post_id, scope, name""")
def ent8_windows(spark, sf):
    ps = stored_posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    return name_hits(ps, discovery(spark, sf).names, ()).select(
        "post_id", "scope", "name", F.col("n").cast("long").alias("occ"),
        F.col("first").cast("long").alias("first_pos"), F.col("last").cast("long").alias("last_pos"))


# ENT-9 / ENT-10: proximity counters per pair --------------------------------------------
@register("ent9_proximity", "WITH RECURSIVE " + O.mention_ctes(P) + ",\n" + O.pair_ctes(P) + """
SELECT post_id, scope, name, occ::BIGINT AS occ, role_hits::BIGINT AS role_hits,
       rival_hits::BIGINT AS rival_hits, role_scope_hits::BIGINT AS role_scope_hits,
       context_score::BIGINT AS context_score
FROM pair_stats""")
def ent9_proximity(spark, sf):
    d = discovery(spark, sf)
    return d.pairs.select("post_id", "scope", "name",
                          *[F.col(c).cast("long").alias(c) for c in
                            ("occ", "role_hits", "rival_hits", "role_scope_hits", "context_score")])


# the same counters from the characters around anchor hits, the way of more names than a broadcast holds
@register("ent9_from_windows", "WITH RECURSIVE " + O.mention_ctes(P) + ",\n" + O.pair_ctes(P) + """
SELECT post_id, scope, name, occ::BIGINT AS occ, role_hits::BIGINT AS role_hits,
       rival_hits::BIGINT AS rival_hits, role_scope_hits::BIGINT AS role_scope_hits,
       context_score::BIGINT AS context_score
FROM pair_stats""")
def ent9_from_windows(spark, sf):
    ps = stored_posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    found = window_stats_join(ps, discovery(spark, sf).names, P)
    return found.select("post_id", "scope", "name", *[F.col(c).cast("long").alias(c) for c in (
        "occ", "role_hits", "rival_hits", "role_scope_hits", "context_score")])


@register("ent10_context", "WITH RECURSIVE " + O.mention_ctes(P) + ",\n" + O.pair_ctes(P) + """
SELECT scope, name, context_score FROM name_stats""")
def ent10_context(spark, sf):
    d = discovery(spark, sf)
    return d.pairs.groupBy("scope", "name").agg(
        F.sum("context_score").cast("long").alias("context_score"))


# ENT-11: gates ---------------------------------------------------------------------
@register("ent11_gates", "WITH RECURSIVE " + O.mention_ctes(P) + ",\n" + O.pair_ctes(P) + ",\n"
          + O.merge_ctes() + ",\n" + O.scored_ctes(P) + """
SELECT scope, name, role_hits, rival_hits, role_scope_hits, context_score FROM scored""")
def ent11_gates(spark, sf):
    return discovery(spark, sf).scored.select(
        "scope", "name", "role_hits", "rival_hits", "role_scope_hits", "context_score")


# ENT-12: score ---------------------------------------------------------------------
@register("ent12_score", O.discovery_sql(P, """
SELECT scope, name, mention_count, round(score, 6) AS score FROM scored"""))
def ent12_score(spark, sf):
    return discovery(spark, sf).scored.select(
        "scope", "name", "mention_count", F.round("score", 6).alias("score"))


# ENT-13 / WIN-1: top-k per scope --------------------------------------------------------
@register("ent13_topk", O.discovery_sql(P, """
SELECT scope, name, rank::BIGINT AS rank, array_to_string(platforms, ',') AS platforms FROM entities"""))
def ent13_topk(spark, sf):
    return discovery(spark, sf).entities.select(
        "scope", "name", F.col("rank").cast("long").alias("rank"), joined("platforms"))


# ENT-14: the whole discovery, every configured scope (empty scope -> null row) --------------
_SCOPES_SQL = "(SELECT unnest(" + O.lst(P.scopes) + ") AS scope)"


@register("ent14_discover", O.discovery_sql(P, f"""
SELECT s.scope, e.name, e.mention_count, array_to_string(e.platforms, ',') AS platforms,
       round(e.score, 6) AS score, e.context_score, e.rank::BIGINT AS rank
FROM {_SCOPES_SQL} s LEFT JOIN entities e USING (scope)"""), headline=True)
def ent14_discover(spark, sf):
    from ..operators.entities import entities_by_scope_list
    scopes = spark.createDataFrame([(s,) for s in P.scopes], "scope string")
    return entities_by_scope_list(discovery(spark, sf), scopes).select(
        "scope", "name", "mention_count", joined("platforms"), F.round("score", 6).alias("score"),
        "context_score", F.col("rank").cast("long").alias("rank"))


# ENT-15: stage funnel ----------------------------------------------------------------
@register("ent15_funnel", O.discovery_sql(P, """
SELECT n.scope, n.raw_names, coalesce(m.merged_names, 0) AS merged_names,
       coalesce(e.accepted_names, 0) AS accepted_names
FROM (SELECT scope, count(*) AS raw_names FROM names GROUP BY scope) n
LEFT JOIN (SELECT scope, count(*) AS merged_names FROM merged GROUP BY scope) m USING (scope)
LEFT JOIN (SELECT scope, count(*) AS accepted_names FROM entities GROUP BY scope) e USING (scope)"""))
def ent15_funnel(spark, sf):
    return stage_funnel(discovery(spark, sf))


# ENT-16: role detection for supplied names ---------------------------------------------
_ROLE_SQL = f"""WITH RECURSIVE {O.POSTS_V}, {O.posts_in_scope(P)},
sup AS (SELECT s.scope, n.name FROM (SELECT DISTINCT scope FROM posts) s,
        (SELECT unnest({O.lst(ROLE_NAMES)}) AS name) n),
pr AS (SELECT ps.post_id, ps.scope, s.name, lower(ps.text) AS tl, lower(s.name) AS nl
       FROM posts ps JOIN sup s ON ps.scope = s.scope AND contains(lower(ps.text), lower(s.name))),
occ(post_id, scope, name, tl, nl, pos) AS (
        SELECT post_id, scope, name, tl, nl, instr(tl, nl) FROM pr
        UNION ALL
        SELECT post_id, scope, name, tl, nl, pos + instr(substr(tl, pos + 1), nl)
        FROM occ WHERE instr(substr(tl, pos + 1), nl) > 0),
win AS (SELECT scope, name,
        substr(tl, greatest(1, pos - {P.role_window}), pos + length(nl) + {P.role_window} - greatest(1, pos - {P.role_window})) AS rw
        FROM occ),
agg AS (SELECT scope, name, sum({O.any_in('rw', P.role_keywords)}::INT)::BIGINT AS role_hits,
        sum({O.any_in('rw', P.rival_keywords)}::INT)::BIGINT AS rival_hits FROM win GROUP BY scope, name)
SELECT scope, name, role_hits, rival_hits,
  CASE WHEN role_hits > rival_hits THEN 'more role' WHEN rival_hits > role_hits THEN 'more rival'
       ELSE 'tie' END AS verdict
FROM agg WHERE role_hits > 0 OR rival_hits > 0"""


@register("ent16_roles", _ROLE_SQL)
def ent16_roles(spark, sf):
    ps = posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    names = spark.createDataFrame([(n,) for n in ROLE_NAMES], "name string")
    return role_detection(ps, names, P).select(
        "scope", "name", F.col("role_hits").cast("long").alias("role_hits"),
        F.col("rival_hits").cast("long").alias("rival_hits"), "verdict")


# ENT-16 through postings: every discovered name and its words, in any scope -------------------
@register("ent16_many_names", f"""WITH RECURSIVE {O.mention_ctes(P)},
sup AS (SELECT DISTINCT unnest(list_concat([lower(name)], string_split(lower(name), ' '))) AS nl FROM names),
pr AS (SELECT ps.post_id, ps.scope, nl AS name, lower(ps.text) AS tl, nl
       FROM posts ps JOIN sup ON contains(lower(ps.text), nl)),
occ(post_id, scope, name, tl, nl, pos) AS (
        SELECT post_id, scope, name, tl, nl, instr(tl, nl) FROM pr
        UNION ALL
        SELECT post_id, scope, name, tl, nl, pos + instr(substr(tl, pos + 1), nl)
        FROM occ WHERE instr(substr(tl, pos + 1), nl) > 0),
""" + _ROLE_SQL[_ROLE_SQL.index("win AS"):])
def ent16_many_names(spark, sf):
    ps = stored_posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    words = F.concat(F.array(F.lower("name")), F.split(F.lower("name"), " "))
    names = discovery(spark, sf).names.select(F.explode(words).alias("name")).distinct()
    return role_detection(ps, names, P, broadcast_rows=0).select(
        "scope", "name", F.col("role_hits").cast("long").alias("role_hits"),
        F.col("rival_hits").cast("long").alias("rival_hits"), "verdict")


# ENT-4 (optional column): up to 3 context snippets per name ---------------------------------
@register("ent4_contexts", "WITH " + O.mention_ctes(P) + """,
ranked AS (
  SELECT scope, name, post_id, raw,
    row_number() OVER (PARTITION BY scope, name ORDER BY ts DESC, post_id, pos) AS k
  FROM m QUALIFY k <= 3)
SELECT r.scope, r.name, r.k::BIGINT AS k,
  trim(substr(p.text, greatest(strpos(p.text, r.raw) - 1 - 50, 0) + 1,
       least(length(p.text), strpos(p.text, r.raw) - 1 + length(r.raw) + 50)
       - greatest(strpos(p.text, r.raw) - 1 - 50, 0))) AS context
FROM ranked r JOIN posts p ON p.post_id = r.post_id
WHERE strpos(p.text, r.raw) > 0""")
def ent4_contexts(spark, sf):
    from ..operators.mentions import mention_contexts
    ps = stored_posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    return mention_contexts(discovery(spark, sf).mentions, ps)
