"""Entity discovery for every scope in one plan (ENT-5, ENT-7, ENT-11..16).

    posts --ENT-1..4--> names --JOIN-2 + ENT-8..10--> pair stats
          --ENT-5 recount--> nodes --ENT-6 merge--> merged
          --ENT-7 min count, ENT-11 gates, ENT-12 score--> ENT-13 top-k

No loop over scopes: every step is keyed by ``scope``.  Four
intermediate results are written to the reliable checkpoint folder (names,
pair stats, their sums per name, merge state) because each is reused several times.  The text is
scanned twice: once for the name regex, once for the anchor probe, which up
to ``BROADCAST_ANCHOR_ROWS`` names is fused with the verification and the
window counters in the scan stage, and beyond that ships the characters around
anchor hits (no text shuffle either way).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words_lit
from ..params import Params
from ..session import cut_lineage
from ..sources.posts import restrict
from .containment import contains_join_small
from .mentions import aggregate_mentions, extract_mentions
from .proximity import entity_score, name_stats, pair_stats_join, passes_gates, platform_list
from .variants import merge_variants


@dataclass
class Discovery:
    mentions: DataFrame      # accepted regex matches
    names: DataFrame         # (scope, name, cnt, platforms, first_seen)
    pairs: DataFrame         # (post_id, scope, name, platform, occ, counters)
    nodes: DataFrame         # names after the case-insensitive recount
    merged: DataFrame        # kept names after the variant merge
    scored: DataFrame        # merged names passing min count + gates, scored
    entities: DataFrame      # top-k per scope, with rank


def scoped_posts(posts: DataFrame, p: Params) -> DataFrame:
    return restrict(posts, p.scopes) if p.scopes else posts


def recount(names: DataFrame, stats: DataFrame) -> DataFrame:
    """ENT-5: posts containing the name (any case) replace the occurrence
    count only when larger, and only then its platforms are unioned."""
    j = names.join(stats.select("scope", "name", "ci_posts", "ci_platforms"),
                   ["scope", "name"], "left")
    ci = F.coalesce(F.col("ci_posts"), F.lit(0))
    bigger = ci > F.col("cnt")
    return j.select(
        "scope", "name",
        F.when(bigger, ci).otherwise(F.col("cnt")).alias("cnt"),
        F.when(bigger, F.array_sort(F.array_union("platforms", "ci_platforms")))
         .otherwise(F.col("platforms")).alias("platforms"),
        "first_seen")


def rank_key(cnt="cnt", first_seen="first_seen"):
    return F.struct(F.col(cnt).alias("c"), F.col(first_seen).alias("f"))


def score_and_rank(merged: DataFrame, stats: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """ENT-7, ENT-11..13 on merged names ``(scope, name, cnt, platforms, rk)``
    and per-name proximity sums: (scored, top-k entities)."""
    scored = (merged.filter(F.col("cnt") >= p.min_mentions)
              .join(stats.drop("ci_posts", "ci_platforms"), ["scope", "name"])
              .filter(passes_gates())
              .withColumnRenamed("cnt", "mention_count")
              .withColumn("score", entity_score()))
    w = Window.partitionBy("scope").orderBy(F.col("score").desc(), F.col("rk").desc())
    entities = (scored.withColumn("rank", F.row_number().over(w))
                .filter(F.col("rank") <= p.top_k))
    return scored, entities


def filter_entities(merged: DataFrame, posts: DataFrame, p: Params) -> DataFrame:
    """The proximity filter alone: given (merged) names with counts and
    platforms, the posts of their scopes -> accepted, scored, ranked names."""
    posts = scoped_posts(posts, p)
    names = merged.select("scope", "name")
    pairs = pair_stats_join(posts, names, names.count(), p)
    _, entities = score_and_rank(merged, name_stats(pairs), p)
    return entities


def discover(posts: DataFrame, p: Params) -> Discovery:
    posts = scoped_posts(posts, p)
    mentions = extract_mentions(posts, p)
    names = cut_lineage(aggregate_mentions(mentions))
    n_names = names.count()
    pairs = cut_lineage(pair_stats_join(posts, names, n_names, p))
    # read by the recount and the scores: once per pair, not once per reader
    stats = cut_lineage(name_stats(pairs, platform_list(posts)))
    nodes = recount(names, stats).withColumn("rk", rank_key())
    merged = merge_variants(nodes)
    scored, entities = score_and_rank(merged, stats, p)
    return Discovery(mentions, names, pairs, nodes, merged, scored, entities)


def entity_table(d: Discovery) -> DataFrame:
    """The stored entity table (scope, name, mention_count, platforms, score,
    context_score, rank)."""
    return d.entities.select("scope", "name", "mention_count", "platforms", "score",
                             "context_score", "role_hits", "rival_hits",
                             "role_scope_hits", "rank")


# ENT-14: every configured scope is reported, an empty one with no rows.
def entities_by_scope_list(d: Discovery, scopes_df: DataFrame) -> DataFrame:
    return scopes_df.join(entity_table(d), "scope", "left")


# ENT-15 ---------------------------------------------------------------------
def stage_funnel(d: Discovery) -> DataFrame:
    raw = d.names.groupBy("scope").agg(F.count(F.lit(1)).alias("raw_names"))
    merged = d.merged.groupBy("scope").agg(F.count(F.lit(1)).alias("merged_names"))
    acc = d.entities.groupBy("scope").agg(F.count(F.lit(1)).alias("accepted_names"))
    return (raw.join(merged, "scope", "left").join(acc, "scope", "left")
            .select("scope", "raw_names",
                    F.coalesce("merged_names", F.lit(0)).cast("long").alias("merged_names"),
                    F.coalesce("accepted_names", F.lit(0)).cast("long").alias("accepted_names")))


# ENT-16 ---------------------------------------------------------------------
def role_detection(posts: DataFrame, supplied: DataFrame, p: Params,
                   broadcast_rows: int | None = None) -> DataFrame:
    """Role / rival hits of supplied ``(scope, name)`` rows and a verdict;
    rows with no hit of either kind are hidden, so texts without a role or
    rival keyword are left out before the join.  Up to ``broadcast_rows`` names
    (``BROADCAST_ANCHOR_ROWS``) the join is fused (``contains_join_small``).
    Beyond, the hits are added up where a text is read (``near_sums``); posts
    whose id others share go through the postings of ``contains_join_small``,
    which match all texts of an id, and posts without an id are left out."""
    from . import containment as C
    from .proximity import holds_keyword, pair_counters, scope_variants_col

    def pair_fn(tl, c):
        return pair_counters(tl, c["nl"], scope_variants_col(F.col("scope"), p), p)

    def joined(some, rows):
        return (contains_join_small(some, supplied, pair_fn=pair_fn, broadcast_rows=rows)
                .select("scope", "name", F.col("x.g").alias("role_hits"), F.col("x.r").alias("rival_hits")))

    posts = scoped_posts(posts, p)
    posts = posts.filter(holds_keyword(F.lower("text"), p))
    names = C.supplied_names(supplied)
    if names.count() <= (C.BROADCAST_ANCHOR_ROWS if broadcast_rows is None else broadcast_rows):
        stats = joined(posts, broadcast_rows)
    else:
        shared = cut_lineage(posts.filter("post_id IS NOT NULL").groupBy("post_id")
                             .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("post_id"))
        n_shared = shared.count()
        near = {c: (p.role_window, [words_lit(dict.fromkeys(words))])
                for c, words in (("role_hits", p.role_keywords), ("rival_hits", p.rival_keywords))}
        own = posts.filter("post_id IS NOT NULL")
        if n_shared:
            shared = F.broadcast(shared) if n_shared <= C.BROADCAST_ANCHOR_ROWS else shared
            own = own.join(shared, "post_id", "left_anti")
        stats = C.near_sums(own, names, near)
        if n_shared:
            stats = stats.unionByName(joined(posts.join(shared, "post_id", "left_semi"), 0))
    agg = (stats.groupBy("scope", "name")
           .agg(F.sum("role_hits").alias("role_hits"), F.sum("rival_hits").alias("rival_hits")))
    verdict = (F.when(F.col("role_hits") > F.col("rival_hits"), "more role")
               .when(F.col("rival_hits") > F.col("role_hits"), "more rival")
               .otherwise("tie"))
    return (agg.filter((F.col("role_hits") > 0) | (F.col("rival_hits") > 0))
               .withColumn("verdict", verdict))
