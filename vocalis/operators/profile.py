"""Entity profiles (AGG-1 .. AGG-15, WIN-2 .. WIN-5, JOIN-5 .. JOIN-9).

Inputs, all keyed by ``(scope, entity)``:

* ``entity_posts``: posts mentioning an entity (the JOIN-2 pairs restricted
  to the accepted entities, joined with the post columns);
* ``sentiment``: the fan-out rows (SEN-8) of the accepted entities.

Every part is a flat table produced by a partial (map-side) aggregation
keyed by ``(scope, entity, ...)``; top-k parts use ``row_number() <= k``
windows, which Spark plans as a window-group-limit (partial top-k before the
shuffle).  The nested profile (AGG-10) only collects already-bounded lists
(<= k themes / excerpts / regions, one entry per platform or category).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exact_mean, round_half_even, truncate_excerpt, words_lit
from ..params import Params
from ..session import cut_lineage
from .mentions import split_words

KEY = ("scope", "entity")


# Rows of two short strings (~60 bytes) up to which a list is broadcast.
BROADCAST_ROWS = 200_000


def _pct(part: Column, total: Column) -> Column:
    return round_half_even(part / total * 100, 1)


def entity_keys(entities: DataFrame) -> DataFrame:
    return entities.select("scope", F.col("name").alias("entity"))


def entity_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """JOIN-2 pairs of accepted entities: ``(post_id, scope, entity)``.
    The entity side (top_k per scope of the data) is counted, and broadcast up
    to ``BROADCAST_ROWS``; beyond, the join shuffles ids and names."""
    keys = entity_keys(entities)
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return (pairs.select("post_id", "scope", F.col("name").alias("entity"))
            .join(keys, ["scope", "entity"]))


#: the post columns a profile needs
POST_FIELDS = ("platform", "text", "ts", "likes", "shares")
#: those of the parts that read no text
COUNTED_FIELDS = ("platform", "likes", "shares")


def posts_with_entities(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts mentioning an entity, one row per post: the post columns the
    profile needs and ``ents``, its ``(scope, entity)`` pairs (at most top_k of
    its scope), so that a text is kept and read once, not once per entity."""
    ents = (pairs.filter("post_id IS NOT NULL").groupBy("post_id")
            .agg(F.collect_list(F.struct(*KEY)).alias("ents")))
    return posts.select("post_id", *POST_FIELDS).join(ents, "post_id")


def per_entity(by_post: DataFrame) -> DataFrame:
    """``posts_with_entities`` as one row per entity: ``entity_posts``."""
    rows = by_post.select("post_id", *POST_FIELDS, F.explode("ents").alias("_e"))
    return rows.select("post_id", *[F.col("_e")[k].alias(k) for k in KEY], *POST_FIELDS)


def with_entities(ep: DataFrame) -> DataFrame:
    """Either form of the posts as rows with ``ents``."""
    return ep if "ents" in ep.columns else ep.withColumn("ents", F.array(F.struct(*KEY)))


def entity_posts(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts mentioning each entity with the post columns the profile needs."""
    return per_entity(posts_with_entities(pairs, posts))


def counted_posts(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """``entity_posts`` with the columns of ``engagement`` and
    ``platform_audience`` alone: no text is read, shuffled or kept for them."""
    return pairs.select("post_id", *KEY).join(posts.select("post_id", *COUNTED_FIELDS), "post_id")


# AGG-1 ----------------------------------------------------------------------
def sentiment_summary(entities: DataFrame, sentiment: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    agg = (sentiment.groupBy(*KEY)
           .agg(exact_mean("score", 4).alias("_avg"), n.alias("total_analyzed"),
                F.count_if(F.col("label") == "positive").alias("_pos"),
                F.count_if(F.col("label") == "negative").alias("_neg"),
                F.count_if(F.col("label") == "neutral").alias("_neu")))
    t = F.col("total_analyzed")
    out = entity_keys(entities).join(agg, list(KEY), "left")
    return out.select(
        *KEY,
        F.coalesce(F.col("_avg"), F.lit(0.0)).alias("overall_score"),
        F.coalesce(_pct(F.col("_pos"), t), F.lit(0.0)).alias("positive_pct"),
        F.coalesce(_pct(F.col("_neg"), t), F.lit(0.0)).alias("negative_pct"),
        F.coalesce(_pct(F.col("_neu"), t), F.lit(0.0)).alias("neutral_pct"),
        F.coalesce(t, F.lit(0)).alias("total_analyzed"))


# AGG-2 ----------------------------------------------------------------------
def platform_breakdown(sentiment: DataFrame) -> DataFrame:
    c = F.count(F.lit(1))
    return (sentiment.groupBy(*KEY, "platform")
            .agg(exact_mean("score", 4).alias("score"), c.alias("count"),
                 _pct(F.count_if(F.col("label") == "positive"), c).alias("positive_pct"),
                 _pct(F.count_if(F.col("label") == "negative"), c).alias("negative_pct")))


# WIN-2 ----------------------------------------------------------------------
def top_excerpts(sentiment: DataFrame, posts: DataFrame, p: Params,
                 labels=("positive", "negative")) -> DataFrame:
    """Top-n rows per (entity, label) by |score| desc (ties: post_id); text
    over ``excerpt_chars`` truncated with '...'.  The window runs on ids and
    scores only; the text is joined to the <= n winners."""
    w = Window.partitionBy(*KEY, "label").orderBy(F.abs("score").desc(), F.col("post_id").asc())
    top = (sentiment.filter(F.col("label").isin(list(labels)))
           .select(*KEY, "label", "post_id", "platform", "score")
           .withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= p.excerpts_top))
    texts = posts.select("post_id", "text", "ts")
    return (top.join(texts, "post_id")
            .select(*KEY, "label", "rank", "post_id",
                    truncate_excerpt("text", p.excerpt_chars).alias("text"),
                    "platform", "score",
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date")))


# JOIN-7 / AGG-3 / WIN-3 ---------------------------------------------------------
#: tokens a task holds before their counts leave it, about
HELD_TOKENS = 4_000_000
#: tokens with their count in a scope that are broadcast, about 30 bytes each
FREQUENT_TOKENS = 500_000


def token_lists(ep: DataFrame, p: Params) -> DataFrame:
    """``(ents, tokens)`` per post: whitespace-delimited tokens of the
    lower-cased text that are wholly alphabetic and at least ``theme_min_len``
    long -- one regex pass per post (``(?<!\\S)\\p{L}{n,}(?!\\S)``)."""
    token_re = rf"(?U)(?<!\S)(\p{{L}}{{{p.theme_min_len},}})(?!\S)"
    cores = ep.sparkSession.sparkContext.defaultParallelism
    return with_entities(ep).select(
        F.transform("ents", lambda e: F.struct(*[e[k].alias(k) for k in KEY])).alias("ents"),
        F.regexp_extract_all(F.lower("text"), F.lit(token_re), 1).alias("tokens")).coalesce(2 * cores)


def token_counts(lists: DataFrame, leaving, total: bool = False) -> DataFrame:
    """``(scope, entity, token, count)``.  A post's tokens are counted once,
    whatever the number of its entities; the counts are added up per task, so
    the shuffle gets one row per entity and token of a task, of those that
    ``leaving(scope, entity, words, count)`` (a mask over the distinct ``words``
    of some posts) lets out.  ``total`` adds rows without an entity: a count per
    scope and token that no entity of the scope exceeds."""
    most = HELD_TOKENS

    def add_up(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(pc.list_flatten(b["tokens"]))
            if size >= most:
                yield from counts_of(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from counts_of(pa.Table.from_batches(held))

    def counts_of(table):
        """One batch per entity: its tokens in the texts of ``table``, counted."""
        tokens, ents = (table[c].combine_chunks() for c in ("tokens", "ents"))
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(length) - length
        words = pc.list_flatten(tokens).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        post = pc.list_parent_indices(ents).to_numpy(zero_copy_only=False).astype(np.int64)
        of_entity = {}
        for row, key in zip(post.tolist(), pc.list_flatten(ents).to_pylist()):
            of_entity.setdefault((key["scope"], key["entity"]), []).append(row)
        of_scope = {}
        for (scope, entity), rows in of_entity.items():
            n = length[rows]
            at = np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            count = np.bincount(code[at], minlength=len(words.dictionary))
            yield batch_of(scope, entity, words.dictionary, count, leaving(scope, entity, words.dictionary, count))
            if total:
                # a post counts as often as it names an entity most
                times = np.bincount(rows, minlength=len(length))
                of_scope[scope] = np.maximum(of_scope.get(scope, 0), times)
        for scope, times in of_scope.items():
            count = np.bincount(code, np.repeat(times, length), len(words.dictionary)).astype(np.int64)
            yield batch_of(scope, None, words.dictionary, count, count > 0)

    def batch_of(scope, entity, words, count, mask):
        found = np.flatnonzero(mask & (count > 0))
        return pa.RecordBatch.from_arrays(
            [pa.array([scope] * len(found), pa.string()), pa.array([entity] * len(found), pa.string()),
             words.take(pa.array(found)), pa.array(count[found], pa.int64())],
            names=["scope", "entity", "token", "n"])

    return (lists.mapInArrow(add_up, "scope string, entity string, token string, n long")
            .groupBy(*KEY, "token").agg(F.sum("n").alias("count")))


def drop_stop_tokens(counts: DataFrame, p: Params) -> DataFrame:
    """Counts minus theme stop words (a broadcast anti-join)."""
    stop = list(dict.fromkeys(p.theme_stop_words))
    if not stop:
        return counts
    stop_df = counts.sparkSession.createDataFrame([(w,) for w in stop], "token string")
    stop_df = F.broadcast(stop_df) if len(stop) <= BROADCAST_ROWS else stop_df
    return counts.join(stop_df, "token", "left_anti").select(*KEY, "token", "count")


def drop_own_words(counts: DataFrame) -> DataFrame:
    """Counts minus the words of the entity's own name."""
    name_words = F.transform(split_words(F.col("entity")), lambda w: F.lower(w))
    return counts.filter(~F.array_contains(name_words, F.col("token")))


def theme_counts(ep: DataFrame, p: Params) -> DataFrame:
    """``(scope, entity, token, count)`` of all tokens (``token_lists``) minus
    theme stop words and the entity's own name words."""
    counts = token_counts(token_lists(ep, p), lambda scope, entity, words, count: count > 0)
    return drop_stop_tokens(drop_own_words(counts), p)


def leading_counts(ep: DataFrame, p: Params) -> DataFrame:
    """``theme_counts`` without tokens that cannot be among an entity's
    ``themes_top``: exact counts of all that can.

    One pass counts the tokens per scope, which bounds the count with each of
    its entities from above, and adds up each entity's most frequent tokens of
    every task, which bounds its last theme's count from below.  A second pass
    counts, per entity, the tokens whose upper bound reaches the lower one.
    Tokens beyond ``FREQUENT_TOKENS`` have the least frequent one's count as
    their upper bound."""
    spark = ep.sparkSession
    lists = token_lists(ep, p)
    # enough to leave themes_top tokens when stop and name words are among them
    heads = p.themes_top + len(set(p.theme_stop_words)) + 10

    def head(scope, entity, words, count):
        if len(count) <= heads:
            return count > 0
        return count >= np.partition(count, -heads)[-heads]

    first = cut_lineage(drop_stop_tokens(token_counts(lists, head, total=True), p))
    w = Window.partitionBy(*KEY).orderBy(F.col("count").desc(), F.col("token").asc())
    last = (drop_own_words(first.filter("entity IS NOT NULL"))
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= p.themes_top)
            .groupBy(*KEY).agg(F.min(F.when(F.col("_r") == p.themes_top, F.col("count"))).alias("least"))
            .select(*KEY, F.coalesce("least", F.lit(1)).alias("least")))
    if last.count() > BROADCAST_ROWS:
        return theme_counts(ep, p)
    least = {(r["scope"], r["entity"]): r["least"] for r in last.collect()}
    lowest = last.groupBy("scope").agg(F.min("least").alias("lowest"))
    table = (first.filter("entity IS NULL").join(F.broadcast(lowest.withColumnRenamed("scope", "_s")),
                                                 F.col("scope").eqNullSafe(F.col("_s")))
             .filter(F.col("count") >= F.col("lowest")).select("scope", "token", "count")
             .orderBy(F.col("count").desc()).limit(FREQUENT_TOKENS).toArrow())
    # upper bound of a token that is not in the table
    rest = pc.min(table["count"]).as_py() if len(table) == FREQUENT_TOKENS else 0
    upper = {}
    for scope in {s for s, _ in least}:
        own = table.filter(pc.is_null(table["scope"]) if scope is None else pc.equal(table["scope"], scope))
        upper[scope] = (own["token"].combine_chunks().cast(pa.string()),
                        np.append(own["count"].to_numpy().astype(np.int64), rest))
    shared = spark.sparkContext.broadcast((least, upper))

    def can_lead(scope, entity, words, count):
        least, upper = shared.value
        if (scope, entity) not in least:             # its heads were all dropped
            return count > 0
        tokens, bound = upper[scope]
        at = pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=tokens), len(tokens))
        return bound[at.to_numpy(zero_copy_only=False)] >= least[scope, entity]

    return drop_stop_tokens(drop_own_words(token_counts(lists, can_lead)), p)


def key_themes(ep: DataFrame, p: Params) -> DataFrame:
    counts = leading_counts(ep, p)
    w = Window.partitionBy(*KEY).orderBy(F.col("count").desc(), F.col("token").asc())
    return (counts.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= p.themes_top)
            .select(*KEY, "rank", F.col("token").alias("theme"), "count"))


# AGG-4 ----------------------------------------------------------------------
def platform_audience(ep: DataFrame) -> DataFrame:
    counts = ep.groupBy(*KEY, "platform").agg(F.count(F.lit(1)).alias("posts"))
    tot = F.sum("posts").over(Window.partitionBy(*KEY))
    return counts.withColumn("share_pct", _pct(F.col("posts"), tot))


def named_entities(ep: DataFrame, hits: Callable[[Column], Column]) -> DataFrame:
    """``(scope, entity, _h)`` for each entity whose name the text holds;
    ``hits`` of the lower-cased text is computed once per post.  An array of one
    names that text, so that it is not lower-cased for every entity and keyword."""
    def of_text(tl):
        return F.struct(hits(tl).alias("_h"), F.filter(
            "ents", lambda e: F.instr(tl, F.lower(e["entity"])) > 0).alias("_n"))

    found = with_entities(ep).select(F.inline(F.transform(F.array(F.lower("text")), of_text)))
    return found.select("_h", F.explode("_n").alias("_e")).select(*[F.col("_e")[k].alias(k) for k in KEY], "_h")


# JOIN-5 / AGG-5 ---------------------------------------------------------------
def support_indicators(ep: DataFrame, p: Params) -> DataFrame:
    """Posts per support category (any keyword of the category in the text;
    the entity's name must be in the text too).  Zero rows omitted."""
    cats = list(p.support_categories.items())
    if not cats:
        return ep.sparkSession.createDataFrame(
            [], "scope string, entity string, category string, ordinal int, mentions long, strength string")
    cat_arr = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("category"),
                                 words_lit(kws).alias("kws"))
                        for i, (c, kws) in enumerate(cats)])

    def hits(tl):
        return F.filter(cat_arr, lambda c: F.exists(c["kws"], lambda k: F.instr(tl, k) > 0))

    rows = (named_entities(ep, hits).select(*KEY, F.explode("_h").alias("c"))
            .groupBy(*KEY, F.col("c.category").alias("category"), F.col("c.ordinal").alias("ordinal"))
            .agg(F.count(F.lit(1)).alias("mentions")))
    strength = (F.when(F.col("mentions") >= 3, "strong")
                .when(F.col("mentions") >= 2, "moderate").otherwise("weak"))
    return rows.withColumn("strength", strength)


# JOIN-6 / AGG-6 / WIN-4 ---------------------------------------------------------
def regional_mentions(ep: DataFrame, p: Params) -> DataFrame:
    if not p.region_keywords:
        return ep.sparkSession.createDataFrame(
            [], "scope string, entity string, region string, mentions long, rank int")
    regs = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(r).alias("region"))
                     for i, r in enumerate(p.region_keywords)])

    def hits(tl):
        return F.filter(regs, lambda r: F.instr(tl, r["region"]) > 0)

    rows = (named_entities(ep, hits).select(*KEY, F.explode("_h").alias("r"))
            .groupBy(*KEY, F.col("r.region").alias("region"), F.col("r.ordinal").alias("ordinal"))
            .agg(F.count(F.lit(1)).alias("mentions")))
    w = Window.partitionBy(*KEY).orderBy(F.col("mentions").desc(), F.col("ordinal").asc())
    return (rows.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= p.regions_top).drop("ordinal"))


# AGG-8 / AGG-9 ----------------------------------------------------------------
def engagement(entities: DataFrame, ep: DataFrame) -> DataFrame:
    agg = ep.groupBy(*KEY).agg(F.sum("likes").alias("total_likes"),
                               F.sum("shares").alias("total_shares"),
                               F.avg("likes").alias("_avg"),
                               F.count(F.lit(1)).alias("post_count"))
    return (entity_keys(entities).join(agg, list(KEY), "left")
            .select(*KEY,
                    F.coalesce("total_likes", F.lit(0)).cast("long").alias("total_likes"),
                    F.coalesce("total_shares", F.lit(0)).cast("long").alias("total_shares"),
                    F.coalesce(round_half_even("_avg", 1), F.lit(0.0)).alias("avg_likes"),
                    F.coalesce("post_count", F.lit(0)).cast("long").alias("post_count")))


# AGG-7 / AGG-10 / JOIN-9 ----------------------------------------------------------
def _sorted_list(df: DataFrame, order_cols: list[str], fields: list[str], alias: str) -> DataFrame:
    s = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                 F.struct(*fields).alias("v"))
    return (df.groupBy(*KEY).agg(F.array_sort(F.collect_list(s)).alias("_l"))
            .select(*KEY, F.transform("_l", lambda x: x["v"]).alias(alias)))


def build_profiles(entities: DataFrame, sentiment: DataFrame, ep: DataFrame,
                   posts: DataFrame, p: Params) -> DataFrame:
    """One nested row per entity (AGG-10), parts left-joined (JOIN-9) with
    empty defaults."""
    summary = sentiment_summary(entities, sentiment)
    pb = platform_breakdown(sentiment)
    pb_map = (pb.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct(
        "platform", F.struct("score", "count", "positive_pct", "negative_pct")))).alias(
        "platform_breakdown")))
    ex = top_excerpts(sentiment, posts, p)
    pos = _sorted_list(ex.filter(F.col("label") == "positive"), ["rank"],
                       ["text", "platform", "score", "date"], "top_positive_excerpts")
    neg = _sorted_list(ex.filter(F.col("label") == "negative"), ["rank"],
                       ["text", "platform", "score", "date"], "top_negative_excerpts")
    themes = _sorted_list(key_themes(ep, p), ["rank"], ["theme", "count"], "key_themes")
    pairs = per_entity(ep) if "ents" in ep.columns else ep
    aud = platform_audience(pairs)
    aud_l = (aud.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("posts")).alias("o"), F.col("platform"), F.struct("posts", "share_pct").alias("v"))))
        .alias("_l")).select(*KEY, F.map_from_arrays(F.transform("_l", lambda x: x["platform"]),
                                                       F.transform("_l", lambda x: x["v"]))
                             .alias("platform_audience")))
    sup = support_indicators(ep, p).withColumn("_neg", -F.col("mentions"))
    sup_l = _sorted_list(sup, ["_neg", "ordinal"], ["category", "mentions", "strength"],
                         "support_indicators")
    reg_l = _sorted_list(regional_mentions(ep, p), ["rank"], ["region", "mentions"],
                         "regional_mentions")
    eng = engagement(entities, pairs)

    base = entities.select("scope", F.col("name").alias("entity"), "mention_count",
                           F.col("platforms").alias("platforms_found"), F.col("score").alias("entity_score"))
    out = base
    for part in (summary, pb_map, pos, neg, themes, aud_l, sup_l, reg_l, eng):
        out = out.join(part, list(KEY), "left")
    empty = F.array()
    return out.select(
        *KEY, "mention_count", "platforms_found", "entity_score",
        F.struct("overall_score", "positive_pct", "negative_pct", "neutral_pct",
                 "total_analyzed").alias("sentiment"),
        F.coalesce("platform_breakdown", F.create_map().cast(
            "map<string,struct<score:double,count:bigint,positive_pct:double,negative_pct:double>>"))
         .alias("platform_breakdown"),
        F.coalesce("top_positive_excerpts", empty.cast(
            "array<struct<text:string,platform:string,score:double,date:string>>")).alias("top_positive_excerpts"),
        F.coalesce("top_negative_excerpts", empty.cast(
            "array<struct<text:string,platform:string,score:double,date:string>>")).alias("top_negative_excerpts"),
        F.coalesce("key_themes", empty.cast("array<struct<theme:string,count:bigint>>")).alias("key_themes"),
        F.struct(
            F.coalesce("platform_audience", F.create_map().cast(
                "map<string,struct<posts:bigint,share_pct:double>>")).alias("platform_audience"),
            F.coalesce("support_indicators", empty.cast(
                "array<struct<category:string,mentions:bigint,strength:string>>")).alias("support_indicators"),
            F.coalesce("regional_mentions", empty.cast(
                "array<struct<region:string,mentions:bigint>>")).alias("regional_mentions"),
        ).alias("demographic_insights"),
        F.struct("total_likes", "total_shares", "avg_likes").alias("engagement"),
        "post_count",
    )


# WIN-5 ----------------------------------------------------------------------
def rank_profiles(summary: DataFrame) -> DataFrame:
    """Rank of each entity in its scope by mean score desc (ties: name)."""
    w = Window.partitionBy("scope").orderBy(F.col("overall_score").desc(), F.col("entity").asc())
    return summary.withColumn("profile_rank", F.row_number().over(w))


# AGG-11 ---------------------------------------------------------------------
def executive_summary(entities: DataFrame, eng: DataFrame) -> DataFrame:
    """Per scope: entities, summed post counts (a post with two entities
    counts twice), sorted union of the entities' platforms."""
    j = entities.select("scope", F.col("name").alias("entity"), "platforms").join(
        eng.select(*KEY, "post_count"), list(KEY), "left")
    counts = j.groupBy("scope").agg(
        F.count(F.lit(1)).alias("entities"),
        F.coalesce(F.sum("post_count"), F.lit(0)).cast("long").alias("total_posts"))
    plats = (j.select("scope", F.explode("platforms").alias("p")).groupBy("scope")
             .agg(F.array_sort(F.collect_set("p")).alias("platforms")))
    return counts.join(plats, "scope", "left").select(
        "scope", "entities", "total_posts",
        F.coalesce("platforms", F.array().cast("array<string>")).alias("platforms"))


# AGG-12 ---------------------------------------------------------------------
def distinct_authors(posts: DataFrame, by=("scope",), approx: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approx else F.countDistinct
    return posts.groupBy(*by).agg(f("author").alias("distinct_authors"))


# AGG-13 ---------------------------------------------------------------------
def entity_listing(entities: DataFrame, summary: DataFrame, threshold: float = 0.05) -> DataFrame:
    s = F.col("overall_score")
    label = F.when(s > threshold, "Positive").when(s < -threshold, "Negative").otherwise("Neutral")
    return (entities.select("scope", F.col("name").alias("entity"), "mention_count")
            .join(summary.select(*KEY, "overall_score"), list(KEY), "left")
            .withColumn("listing_label", label))


# AGG-15 ---------------------------------------------------------------------
def breakdown_listing(summary: DataFrame, themes: DataFrame, n: int = 5) -> DataFrame:
    first = (themes.filter(F.col("rank") <= n)
             .groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "theme"))).alias("_t"))
             .select(*KEY, F.array_join(F.transform("_t", lambda x: x["theme"]), ", ").alias("themes")))
    return (summary.select(*KEY, "overall_score", "positive_pct", "negative_pct", "neutral_pct")
            .join(first, list(KEY), "left")
            .withColumn("themes", F.coalesce("themes", F.lit(""))))
