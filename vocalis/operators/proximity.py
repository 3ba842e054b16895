"""Occurrence windows and proximity counters per (post, name) pair
(ENT-8 .. ENT-10), and the gates and score per name (ENT-11, ENT-12).

Per pair, a single left fold over the occurrence ordinals walks the
**overlapping** occurrences (``position(nl, tl, last + 1)``) and counts, in
the same step, role / rival hits in the +-role_window window and role +
scope-variant hits in the +-scope_window window.  The accumulator is a small
struct (last position, three counters, occurrence count), so the fold is
linear in the number of occurrences, and it is returned whole so that it is
evaluated once.  All of it is JVM-side higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, words_lit
from ..params import Params


def scope_variants_col(scope, p: Params) -> Column:
    """Lower-case scope spellings: the scope itself plus configured extras."""
    s = F.lower(col_(scope))
    entries = {}
    for sc in set(list(p.scopes) + list(p.scope_variants)):
        entries[sc.lower()] = p.variants_for(sc)
    if not entries:
        return F.array(s)
    kv = []
    for k, vs in sorted(entries.items()):
        kv += [F.lit(k), words_lit(vs)]
    return F.coalesce(F.try_element_at(F.create_map(*kv), s), F.array(s))


def _any_in(window: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.instr(window, w) > 0)


def holds_keyword(tl: Column, p: Params) -> Column:
    """Whether a lower-cased text has a role or rival keyword at all."""
    return (_any_in(tl, words_lit(dict.fromkeys(p.role_keywords)))
            | _any_in(tl, words_lit(dict.fromkeys(p.rival_keywords))))


#: characters of a chunk in which occurrences of a long text are walked
CHUNK_CHARS = 4096


def occurrence_count(tl: Column | str = "tl", nl: Column | str = "nl") -> Column:
    """Overlapping occurrences of nl in tl (a zero-width lookahead count)."""
    quoted = F.replace(col_(nl), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.regexp_count(col_(tl), F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")))


def pair_counters(tl: Column, nl: Column, variants: Column, p: Params) -> Column:
    """``struct(p, g, r, s, n)`` of one name in one lower-cased text: one fold
    over the overlapping occurrences; ``n`` = occurrences, ``g`` / ``r`` /
    ``s`` = role, rival and role+scope window hits.  Returned as one struct
    so that the fold is evaluated once (consumers read its fields in a later
    projection)."""
    L = F.length(nl)
    role = words_lit(dict.fromkeys(p.role_keywords))
    rival = words_lit(dict.fromkeys(p.rival_keywords))

    def walk(t: Column, lo: Column, hi: Column) -> Column:
        """Counters of the occurrences in ``t`` that start in (lo, hi]."""
        def window(pos: Column, radius: int) -> Column:
            start = F.greatest(F.lit(1), pos - radius)
            return F.substring(t, start, pos + L + radius - start)

        def step(acc, _i):
            nxt = F.array(F.position(nl, t, acc["p"] + 1))

            def bind(q):
                rw, sw = window(q, p.role_window), window(q, p.scope_window)
                own = ((q > lo) & (q <= hi)).cast("int")
                return F.struct(
                    q.alias("p"),
                    (acc["g"] + own * _any_in(rw, role).cast("int")).alias("g"),
                    (acc["r"] + own * _any_in(rw, rival).cast("int")).alias("r"),
                    (acc["s"] + own * (_any_in(sw, role) & _any_in(sw, variants)).cast("int")).alias("s"),
                    (acc["n"] + own).alias("n"),
                )
            return F.transform(nxt, bind)[0]

        return F.aggregate(F.sequence(F.lit(1), occurrence_count(t, nl)), init, step)

    zero = F.lit(0)
    init = F.struct(zero.alias("p"), zero.alias("g"), zero.alias("r"), zero.alias("s"), zero.alias("n"))
    # A search or a cut at a position walks the text up to it, so a long text is
    # cut into chunks first, each with room for the windows around it; an
    # occurrence counts in the chunk it starts in.
    margin = max(p.role_window, p.scope_window)
    n = F.length(tl)

    def of_chunk(k):
        first = F.greatest(zero, k * CHUNK_CHARS - margin)
        lo = k * CHUNK_CHARS - first
        cut = F.substring(tl, first + 1, lo + CHUNK_CHARS + L + margin)
        # an array of one names the cut, so that it is made once
        return F.transform(F.array(cut), lambda t: F.when(F.instr(t, nl) > 0, walk(t, lo, lo + CHUNK_CHARS))
                           .otherwise(init))[0]

    parts = F.transform(F.sequence(zero, F.floor((n - 1) / CHUNK_CHARS).cast("int")), of_chunk)
    chunked = F.aggregate(parts, init, lambda a, x: F.struct(
        a["p"].alias("p"), (a["g"] + x["g"]).alias("g"), (a["r"] + x["r"]).alias("r"),
        (a["s"] + x["s"]).alias("s"), (a["n"] + x["n"]).alias("n")))
    # Exact shortcut: a window can only hold a keyword the whole text holds,
    # so the occurrence walk runs only for texts with a role/rival keyword;
    # otherwise only the occurrences are counted (one regex pass).
    any_kw = _any_in(tl, role) | _any_in(tl, rival)
    count_only = F.struct(zero.alias("p"), zero.alias("g"), zero.alias("r"), zero.alias("s"),
                          occurrence_count(tl, nl).alias("n"))
    return (F.when(~any_kw, count_only).when(n > 2 * CHUNK_CHARS, chunked)
            .otherwise(walk(tl, zero, n)))


def context_score(tl: Column, variants: Column, p: Params) -> Column:
    """Distinct context words in the text when any scope spelling occurs in it
    (per post: the same for every name the post contains)."""
    ctx = words_lit(dict.fromkeys(p.context_words))
    return F.when(_any_in(tl, variants),
                  F.size(F.filter(ctx, lambda w: F.instr(tl, w) > 0))).otherwise(0)


def pair_stats_join(posts: DataFrame, names: DataFrame, name_rows: int | None,
                    p: Params) -> DataFrame:
    """JOIN-2 + ENT-8..10: ``(post_id, scope, platform, name, occ, role_hits,
    rival_hits, role_scope_hits, context_score)`` for every (post, name) with
    the name in the post."""
    from . import containment as C

    if (names.count() if name_rows is None else name_rows) > C.BROADCAST_ANCHOR_ROWS:
        return window_stats_join(posts, names, p)

    def post_fn(tl, scope):
        return {"context_score": context_score(tl, scope_variants_col(scope, p), p)}

    role = words_lit(dict.fromkeys(p.role_keywords))
    rival = words_lit(dict.fromkeys(p.rival_keywords))
    near = {"role_hits": (p.role_window, [role]), "rival_hits": (p.role_window, [rival]),
            "role_scope_hits": (p.scope_window, [role, scope_variants_col(F.col("scope"), p)])}
    j = C.name_hits(posts, names, ("platform",), near, post_fn)
    return j.select("post_id", "scope", "platform", "name", F.col("n").alias("occ"), *near, "context_score")


def window_stats_join(posts: DataFrame, names: DataFrame, p: Params) -> DataFrame:
    """``pair_stats_join`` for names beyond a broadcast: the counters of an
    occurrence come from the characters shipped with it (a text without a role
    or rival keyword ships the name alone), the context score is computed where
    the text is read."""
    from .containment import around, occurrences

    def post_fn(tl, scope):
        return {"context_score": context_score(tl, scope_variants_col(scope, p), p)}

    role = words_lit(dict.fromkeys(p.role_keywords))
    rival = words_lit(dict.fromkeys(p.rival_keywords))
    found = occurrences(posts, names, max(p.role_window, p.scope_window), ("platform",), post_fn,
                        lambda tl: holds_keyword(tl, p)).select(
        "post_id", "scope", "platform", "name", "context_score", around(p.role_window).alias("_rw"),
        around(p.scope_window).alias("_sw"))
    hit = lambda c: F.sum(c.cast("int")).cast("int")
    return found.groupBy("post_id", "scope", "platform", "name").agg(
        F.count(F.lit(1)).cast("int").alias("occ"), hit(_any_in(F.col("_rw"), role)).alias("role_hits"),
        hit(_any_in(F.col("_rw"), rival)).alias("rival_hits"),
        hit(_any_in(F.col("_sw"), role) & _any_in(F.col("_sw"), scope_variants_col("scope", p))).alias("role_scope_hits"),
        F.max("context_score").alias("context_score"))


def pair_stats(pairs: DataFrame, p: Params) -> DataFrame:
    """The same counters for pairs that already carry ``tl``, ``nl``, scope."""
    v = scope_variants_col("scope", p)
    x = pair_counters(F.col("tl"), F.col("nl"), v, p)
    return (pairs.withColumn("_x", x)
            .select(*pairs.columns, F.col("_x.n").alias("occ"), F.col("_x.g").alias("role_hits"),
                    F.col("_x.r").alias("rival_hits"), F.col("_x.s").alias("role_scope_hits"),
                    context_score(F.col("tl"), v, p).alias("context_score")))


#: platforms that have a bit each in ``name_stats``
MOST_PLATFORMS = 60


def platform_list(posts: DataFrame) -> list[str] | None:
    """The platforms of the posts, None beyond ``MOST_PLATFORMS``."""
    found = [r[0] for r in posts.select("platform").filter("platform IS NOT NULL").distinct()
             .limit(MOST_PLATFORMS + 1).collect()]
    return sorted(found) if len(found) <= MOST_PLATFORMS else None


def name_stats(stats: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Per (scope, name): posts containing it, their platforms, counter sums.

    With all ``platforms`` known a name's set is the bits of one number, so that
    pairs are combined in a hash table before the shuffle; a ``collect_set``
    sorts them as soon as a task has more than a few names."""
    if platforms is None:
        kinds = F.array_sort(F.collect_set("platform"))
    else:
        bit = F.lit(0).cast("long")
        for i, kind in enumerate(platforms):
            bit = F.when(F.col("platform") == kind, F.lit(1 << i).cast("long")).otherwise(bit)
        kinds = F.bit_or(bit)
    found = (stats.groupBy("scope", "name")
             .agg(F.count(F.lit(1)).alias("ci_posts"),
                  kinds.alias("ci_platforms"),
                  F.sum("role_hits").alias("role_hits"),
                  F.sum("rival_hits").alias("rival_hits"),
                  F.sum("role_scope_hits").alias("role_scope_hits"),
                  F.sum("context_score").alias("context_score")))
    if platforms is None:
        return found
    named = [F.when(F.col("ci_platforms").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(kind))
             for i, kind in enumerate(platforms)]
    return found.withColumn("ci_platforms", F.array_compact(F.array(*named).cast("array<string>")))


# ENT-11 ---------------------------------------------------------------------
def passes_gates(role="role_hits", rival="rival_hits", role_scope="role_scope_hits",
                 context="context_score") -> Column:
    return ((col_(role_scope) > 0)
            & (col_(role) > 0) & (col_(context) > 0)
            & (col_(rival) < col_(role)))


# ENT-12 ---------------------------------------------------------------------
def entity_score(cnt="mention_count", platforms="platforms", role="role_hits",
                 role_scope="role_scope_hits", context="context_score") -> Column:
    c = col_(cnt).cast("double")
    denom = F.greatest(col_(cnt), F.lit(1)).cast("double")
    bonus = F.when(F.size(col_(platforms)) >= 2, F.lit(1.5)).otherwise(F.lit(1.0))
    return (c * bonus
            * (F.lit(1.0) + col_(role) / denom * 0.3 + col_(role_scope) / denom * 0.3)
            * (F.lit(1.0) + col_(context) / 10.0))
