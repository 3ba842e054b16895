"""Name mentions: extraction, stop names, title stripping, aggregation
(ENT-1 .. ENT-4).

Everything is a column expression over the post row plus one ``groupBy``
with partial (map-side) aggregation; the text itself is never carried
through the explode -- only ``(scope, platform, post_id, ts, pos)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, words_lit
from ..params import Params

# Fixed value: 2-3 capitalised words, each with an optional '-' or "'" part.
# (?U) gives \b and \s their Unicode meaning; [A-Z]/[a-z] stay ASCII.
NAME_RE = (r"(?U)\b([A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)?"
           r"(?:\s+[A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)?){1,2})\b")
WS_RE = r"(?U)\s+"

# Oldest possible timestamp: unknown dates sort last in "newest first" order.
_MIN_TS = "0001-01-01 00:00:00"


def split_words(c) -> Column:
    """Python ``str.split()``: whitespace runs, no empty ends."""
    t = F.trim(F.regexp_replace(col_(c), WS_RE, " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def drop_possessive(c) -> Column:
    t = F.trim(col_(c))
    return F.when(t.endswith("'s"), F.trim(F.substring(t, F.lit(1), F.length(t) - 2))).otherwise(t)


# ENT-2 ----------------------------------------------------------------------
def is_stop_name(c, p: Params) -> Column:
    """Phrase equality, any stop word, or a scope name (all case-folded)."""
    nl = F.lower(col_(c))
    words = split_words(nl)
    return (F.array_contains(words_lit(p.stop_phrases), nl)
            | F.arrays_overlap(words, words_lit(p.stop_words))
            | F.array_contains(words_lit(p.scope_names), nl))


# ENT-3 ----------------------------------------------------------------------
def strip_titles_words(c, p: Params) -> Column:
    """Leading title words removed; returns the remaining word array."""
    words = split_words(col_(c))
    titles = words_lit(p.title_prefixes)
    flags = F.transform(words, lambda w: F.array_contains(titles, F.lower(w)))
    first = F.array_position(flags, False)
    return F.when(first == 0, F.array().cast("array<string>")).otherwise(
        F.slice(words, first.cast("int"), F.size(words)))


def strip_titles(c, p: Params) -> Column:
    return F.array_join(strip_titles_words(c, p), " ")


# ENT-1 ----------------------------------------------------------------------
def extract_mentions(posts: DataFrame, p: Params) -> DataFrame:
    """One row per accepted regex match:
    ``(scope, platform, post_id, ts, pos, raw, name)``.

    Leftmost non-overlapping matches (``regexp_extract_all``), trailing "'s"
    removed, stop names rejected before and after title stripping, at least
    two words left.
    """
    m = posts.select(
        "scope", "platform", "post_id", "ts",
        F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(NAME_RE), 1)).alias("pos", "match"),
    )
    raw = drop_possessive(F.col("match"))
    stripped = strip_titles_words(F.col("raw"), p)
    return (m.withColumn("raw", raw)
             .filter(~is_stop_name(F.col("raw"), p))
             .withColumn("words", stripped)
             .filter(F.size("words") >= 2)
             .withColumn("name", F.array_join("words", " "))
             .filter(~is_stop_name(F.col("name"), p))
             .drop("match", "words"))


def first_seen_key(ts="ts", post_id="post_id", pos="pos") -> Column:
    """Order key of an occurrence in a newest-first scan; larger = earlier.

    (ts desc nulls last, post_id asc, pos asc) expressed as a value whose
    ``max`` is the first occurrence, so it aggregates map-side.
    """
    return F.struct(
        F.coalesce(col_(ts), F.lit(_MIN_TS).cast("timestamp_ntz")).alias("t"),
        (-col_(post_id)).alias("p"),
        (-col_(pos)).alias("q"),
    )


# ENT-4 ----------------------------------------------------------------------
def aggregate_mentions(mentions: DataFrame) -> DataFrame:
    """Per (scope, name): occurrences, sorted platform set, first-seen key."""
    return (mentions.groupBy("scope", "name")
            .agg(F.count(F.lit(1)).alias("cnt"),
                 F.array_sort(F.collect_set("platform")).alias("platforms"),
                 F.max(first_seen_key()).alias("first_seen")))


def mention_contexts(mentions: DataFrame, posts: DataFrame, radius: int = 50,
                     per_name: int = 3) -> DataFrame:
    """Optional: up to ``per_name`` snippets per name, taken in first-seen
    order (newest post first, then match order); each is the text +-radius
    characters around the first occurrence of the raw match in its post.
    ``row_number() <= k`` is planned as a window group limit, and the text
    is joined to the <= k winners only."""
    from pyspark.sql import Window
    w = Window.partitionBy("scope", "name").orderBy(first_seen_key().desc())
    first = (mentions.select("scope", "name", "post_id", "ts", "pos", "raw")
             .withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_name))
    t = posts.select("post_id", "text")
    idx = F.instr(F.col("text"), F.col("raw")) - 1
    start = F.greatest(idx - radius, F.lit(0))
    end = F.least(F.length("text"), idx + F.length("raw") + radius)
    snippet = F.trim(F.substring(F.col("text"), start + 1, end - start))
    return (first.join(t, "post_id")
            .filter(idx >= 0)
            .select("scope", "name", F.col("k").cast("long").alias("k"), snippet.alias("context")))
