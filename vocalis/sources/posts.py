"""Read operators over the posts / entities / sentiment tables (SRC-1..7, SRC-9).

The original issues ``SELECT *`` with ``ORDER BY date DESC``; here the order
is ``ts DESC NULLS LAST, post_id`` on the parsed timestamp (a string sort
over mixed date formats is not reproduced).  A global ``orderBy`` is a range
shuffle, so these readers only sort when ``ordered=True`` (a sink or a
display needs it); the analysis operators never do.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def newest_first() -> tuple[Column, Column]:
    return (F.col("ts").desc_nulls_last(), F.col("post_id").asc())


def _order(df: DataFrame, ordered: bool, *keys: Column) -> DataFrame:
    return df.orderBy(*keys) if ordered else df


# SRC-1
def posts_by_scope(posts: DataFrame, scope: str, ordered: bool = True) -> DataFrame:
    return _order(posts.filter(F.col("scope") == scope), ordered, *newest_first())


# SRC-2
def posts_by_platform(posts: DataFrame, platform: str, ordered: bool = True) -> DataFrame:
    return _order(posts.filter(F.col("platform") == platform), ordered, *newest_first())


# SRC-3
def all_posts(posts: DataFrame, ordered: bool = True) -> DataFrame:
    return _order(posts, ordered, *newest_first())


# SRC-4
def posts_mentioning(posts: DataFrame, name: str, scope: str | None = None,
                     ordered: bool = True) -> DataFrame:
    """Posts whose text contains ``name`` case-insensitively (literal match;
    '%' and '_' in the name are ordinary characters)."""
    cond = F.instr(F.lower(F.col("text")), F.lit(name.lower())) > 0
    if scope is not None:
        cond = (F.col("scope") == scope) & cond
    return _order(posts.filter(cond), ordered, *newest_first())


# SRC-5
def entities_by_scope(entities: DataFrame, scope: str, ordered: bool = True) -> DataFrame:
    return _order(entities.filter(F.col("scope") == scope), ordered,
                  F.col("mention_count").desc(), F.col("name").asc())


# SRC-6
def sentiment_for_entity(sentiment: DataFrame, posts: DataFrame, name: str,
                         scope: str | None = None, ordered: bool = True) -> DataFrame:
    """Sentiment rows of an entity joined with their post's columns."""
    s = sentiment.filter(F.col("entity") == name)
    p = posts.select("post_id", "text", "platform", F.col("scope").alias("post_scope"),
                     "ts", "url")
    out = s.join(p, "post_id")
    if scope is not None:
        out = out.filter(F.col("post_scope") == scope)
    return _order(out, ordered, F.col("score").desc(), F.col("post_id").asc())


# SRC-7
def post_count(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("post_count"))


# SRC-9
def restrict(posts: DataFrame, scopes: Iterable[str] | None = None,
             platforms: Iterable[str] | None = None) -> DataFrame:
    """Scope override and enabled-platform switch, applied to every stage."""
    out = posts
    if scopes is not None:
        out = out.filter(F.col("scope").isin(list(scopes)))
    if platforms is not None:
        out = out.filter(F.col("platform").isin(list(platforms)))
    return out
