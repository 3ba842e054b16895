"""Report tables (RPT-1, RPT-2, PIPE-2) as DataFrames.

The original renders Markdown; here the report stops at the tables it is
made of, with the same display formats (FN-8, FN-9) as extra string columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalize, round_half_even, score_indicator, signed3, thousands
from .profile import rank_profiles


# RPT-1 ----------------------------------------------------------------------
def ranking_table(entities: DataFrame, summary: DataFrame) -> DataFrame:
    """Rank, entity, score (+indicator), positive %, negative %, mentions."""
    r = rank_profiles(summary).join(
        entities.select("scope", F.col("name").alias("entity"), "mention_count"), ["scope", "entity"])
    s = F.col("overall_score")
    return r.select(
        "scope", F.col("profile_rank").alias("rank"), "entity", s.alias("score"),
        score_indicator(s).alias("indicator"), "positive_pct", "negative_pct", "mention_count",
        F.concat(signed3(round_half_even(s, 3)), F.lit(" ("), score_indicator(s), F.lit(")")).alias("score_text"),
        F.format_string("%.1f%%", "positive_pct").alias("positive_text"),
        F.format_string("%.1f%%", "negative_pct").alias("negative_text"))


# RPT-2 ----------------------------------------------------------------------
def platform_table(platforms: DataFrame) -> DataFrame:
    s = F.col("score")
    return platforms.select(
        "scope", "entity", capitalize("platform").alias("platform"),
        signed3(round_half_even(s, 3)).alias("score"), F.col("count").alias("posts"),
        F.format_string("%.1f%%", "positive_pct").alias("positive"),
        F.format_string("%.1f%%", "negative_pct").alias("negative"))


def detail_table(entities: DataFrame, themes: DataFrame, excerpts: DataFrame,
                 support: DataFrame, engagement: DataFrame, shown_themes: int = 10,
                 shown_excerpts: int = 3, shown_support: int = 5) -> DataFrame:
    """Per entity: displayed themes, excerpt counts, support list, engagement."""
    k = ["scope", "entity"]
    th = (themes.filter(F.col("rank") <= shown_themes).groupBy(*k)
          .agg(F.array_sort(F.collect_list(F.struct("rank", F.format_string("`%s` (%d)", "theme", "count")
                                                    .alias("t")))).alias("_t"))
          .select(*k, F.array_join(F.transform("_t", lambda x: x["t"]), ", ").alias("themes")))
    ex = (excerpts.filter(F.col("rank") <= shown_excerpts).groupBy(*k)
          .agg(F.count_if(F.col("label") == "positive").alias("shown_positive"),
               F.count_if(F.col("label") == "negative").alias("shown_negative")))
    sp = (support.withColumn("_o", F.struct((-F.col("mentions")).alias("m"), F.col("ordinal").alias("o")))
          .groupBy(*k).agg(F.slice(F.array_sort(F.collect_list(F.struct(
              "_o", F.format_string("%s (%s, %d mentions)", capitalize("category"), F.col("strength"),
                                    F.col("mentions")).alias("s")))), 1, shown_support).alias("_s"))
          .select(*k, F.array_join(F.transform("_s", lambda x: x["s"]), ", ").alias("support")))
    eg = engagement.select(*k, thousands("total_likes").alias("likes"),
                           thousands("total_shares").alias("shares"),
                           F.format_string("%.1f", "avg_likes").alias("avg_likes"))
    base = entities.select("scope", F.col("name").alias("entity"))
    return (base.join(th, k, "left").join(ex, k, "left").join(sp, k, "left").join(eg, k, "left")
            .select(*k, F.coalesce("themes", F.lit("")).alias("themes"),
                    F.coalesce("shown_positive", F.lit(0)).cast("long").alias("shown_positive"),
                    F.coalesce("shown_negative", F.lit(0)).cast("long").alias("shown_negative"),
                    F.coalesce("support", F.lit("")).alias("support"), "likes", "shares", "avg_likes"))


def excerpt_table(excerpts: DataFrame, shown_excerpts: int = 3) -> DataFrame:
    """The excerpts shown per entity and label: text, platform, score, date."""
    return (excerpts.filter(F.col("rank") <= shown_excerpts)
            .select("scope", "entity", "label", F.col("rank").cast("long").alias("rank"), "text",
                    capitalize("platform").alias("platform"),
                    signed3(round_half_even(F.col("score"), 3)).alias("score"), "date"))


def audience_table(audience: DataFrame) -> DataFrame:
    """Posts and share per platform of an entity's audience."""
    return audience.select("scope", "entity", capitalize("platform").alias("platform"), "posts",
                           F.format_string("%.1f%%", "share_pct").alias("share"))


def region_table(regions: DataFrame) -> DataFrame:
    return regions.select("scope", "entity", F.col("rank").cast("long").alias("rank"),
                          capitalize("region").alias("region"), "mentions")
