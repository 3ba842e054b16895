"""Demo data set (SRC-11): a handful of hand-written posts per scope, completed
with a hashed author, a date within the last 360 days of the reference date,
a url and a fixed keyword -- deterministic (``xxhash64`` of the post id) so
every run seeds the same table.  For demos and tests only; the registered
queries read the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import anonymize_author

# Hand-written sample posts: (platform, scope, text, likes, shares).
DEMO_POSTS = (
    ("nairaland", "Lagos", "Ada Okafor is the governorship candidate Lagos needs, her campaign on roads is great", 41, 3),
    ("twitter", "Lagos", "Lagos governor race: Ada Okafor promises good schools for the youth", 88, 12),
    ("reddit", "Lagos", "Not impressed with Ada Okafor, the Lagos governorship debate was bad", 5, 1),
    ("nairaland", "Lagos", "Tunde Bakare-Lawal says he will contest the Lagos governorship ticket", 17, 0),
    ("twitter", "Lagos", "Tunde Bakare-Lawal for Lagos governor, a good candidate for business", 23, 4),
    ("facebook", "Lagos", "Traffic in the city is terrible this week, nothing to do with politics", 2, 0),
    ("nairaland", "Kano", "Musa Garba is running for Kano governor, strong support in the north", 64, 9),
    ("twitter", "Kano", "Kano governorship: Musa Garba campaign visits the market, traders are happy", 31, 5),
    ("reddit", "Kano", "Musa Garba and Kano politics, the candidate looks good for the youth", 12, 2),
    ("facebook", "Kano", "President visits Abuja again, not about the Kano governor election", 7, 1),
)


def demo_posts(spark: SparkSession, as_of: str = "2025-02-12") -> DataFrame:
    rows = [(i + 1,) + r for i, r in enumerate(DEMO_POSTS)]
    df = spark.createDataFrame(rows, "post_id long, platform string, scope string, text string, "
                                     "likes long, shares long")
    h = F.abs(F.xxhash64("post_id"))
    ts = (F.lit(as_of).cast("timestamp_ntz")
          - F.make_dt_interval((h % 360).cast("int"), (h % 24).cast("int"), F.lit(0), F.lit(0)))
    return df.select(
        "post_id", "platform", "scope", "text",
        anonymize_author(F.concat(F.lit("demo_user_"), (h % 1000).cast("string"))).alias("author"),
        ts.alias("ts"),
        F.concat(F.lit("https://"), F.col("platform"), F.lit(".example/p/"), F.hex(h)).alias("url"),
        "likes", "shares",
        F.concat(F.col("scope"), F.lit(" governorship election")).alias("keyword"))
