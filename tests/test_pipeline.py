"""End to end on election-style posts: discovery -> sentiment -> profiles ->
tables and exports through the batch job entry point."""

import os
import re

from pyspark.sql import functions as F

from helpers import EP, make_posts
from vocalis.plans import job
from vocalis.plans.pipeline import run_analysis
from vocalis.sinks.io import write_posts

LEX = {"great": 1.5, "good": 1.0, "bad": -1.0, "failure": -2.0}

POSTS = [
    ("Babajide Sanwo-Olu is a great governor of Lagos, good roads", "twitter", "Lagos"),
    ("Lagos governorship: Babajide Sanwo-Olu campaign in the city", "nairaland", "Lagos"),
    ("Governor Babajide Sanwo-Olu of Lagos is a failure, bad traffic", "twitter", "Lagos"),
    ("Peter Obi for president, not governor of Lagos", "twitter", "Lagos"),
    ("Kano governor race: Abba Yusuf candidate of NNPP in Kano", "nairaland", "Kano"),
    ("Abba Yusuf Kano governorship election campaign youth", "twitter", "Kano"),
    ("Weather is nice today in Lagos", "reddit", "Lagos"),
]


def test_run_analysis_election(spark):
    p = EP.with_(lexicon=LEX)
    a = run_analysis(make_posts(spark, POSTS), p)
    ents = {(r["scope"], r["name"]): r for r in a.entities.collect()}
    assert ("Lagos", "Babajide Sanwo-Olu") in ents and ("Kano", "Abba Yusuf") in ents
    assert ("Lagos", "Peter Obi") not in ents                       # mentioned once, rival context
    fan = a.sentiment.groupBy("entity").count().collect()
    assert {r["entity"] for r in fan} >= {"Babajide Sanwo-Olu", "Abba Yusuf", "General"}
    prof = {r["entity"]: r for r in a.part("profiles").collect()}
    sanwo = prof["Babajide Sanwo-Olu"]
    assert sanwo["sentiment"]["total_analyzed"] == 3 and sanwo["post_count"] == 3
    pcts = sanwo["sentiment"]["positive_pct"] + sanwo["sentiment"]["negative_pct"] \
        + sanwo["sentiment"]["neutral_pct"]
    assert abs(pcts - 100.0) < 0.2                                     # each rounded to 1 dp
    assert set(sanwo["platform_breakdown"].keys()) == {"twitter", "nairaland"}
    assert any(s["category"] == "youth" for s in prof["Abba Yusuf"]["demographic_insights"]["support_indicators"])


def test_job_entry_point(spark, tmp_out):
    posts_path = os.path.join(tmp_out, "posts")
    write_posts(make_posts(spark, POSTS), posts_path)
    args = job.parse_args(["--posts", posts_path, "--out", os.path.join(tmp_out, "out"),
                           "--scopes", "Lagos", "--no-posts-json"])
    done = job.run(spark, args, base=EP.with_(lexicon=LEX))
    assert "posts_json" not in done and {"posts_csv", "sentiment_json", "profiles_json"} <= set(done)
    ents = spark.read.parquet(done["entities"]).select("scope", "name").collect()
    assert [(r["scope"], r["name"]) for r in ents] == [("Lagos", "Babajide Sanwo-Olu")]
    sent = spark.read.parquet(done["sentiment"])
    assert sent.filter(F.col("scope") == "Kano").count() == 0         # scope override applied
    first = sent.count()
    # rerun replaces, never duplicates
    job.run(spark, args, base=EP.with_(lexicon=LEX))
    assert spark.read.parquet(done["sentiment"]).count() == first


def test_demo_data_end_to_end(spark):
    from vocalis.sources.demo import DEMO_POSTS, demo_posts
    posts = demo_posts(spark)
    assert posts.count() == len(DEMO_POSTS) and posts.select("url").distinct().count() == len(DEMO_POSTS)
    again = demo_posts(spark).select("author", "ts").collect()
    assert again == posts.select("author", "ts").collect()           # deterministic
    a = run_analysis(posts, EP.with_(lexicon=LEX))
    got = {(r["scope"], r["name"]) for r in a.entities.collect()}
    assert got == {("Lagos", "Ada Okafor"), ("Lagos", "Tunde Bakare-Lawal"), ("Kano", "Musa Garba")}


def test_counted_parts_keep_no_text(spark, tmp_out):
    """Engagement and audience read, shuffle and keep no text; ids that occur
    twice, a null id and null numbers count as in the posts with texts."""
    from test_plans import plan
    from vocalis.operators import profile as prof
    path = os.path.join(tmp_out, "posts")
    write_posts(make_posts(spark, POSTS), path)
    a = run_analysis(spark.read.parquet(path), EP.with_(lexicon=LEX))
    for part in ("engagement", "audience"):
        assert not re.search(r"\btext\b", plan(a.part(part)))
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(a.part("engagement")) == rows(prof.engagement(a.entities, a.entity_posts))
    assert rows(a.part("audience")) == rows(prof.platform_audience(a.entity_posts))

    posts = make_posts(spark, ["one", "two", "three"]).withColumn("likes", F.when(F.col("post_id") > 1, F.col("likes")))
    posts = posts.unionByName(posts.filter("post_id = 2"))
    pairs = spark.createDataFrame([(1, "S", "A B"), (2, "S", "A B"), (2, "S", "A B"), (3, "S", None), (None, "S", "A B")],
                                  "post_id long, scope string, entity string")
    few = prof.counted_posts(pairs, posts)
    assert rows(few) == rows(prof.entity_posts(pairs, posts).select(*few.columns))
