"""Readers over posts / entities / sentiment (SRC-1..7, SRC-9)."""

import datetime as dt

from helpers import make_posts
from vocalis.sources import posts as S


def test_post_count(spark):
    assert S.post_count(make_posts(spark, ["a", "b", "c"])).first()["post_count"] == 3


def test_posts_by_scope_newest_first(spark):
    posts = make_posts(spark, [("one", "t", "Lagos"), ("two", "t", "Kano"), ("three", "t", "Lagos")])
    got = [r["text"] for r in S.posts_by_scope(posts, "Lagos").collect()]
    assert got == ["three", "one"]


def test_unknown_dates_sort_last(spark):
    posts = make_posts(spark, ["a", "b"]).withColumn("ts", S.F.when(S.F.col("post_id") == 2, None)
                                                     .otherwise(S.F.col("ts")))
    assert [r["post_id"] for r in S.all_posts(posts).collect()] == [1, 2]


def test_posts_mentioning_case_insensitive_and_literal(spark):
    posts = make_posts(spark, [("PETER OBI for governor", "t", "Lagos"), ("peter obi", "t", "Kano"),
                               ("100% sure", "t", "Lagos"), ("1000 sure", "t", "Lagos")])
    assert S.posts_mentioning(posts, "Peter Obi").count() == 2
    assert S.posts_mentioning(posts, "Peter Obi", "Lagos").count() == 1
    assert [r["text"] for r in S.posts_mentioning(posts, "0% s").collect()] == ["100% sure"]


def test_entities_by_scope_order(spark):
    e = spark.createDataFrame([("L", "A B", 2), ("L", "C D", 5), ("K", "E F", 9)],
                              "scope string, name string, mention_count long")
    assert [r["name"] for r in S.entities_by_scope(e, "L").collect()] == ["C D", "A B"]


def test_sentiment_for_entity(spark):
    posts = make_posts(spark, [("x", "t", "Lagos"), ("y", "t", "Kano")])
    s = spark.createDataFrame([(1, "A B", "positive", 0.2), (2, "A B", "negative", -0.5),
                               (1, "C D", "neutral", 0.0)],
                              "post_id long, entity string, label string, score double")
    got = S.sentiment_for_entity(s, posts, "A B").collect()
    assert [r["post_id"] for r in got] == [1, 2]                 # score desc
    assert [r["post_id"] for r in S.sentiment_for_entity(s, posts, "A B", "Kano").collect()] == [2]


def test_restrict(spark):
    posts = make_posts(spark, [("a", "t", "Lagos"), ("b", "r", "Lagos"), ("c", "t", "Kano")])
    assert S.restrict(posts, ["Lagos"], ["t"]).count() == 1
    assert S.restrict(posts).count() == 3
    assert dt is not None
