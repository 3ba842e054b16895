"""Profile parts: summary, platform breakdown, excerpts, themes, demographics,
engagement -- including the empty cases."""

from pyspark.sql import functions as F

from helpers import EP, make_posts
from vocalis.operators import profile as prof

SENT_DDL = "post_id long, scope string, entity string, platform string, label string, score double"
ENT_DDL = "scope string, name string, mention_count long, platforms array<string>, score double"


def entities(spark, names=("John Doe",)):
    return spark.createDataFrame([("Lagos", n, 3, ["twitter"], 1.0) for n in names], ENT_DDL)


def sentiment(spark, rows, entity="John Doe"):
    return spark.createDataFrame(
        [(i + 1, "Lagos", entity, plat, lab, sc) for i, (plat, lab, sc) in enumerate(rows)], SENT_DDL)


def entity_posts(spark, texts, entity="John Doe"):
    ps = make_posts(spark, texts)
    return ps.select("post_id", "scope", F.lit(entity).alias("entity"), "platform", "text", "ts",
                     "likes", "shares")


def test_summary_empty(spark):
    out = prof.sentiment_summary(entities(spark), sentiment(spark, [])).first()
    assert out["overall_score"] == 0.0 and out["total_analyzed"] == 0


def test_summary_all_positive(spark):
    out = prof.sentiment_summary(entities(spark), sentiment(
        spark, [("t", "positive", 0.8), ("t", "positive", 0.6)])).first()
    assert out["overall_score"] > 0 and out["positive_pct"] == 100.0


def test_summary_mixed(spark):
    out = prof.sentiment_summary(entities(spark), sentiment(
        spark, [("t", "positive", 0.8), ("t", "negative", -0.6), ("t", "neutral", 0.0)])).first()
    assert out["total_analyzed"] == 3 and out["positive_pct"] == 33.3
    assert out["overall_score"] == 0.0667


def test_platform_breakdown(spark):
    assert prof.platform_breakdown(sentiment(spark, [])).count() == 0
    rows = {r["platform"]: r for r in prof.platform_breakdown(sentiment(
        spark, [("twitter", "positive", 0.5), ("nairaland", "negative", -0.3)])).collect()}
    assert set(rows) == {"twitter", "nairaland"} and rows["twitter"]["score"] > rows["nairaland"]["score"]


def test_excerpts(spark):
    s = sentiment(spark, [("t", "positive", 0.9), ("n", "positive", 0.7), ("r", "negative", -0.5)])
    posts = make_posts(spark, ["Great!", "Good work", "Bad"])
    ex = prof.top_excerpts(s, posts, EP.with_(excerpts_top=2))
    assert ex.filter(F.col("label") == "positive").count() == 2
    neg = prof.top_excerpts(sentiment(spark, [("t", "positive", 0.9), ("t", "negative", -0.8)]),
                            make_posts(spark, ["Great!", "Terrible"]), EP).filter(F.col("label") == "negative")
    assert [r["text"] for r in neg.collect()] == ["Terrible"]
    long = prof.top_excerpts(sentiment(spark, [("t", "positive", 0.5)]), make_posts(spark, ["A" * 300]), EP)
    t = long.first()["text"]
    assert len(t) <= 210 and t.endswith("...")


def test_themes(spark):
    ep = entity_posts(spark, ["infrastructure development in Lagos is improving",
                              "infrastructure roads and bridges are great",
                              "infrastructure projects completed this year"], entity="Some Name")
    themes = [r["theme"] for r in prof.key_themes(ep, EP).collect()]
    assert themes[0] == "infrastructure"
    ep2 = entity_posts(spark, ["Babajide is doing well Babajide is great"], entity="Babajide Test")
    assert "babajide" not in [r["theme"] for r in prof.key_themes(ep2, EP).collect()]
    assert prof.key_themes(entity_posts(spark, []), EP).count() == 0


def test_themes_drop_punctuated_tokens(spark):
    ep = entity_posts(spark, ["lagos. lagos lagos"], entity="X Y")
    got = {r["theme"]: r["count"] for r in prof.key_themes(ep, EP).collect()}
    assert got == {"lagos": 2}


def test_demographics(spark):
    ep = entity_posts(spark, [("John Doe is great governor", "twitter"), ("John Doe for governor", "twitter"),
                              ("John Doe candidate", "nairaland")])
    aud = {r["platform"]: r for r in prof.platform_audience(ep).collect()}
    assert aud["twitter"]["posts"] == 2 and aud["twitter"]["share_pct"] == 66.7
    ep2 = entity_posts(spark, [("John Doe supports youth empowerment as governor", "twitter"),
                               ("John Doe connects with young voters", "nairaland")])
    sup = {r["category"]: r for r in prof.support_indicators(ep2, EP).collect()}
    assert sup["youth"]["mentions"] == 2 and sup["youth"]["strength"] == "moderate"
    assert prof.support_indicators(entity_posts(spark, []), EP).count() == 0


def test_regions(spark):
    ep = entity_posts(spark, ["John Doe north south", "John Doe north", "John Doe lga"])
    got = [(r["region"], r["mentions"]) for r in prof.regional_mentions(ep, EP).orderBy("rank").collect()]
    assert got == [("north", 2), ("south", 1), ("lga", 1)]


def test_engagement(spark):
    ep = entity_posts(spark, [{"text": "a", "likes": 10, "shares": 5}, {"text": "b", "likes": 20, "shares": 10}])
    out = prof.engagement(entities(spark), ep).first()
    assert (out["total_likes"], out["total_shares"], out["avg_likes"]) == (30, 15, 15.0)
    empty = prof.engagement(entities(spark), entity_posts(spark, [])).first()
    assert empty["total_likes"] == 0 and empty["avg_likes"] == 0.0


def test_nested_profile_defaults(spark):
    ents = entities(spark, ["John Doe", "Jane Roe"])
    s = sentiment(spark, [("twitter", "positive", 0.5)])
    ep = entity_posts(spark, ["John Doe youth north"])
    posts = make_posts(spark, ["John Doe youth north"])
    rows = {r["entity"]: r for r in prof.build_profiles(ents, s, ep, posts, EP).collect()}
    assert rows["Jane Roe"]["sentiment"]["total_analyzed"] == 0
    assert rows["Jane Roe"]["key_themes"] == [] and rows["Jane Roe"]["post_count"] == 0
    assert rows["John Doe"]["platform_breakdown"]["twitter"]["count"] == 1


def test_posts_are_kept_once_for_all_their_entities(spark):
    """One row per post with its entities; parts of both forms are the same,
    ids that occur twice count as often as their pairs."""
    from helpers import make_posts
    posts = make_posts(spark, ["ada obi great roads roads version", "bola ige great version"])
    posts = posts.unionByName(posts.filter("post_id = 2"))
    pairs = spark.createDataFrame([(1, "S", "ada obi"), (1, "S", "great roads"), (2, "S", "bola ige"),
                                   (2, "S", "bola ige"), (None, "S", "ada obi")],
                                  "post_id long, scope string, entity string")
    by_post = prof.posts_with_entities(pairs, posts)
    ep = pairs.join(posts.select("post_id", *prof.POST_FIELDS), "post_id")
    assert by_post.count() == 3
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(prof.per_entity(by_post)) == rows(ep)
    for part in (prof.key_themes, prof.theme_counts, prof.support_indicators, prof.regional_mentions):
        assert rows(part(by_post, EP)) == rows(part(ep, EP))
    got = {(r.entity, r.token): r["count"] for r in prof.theme_counts(by_post, EP).collect()}
    assert got[("ada obi", "roads")] == 2 and got[("bola ige", "version")] == 4
    assert ("great roads", "roads") not in got


def test_only_tokens_that_can_lead_are_counted_per_entity(spark, monkeypatch):
    """Themes equal those of all counts, whatever leaves a task at once and
    whatever is broadcast; rare tokens of other entities' posts do not leave."""
    texts = [f"common shared{'s' * (i % 3)} often often rare{'x' * i} only{'y' * i}" for i in range(40)]
    ps = make_posts(spark, texts)
    names = [("Ada Obi", 1), ("Often Bello", 2), ("Chi Eze", 5)]
    pairs = [(i + 1, "Lagos", n) for n, k in names for i in range(0, 40, k)]
    pairs += [(3, "Lagos", "Chi Eze")] * 2                # named twice in a post
    pairs += [(7, None, "Ada Obi"), (9, "Kano", "The Only")]
    by_post = prof.posts_with_entities(
        spark.createDataFrame(pairs, "post_id long, scope string, entity string"), ps)
    p = EP.with_(themes_top=3)

    def top(counts):
        held = {}
        for r in counts.collect():
            held.setdefault((r["scope"], r["entity"]), []).append((-r["count"], r["token"]))
        return {k: [(t, -c) for c, t in sorted(v)[:3]] for k, v in held.items()}

    want = top(prof.theme_counts(by_post, p))
    assert len(want) == 5
    for held, frequent in ((4_000_000, 500_000), (50, 500_000), (50, 2)):
        monkeypatch.setattr(prof, "HELD_TOKENS", held)
        monkeypatch.setattr(prof, "FREQUENT_TOKENS", frequent)
        assert top(prof.key_themes(by_post, p).withColumnRenamed("theme", "token")) == want
    monkeypatch.undo()
    most = prof.leading_counts(by_post, p).filter("entity = 'Ada Obi' AND scope = 'Lagos'").count()
    assert most < 10 < prof.theme_counts(by_post, p).filter("entity = 'Ada Obi' AND scope = 'Lagos'").count()
