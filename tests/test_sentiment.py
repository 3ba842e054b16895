"""Scorers, normalisers, tiers and the attribution fan-out."""

from pyspark.sql import functions as F

from helpers import EP, make_posts
from vocalis.operators import sentiment as S

LEX = {"good": 1.0, "great": 1.5, "bad": -1.0, "terrible": -2.0, "no": -0.5}
P = EP.with_(lexicon=LEX)


def scores(spark, texts):
    rows = S.lexicon_scores(make_posts(spark, texts), P).orderBy("post_id").collect()
    return [(r["label"], r["score"], r["confidence"]) for r in rows]


def test_lexicon_positive_negative(spark):
    (pos, neg, neu) = scores(spark, ["great good day", "terrible bad", "a plain sentence"])
    assert pos[0] == "positive" and pos[1] > 0
    assert neg[0] == "negative" and neg[1] < 0
    assert neu == ("neutral", 0.0, 0.0)


def test_null_and_empty_are_neutral(spark):
    assert scores(spark, [None, ""]) == [("neutral", 0.0, 0.0), ("neutral", 0.0, 0.0)]


def test_long_text_cut_to_1000_chars(spark):
    long = "x " * 600 + "great"          # the lexicon word sits after char 1000
    assert scores(spark, [long])[0][0] == "neutral"


def test_pidgin_text_scores(spark):
    assert scores(spark, ["dis governor no good at all"])[0][0] in ("positive", "negative", "neutral")


def test_compound_formula(spark):
    (lab, score, conf) = scores(spark, ["great"])[0]
    assert score == round(1.5 / (1.5 ** 2 + 15) ** 0.5, 4) and conf == score and lab == "positive"


def test_normalizers(spark):
    df = spark.createDataFrame([("POSITIVE", 0.9), ("negative", 0.8), ("neutral", 0.7), ("LABEL_2", 0.5)],
                               "l string, c double")
    lab, sc, cf = S.normalize_classifier("l", "c")
    got = [tuple(r) for r in df.select(lab, sc, cf).collect()]
    assert got == [("positive", 0.9, 0.9), ("negative", -0.8, 0.8), ("neutral", 0.0, 0.7),
                   ("neutral", 0.0, 0.5)]
    df2 = spark.createDataFrame([(0.05,), (-0.05,), (0.04,)], "c double")
    assert [r[0] for r in df2.select(S.normalize_compound("c")[0]).collect()] == \
        ["positive", "negative", "neutral"]
    df3 = spark.createDataFrame([(0.1, 0.3), (0.11, 0.3), (-0.2, 0.4)], "p double, s double")
    assert [tuple(r) for r in df3.select(*S.normalize_polarity("p", "s")).collect()] == \
        [("neutral", 0.1, 0.3), ("positive", 0.11, 0.3), ("negative", -0.2, 0.4)]


def test_model_scores_batches_and_fallback(spark):
    def factory():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("batch failed")
            return [{"label": "POSITIVE" if "good" in t else "NEGATIVE", "score": 0.75} for t in texts]
        return predict

    def one_by_one_factory():
        inner = factory()

        def predict(texts):
            if len(texts) == 1 and "boom" in texts[0]:
                raise RuntimeError("single failed")
            return inner(texts)
        return predict

    posts = make_posts(spark, ["good one", "bad one", "boom", None, "good again"])
    got = {r["post_id"]: (r["label"], r["score"]) for r in
           S.model_scores(posts, one_by_one_factory, batch_size=2).collect()}
    assert got[1] == ("positive", 0.75) and got[2] == ("negative", -0.75)
    assert got[3] == ("neutral", 0.0) and got[4] == ("neutral", 0.0) and got[5] == ("positive", 0.75)


def test_tier_resolution(spark):
    assert S.resolve_tier("transformers", ["lexicon"]) == "lexicon"
    assert S.resolve_tier("vader", ["vader", "lexicon"]) == "vader"
    assert S.resolve_tier("transformers", ["textblob", "lexicon"]) == "textblob"
    assert S.resolve_tier("textblob", ["transformers", "vader"]) == "none"      # never back
    posts = make_posts(spark, ["good", "bad"])
    none = S.tier_scores(posts, EP, "lexicon", {"vader": S.lexicon_scores})
    assert [(r.label, r.score, r.tier) for r in none.collect()] == [("neutral", 0.0, "none")] * 2


def test_attribution_fanout(spark):
    scored = spark.createDataFrame([(1, "L", "t", "positive", 0.5, 0.5), (2, "L", "t", "neutral", 0.0, 0.0)],
                                   "post_id long, scope string, platform string, label string, "
                                   "score double, confidence double")
    pairs = spark.createDataFrame([(1, "A B"), (1, "C D")], "post_id long, entity string")
    got = sorted((r["post_id"], r["entity"]) for r in S.attribute(scored, pairs).collect())
    assert got == [(1, "A B"), (1, "C D"), (2, "General")]


def test_distribution(spark):
    s = spark.createDataFrame([("L", "positive"), ("L", "negative"), ("L", "neutral"), ("L", "positive")],
                              "scope string, label string")
    r = S.label_distribution(s).first()
    assert (r["positive"], r["negative"], r["neutral"], r["total"], r["positive_pct"]) == (2, 1, 1, 4, 50.0)


def test_confidence_threshold_optional(spark):
    scored = spark.createDataFrame([(1, 0.2), (2, 0.9)], "post_id long, confidence double")
    assert S.apply_confidence_threshold(scored, None).count() == 2
    assert [r[0] for r in S.apply_confidence_threshold(scored, 0.5).select("post_id").collect()] == [2]
    assert F is not None


def test_lexicon_is_one_path_for_any_size(spark, monkeypatch):
    """Rows are scored one by one (also with one id), words fold to lower
    case once, and the size of the list only changes the join's plan."""
    posts = make_posts(spark, ["great good day", "terrible bad", None, "good"]).withColumn("post_id", F.lit(1))
    small = EP.with_(lexicon={"Good": 1.0, "good": 2.0, "terrible": -2.0})
    want = sorted((r.label, r.score) for r in S.lexicon_scores(posts, small).collect())
    assert want == sorted([("positive", 0.4588), ("positive", 0.4588), ("negative", -0.4588), ("neutral", 0.0)])
    big = small.with_(lexicon={**small.lexicon, **{f"x{'y' * i}": 1.0 for i in range(400)}})
    assert sorted((r.label, r.score) for r in S.lexicon_scores(posts, big).collect()) == want
    monkeypatch.setattr(S, "BROADCAST_LEXICON_ROWS", 0)
    assert sorted((r.label, r.score) for r in S.lexicon_scores(posts, big).collect()) == want


def test_scores_in_range_and_one_per_post(spark):
    texts = ["Great work by the governor!", "Terrible performance in office.", "This is a test."]
    got = scores(spark, texts)
    assert len(got) == 3
    assert all(lab in ("positive", "negative", "neutral") and -1.0 <= sc <= 1.0 for lab, sc, _ in got)


def test_lexicon_table_equals_the_word_list(spark, monkeypatch):
    """A table of words scores as the same words in the parameters, broadcast
    or not; null words and weights add nothing, folded words count once."""
    posts = make_posts(spark, ["Good good bad day", "a BAD one", "nothing here", "", "great Great GREAT"])
    words = {"good": 1.5, "bad": -2.0, "great": 3.0}
    want = sorted((r.post_id, r.label, r.score) for r in S.lexicon_scores(posts, P.with_(lexicon=words)).collect())
    table = spark.createDataFrame([("Good", 1.5), ("good", 1.0), ("BAD", -2.0), ("great", 3.0), (None, 9.0),
                                   ("here", None), ("great", 3.0)], "token string, weight double")
    for bound in (500_000, 0):
        monkeypatch.setattr(S, "BROADCAST_LEXICON_ROWS", bound)
        got = S.lexicon_scores(posts, P, lexicon=table).collect()
        assert sorted((r.post_id, r.label, r.score) for r in got) == want
    none = S.lexicon_scores(posts, P, lexicon=table.limit(0)).collect()
    assert {r.label for r in none} == {"neutral"} and len(none) == 5
