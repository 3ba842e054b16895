"""Scalar helpers: cleaning, hashing, dates, formats, rounding."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from vocalis.functions import dates as D
from vocalis.functions import text as T


def one(spark, col, value=None, ddl="v string"):
    df = spark.createDataFrame([(value,)], ddl)
    return df.select(col.alias("r")).first()["r"]


def test_clean_text(spark):
    assert "   " not in one(spark, T.clean_text("v"), "hello   world")
    assert one(spark, T.clean_text("v"), "  hello  ") == "hello"
    assert one(spark, T.clean_text("v"), "") == ""
    assert one(spark, T.clean_text("v"), None) == ""
    assert "Sanwo-Olu" in one(spark, T.clean_text("v"), "Governor Sanwo-Olu is doing well")
    assert one(spark, T.clean_text("v"), "see http://x.y/z and www.a.b now\n\tok") == "see and now ok"


def test_anonymize(spark):
    a = one(spark, T.anonymize_author("v"), "user123")
    assert a == hashlib.sha256(b"user123").hexdigest()[:12]
    assert a != one(spark, T.anonymize_author("v"), "user_b")
    assert one(spark, T.anonymize_author("v"), "") == "anonymous"
    assert one(spark, T.anonymize_author("v"), None) == "anonymous"


def test_parse_date(spark):
    p = lambda s: one(spark, D.parse_date("v", "2025-06-01"), s)
    assert p("2025-01-15") == dt.datetime(2025, 1, 15)
    assert p("not a date") is None
    assert p("") is None
    assert p("2025-01-15T10:20:30Z") == dt.datetime(2025, 1, 15, 10, 20, 30)
    assert p("2025-01-15T10:20:30.123Z") == dt.datetime(2025, 1, 15, 10, 20, 30, 123000)
    assert p("Jan 05, 2025") == dt.datetime(2025, 1, 5)
    assert p("05 Jan 2025") == dt.datetime(2025, 1, 5)
    assert p("January 05, 2025") == dt.datetime(2025, 1, 5)
    assert p("1:01pmOnFeb 12") == dt.datetime(2025, 2, 12, 13, 1)
    assert p("10:36amOnFeb 05") == dt.datetime(2025, 2, 5, 10, 36)
    assert p("2025-1-5") == dt.datetime(2025, 1, 5)
    assert p("2024-01-01T05:00:00+0000") == dt.datetime(2024, 1, 1, 5, 0)


def test_format_and_range(spark):
    df = spark.createDataFrame([("2025-01-15 10:00:00", "x"), (None, "raw")], "v string, raw string")
    ts = D.parse_date("v")
    got = [r["d"] for r in df.select(D.format_date(ts, F.col("raw")).alias("d")).collect()]
    assert got == ["2025-01-15 10:00:00", "raw"]
    inr = df.select(D.within_range(ts, "2025-02-01", 1).alias("r")).collect()
    assert [r["r"] for r in inr] == [True, True]      # unknown passes
    out = df.select(D.within_range(ts, "2025-06-01", 1).alias("r")).collect()
    assert [r["r"] for r in out] == [False, True]


def test_like_count(spark):
    for raw, want in (("12 Likes", 12), ("1 Like", 1), ("x", 0), (None, 0), ("", 0)):
        assert one(spark, T.parse_like_count("v"), raw) == want


def test_display_formats(spark):
    assert one(spark, T.signed3("v"), 0.5, "v double") == "+0.500"
    assert one(spark, T.pct1("v"), 33.33, "v double") == "33.3%"
    assert one(spark, T.capitalize("v"), "twitter") == "Twitter"
    assert one(spark, T.capitalize("v"), "tWITTER") == "Twitter"
    assert one(spark, T.slug("v"), "Cross River") == "cross-river"
    assert one(spark, T.thousands("v"), 1234567, "v long") == "1,234,567"
    assert one(spark, T.score_indicator("v"), 0.2, "v double") == "Positive"
    assert one(spark, T.score_indicator("v"), -0.1, "v double") == "Neutral"


def test_half_even_rounding(spark):
    assert one(spark, T.round_half_even("v", 1), 6.25, "v double") == 6.2
    assert one(spark, T.round_half_even("v", 1), 6.35, "v double") == round(6.35, 1)
    assert one(spark, T.round_half_even("v", 1), 33.33333, "v double") == 33.3


def test_keyword_membership(spark):
    assert one(spark, T.contains_any("v", ["abc", "zz"]), "xxabcxx")
    assert one(spark, T.count_contained("v", ["a", "b", "a", "q"]), "ab") == 2
    assert one(spark, T.majority_match("v", F.lit("lagos governor 2027")), "the lagos governor")
    assert not one(spark, T.majority_match("v", F.lit("lagos governor 2027")), "lagos only")


def test_excerpt(spark):
    assert one(spark, T.truncate_excerpt("v", 5), "abcdefgh") == "abcde..."
    assert one(spark, T.truncate_excerpt("v", 5), "abc") == "abc"


def test_exact_mean_ties_independent_of_order(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, 0.6307), (1, 0.6308), (1, 0.6308), (1, 0.6307),
                                (2, 0.6306), (2, 0.6307), (3, -0.0003), (3, 0.0002)],
                               "g long, v double")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(T.exact_mean("v", 4).alias("m")).collect()}
    assert got[1] == 0.6308            # 0.63075 -> even
    assert got[2] == 0.6306            # 0.63065 -> even
    assert str(got[3]) == "-0.0"       # exactly -0.00005 -> even (0), sign kept
    assert F is not None
