"""The anchor contains-join equals the nested-loop join (property test)."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import EP, make_posts
from vocalis.operators.containment import anchor_key, contains_join, contains_join_small

ALPHA = "ab c-'"
word = st.text(alphabet="abAB", min_size=2, max_size=4)


def brute(texts, names):
    return {(i + 1, n) for i, t in enumerate(texts) for n in names if n.lower() in (t or "").lower()}


def run(spark, texts, names, broadcast_rows):
    posts = make_posts(spark, texts, scope="S")
    nd = spark.createDataFrame([("S", n) for n in names], "scope string, name string")
    got = contains_join(posts, nd, broadcast_rows).select("post_id", "name").collect()
    return {(r["post_id"], r["name"]) for r in got}


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="abAB -'", max_size=40), min_size=1, max_size=6),
       names=st.lists(st.lists(word, min_size=2, max_size=3).map(" ".join), min_size=1, max_size=5,
                      unique=True))
def test_anchor_join_equals_nested_loop(spark, texts, names):
    assert run(spark, texts, names, 10) == brute(texts, names)


def random_texts(seed=3, n=30):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ab  Ba") for _ in range(rnd.choice([0, 3, 60, 400]))) for _ in range(n)]


NAMES = ["ab ba", "aab bba", "ab ab ab", "BA ab", "abb aab ba", "aa aa", "aa aa aa"]


def test_anchor_join_beyond_the_limits(spark, monkeypatch):
    import vocalis.operators.containment as C
    texts = [*random_texts(), None, "", " ", " ab ba", "ab ba ", "ab  ba", "x\nab ba"]
    want = brute(texts, NAMES)
    assert run(spark, texts, NAMES, None) == want                  # fused
    monkeypatch.setattr(C, "BROADCAST_ANCHOR_ROWS", 1)
    assert run(spark, texts, NAMES, None) == want                  # windows, one part
    monkeypatch.setattr(C, "BROADCAST_KEY_ROWS", 1)
    assert run(spark, texts, NAMES, None) == want                  # windows, a part for each key
    posts = make_posts(spark, texts, scope="S")
    nd = spark.createDataFrame([("S", n) for n in NAMES], "scope string, name string")
    sized = contains_join(posts, nd, None, (), lambda tl, c: F.struct(F.length(tl).alias("n")))
    assert {(r.post_id, r.name, r.x.n) for r in sized.collect()} == {(i, n, len(texts[i - 1])) for i, n in want}


@pytest.mark.parametrize("limit", [200_000, 1])
def test_counters_from_windows_are_those_of_the_text(spark, monkeypatch, limit):
    import vocalis.operators.containment as C
    from vocalis.operators import proximity as X
    p = EP.with_(role_keywords=("bab", "aaa"), rival_keywords=("bbb",), context_words=("abab", "b b"), scopes=("ab",),
                 scope_variants={}, role_window=7, scope_window=11)
    texts = [*random_texts(5, 40), "aa aa aa aa", "ab ba" * 400]
    posts = make_posts(spark, texts, scope="ab")
    nd = spark.createDataFrame([("ab", n) for n in NAMES], "scope string, name string")
    cols = ["post_id", "name", "occ", "role_hits", "rival_hits", "role_scope_hits", "context_score"]
    want = sorted(map(tuple, X.pair_stats_join(posts, nd, 2, p).select(*cols).collect()))
    monkeypatch.setattr(C, "BROADCAST_KEY_ROWS", limit)
    got = sorted(map(tuple, X.window_stats_join(posts, nd, p).select(*cols).collect()))
    assert got == want and sum(r[3] > 0 for r in got) > 5 and sum(r[4] > 0 for r in got) > 5


@pytest.mark.parametrize("run_rows", [1_000, 2])
def test_supplied_names_beyond_the_limit(spark, monkeypatch, run_rows):
    import vocalis.operators.containment as C
    monkeypatch.setattr(C, "RUN_CANDIDATES", run_rows)
    names = ["a", "ab", "bab", "abab b", " ", "zzz", "AB ", "a.b", ""]
    texts = [*random_texts(7), None, "", "a.b", "z"]
    posts = make_posts(spark, texts, scope="S")
    want = {(i + 1, n) for i, t in enumerate(texts) for n in names if n and n.lower() in (t or "").lower()}
    nd = spark.createDataFrame([(n,) for n in names], "name string")
    for rows in (0, 100):
        got = contains_join_small(posts, nd, broadcast_rows=rows)
        assert {(r.post_id, r.name) for r in got.collect()} == want
    scoped = spark.createDataFrame([("S", "ab"), ("T", "ba")], "scope string, name string")
    got = contains_join_small(posts, scoped, broadcast_rows=0)
    assert {r.name for r in got.collect()} == {"ab"}


def test_anchor_keys(spark):
    df = spark.createDataFrame([("apache license",), ("al gore",), ("ab cdef",), ("abc de",)], "n string")
    assert [r[0] for r in df.select(anchor_key("n")).collect()] == ["che lic", "al go", "ab cd", "bc de"]


def test_small_name_list_join(spark):
    posts = make_posts(spark, ["GNU license here", "nothing", "the gnu gnu"], scope="S")
    names = spark.createDataFrame([("gnu",), ("license",)], "name string")
    got = {(r["post_id"], r["name"]) for r in contains_join_small(posts, names).collect()}
    assert got == {(1, "gnu"), (1, "license"), (3, "gnu")}
    assert F is not None


def test_one_walk_gives_places_and_counters(spark):
    """Overlaps, names folding together, texts of other and null scopes, names
    that share an anchor; a text is not walked again for each name."""
    from vocalis.operators.containment import name_hits, name_index, text_walk
    posts = make_posts(spark, ["on on on on x", "x Ada Obi", None, ""], scope="S")
    other = make_posts(spark, ["on on on"], scope="T").unionByName(
        make_posts(spark, ["on on on"], scope="S").withColumn("scope", F.lit(None).cast("string")))
    nd = spark.createDataFrame([("S", n) for n in ("On On", "On On On", "Ada Obi", "ADA OBI", "On On Zed")]
                               + [(None, "on on")], "scope string, name string")
    near = {"x_near": (2, [F.array(F.lit("x"))])}
    got = name_hits(posts.unionByName(other), nd, (), near).select("scope", "name", "n", "first", "last", "x_near")
    assert sorted(map(tuple, got.collect())) == [
        ("S", "ADA OBI", 1, 3, 3, 1), ("S", "Ada Obi", 1, 3, 3, 1),
        ("S", "On On", 3, 1, 7, 1), ("S", "On On On", 2, 1, 4, 1)]
    places, _, _ = text_walk()

    class Counted(str):
        found = 0

        def find(self, *a):
            Counted.found += 1
            return str.find(self, *a)

    names = [f"on on{i}" for i in range(500)]
    text = Counted("on on7 and on on8")
    assert places(text, name_index(["S"] * 500, names)["S"]) == {7: [0], 8: [11]}
    assert Counted.found <= 6


def test_walk_does_not_stop_at_every_space():
    """No step of Python per word of a text, only per occurrence."""
    from vocalis.operators.containment import name_index, text_walk
    places, _, _ = text_walk()

    class Counted(str):
        found = 0

        def find(self, *a):
            Counted.found += 1
            return str.find(self, *a)

    text = Counted("a word of it " * 2000 + "ada obi ada obi")
    index = name_index(["S", "S", "S"], ["ada obi", "obi ada", "it"])["S"]
    assert places(text, index) == {0: [26000, 26008], 1: [26004]}
    assert Counted.found <= 10


def test_counters_of_a_walk_equal_each_name_on_its_own(spark, monkeypatch):
    """Several posts leave a task at once, or each on its own, with the same rows."""
    from vocalis.operators import containment as C
    texts = ["on on on on x", "x Ada Obi y ada obi on on", "ada obi y", None, "", "y on on"]
    posts = make_posts(spark, texts, scope="S").coalesce(1)
    names = ["On On", "On On On", "Ada Obi", "ADA OBI"]
    nd = spark.createDataFrame([("S", n) for n in names], "scope string, name string")
    near = {"x_near": (3, [F.array(F.lit("x"))]), "both": (4, [F.array(F.lit("x"), F.lit("on")), F.array(F.lit("y"))])}
    want = []
    for i, t in enumerate(texts):
        for name in names:
            t, nl = t or "", name.lower()
            at = [s for s in range(len(t)) if t.lower().startswith(nl, s)]
            seen = [[any(w in t.lower()[max(0, s - r):s + len(nl) + r] for w in ws) for s in at]
                    for r, ws in ((3, "x"), (4, ("x", "on")), (4, "y"))]
            if at:
                want.append((i + 1, name, len(at), at[0] + 1, at[-1] + 1, sum(seen[0]),
                             sum(a and b for a, b in zip(seen[1], seen[2]))))
    for rows in (1, 50_000):
        monkeypatch.setattr(C, "FOUND_ROWS", rows)
        got = C.name_hits(posts, nd, (), near).select("post_id", "name", "n", "first", "last", "x_near", "both")
        assert sorted(map(tuple, got.collect())) == sorted(want)
