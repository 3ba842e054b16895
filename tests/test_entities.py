"""Entity discovery: extraction, stop names, titles, variant merge, gates."""

import random

from pyspark.sql import functions as F

from helpers import EP, make_posts
from vocalis.operators.entities import discover, filter_entities
from vocalis.operators.mentions import extract_mentions, is_stop_name, strip_titles
from vocalis.operators.variants import merge_variants


def names_of(spark, rows, p=EP):
    m = extract_mentions(make_posts(spark, rows), p)
    return {r["name"]: r for r in m.groupBy("name").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.array_sort(F.collect_set("platform")).alias("platforms")).collect()}


# --- extraction ---------------------------------------------------------------
def test_extracts_two_word_names(spark):
    assert names_of(spark, ["Babajide Sanwo-Olu is the governor"])


def test_extracts_three_word_names(spark):
    assert "Abdul-Azeez Olajide Adediran" in names_of(spark, ["Abdul-Azeez Olajide Adediran is running"])


def test_ignores_single_words(spark):
    res = names_of(spark, ["Somebody said something"])
    assert all(len(n.split()) >= 2 for n in res)


def test_handles_empty_posts(spark):
    assert names_of(spark, [""]) == {}


def test_tracks_platforms(spark):
    res = names_of(spark, [("Yakubu Dogara for governor", "twitter"),
                           ("Yakubu Dogara visited Kano", "nairaland")])
    assert res["Yakubu Dogara"]["platforms"] == ["nairaland", "twitter"]


def test_strips_title_prefixes(spark):
    res = names_of(spark, ["Mr Babajide Sanwo-Olu is running"])
    assert "Babajide Sanwo-Olu" in res and "Mr Babajide Sanwo-Olu" not in res


def test_possessive_removed(spark):
    assert "Peter Obi" in names_of(spark, ["Peter Obi's campaign"])


def test_rejects_party_names(spark):
    assert "All Progressives Congress" not in names_of(spark, ["All Progressives Congress won the election"])


def test_rejects_non_name_phrases(spark):
    assert "Electronic Transmission" not in names_of(spark, ["Electronic Transmission of results failed"])


# --- stop names / titles ----------------------------------------------------------
def _stop(spark, name):
    return spark.range(1).select(is_stop_name(F.lit(name), EP).alias("s")).first()["s"]


def _strip(spark, name):
    return spark.range(1).select(strip_titles(F.lit(name), EP).alias("s")).first()["s"]


def test_stop_names(spark):
    assert _stop(spark, "Cross River")
    assert _stop(spark, "National Assembly")
    assert _stop(spark, "All Progressives Congress")
    assert _stop(spark, "Peoples Democratic Party")
    assert _stop(spark, "Polling Officer")
    assert _stop(spark, "Aso Rock")
    assert not _stop(spark, "Babajide Sanwo-Olu")
    assert not _stop(spark, "Abdullahi Ganduje")


def test_strip_titles(spark):
    assert _strip(spark, "Mr Peter Obi") == "Peter Obi"
    assert _strip(spark, "Gov Ifeanyi Ugwuanyi") == "Ifeanyi Ugwuanyi"
    assert _strip(spark, "Former Chairman") == "Chairman"
    assert _strip(spark, "Babajide Sanwo-Olu") == "Babajide Sanwo-Olu"
    assert _strip(spark, "Chief Alhaji Ganduje") == "Ganduje"
    assert _strip(spark, "Mr Dr") == ""


# --- variant merge --------------------------------------------------------------
NODE_DDL = "scope string, name string, cnt long, platforms array<string>, rk struct<c:long,f:long>"


def _nodes(spark, rows):
    # rows: (name, count, platforms); rank = count desc then list order
    n = len(rows)
    return spark.createDataFrame(
        [("S", name, c, plats, {"c": c, "f": n - i}) for i, (name, c, plats) in enumerate(rows)], NODE_DDL)


def test_merges_same_words_different_order(spark):
    out = merge_variants(_nodes(spark, [("Peter Obi", 5, ["twitter"]), ("Obi Peter", 3, ["nairaland"])])).collect()
    assert len(out) == 1 and out[0]["cnt"] == 8 and out[0]["name"] == "Peter Obi"
    assert out[0]["platforms"] == ["nairaland", "twitter"]


def test_keeps_distinct_names(spark):
    out = merge_variants(_nodes(spark, [("Babajide Sanwo-Olu", 5, ["t"]), ("Abdullahi Ganduje", 3, ["n"])]))
    assert out.count() == 2


def test_merge_is_not_transitive(spark):
    # "Abba Kabir Yusuf" absorbs both shorter forms only when it ranks first
    out = merge_variants(_nodes(spark, [("Abba Yusuf", 9, ["a"]), ("Abba Kabir Yusuf", 5, ["b"]),
                                        ("Abba Kabir", 4, ["c"])])).collect()
    got = {r["name"]: r["cnt"] for r in out}
    assert got == {"Abba Yusuf": 14, "Abba Kabir": 4}


def greedy(rows):
    """The sequential greedy merge, for comparison."""
    order = list(rows)
    skip, out = set(), {}
    for i, (a, ca, _) in enumerate(order):
        if a in skip:
            continue
        wa = set(a.lower().split())
        total = ca
        for j, (b, cb, _) in enumerate(order):
            if i == j or b in skip:
                continue
            wb = set(b.lower().split())
            if wa == wb or wa <= wb or wb <= wa:
                total += cb
                skip.add(b)
        out[a] = total
    return out


def test_merge_rounds_equal_greedy_loop(spark):
    rnd = random.Random(7)
    words = ["ab", "cd", "ef", "gh", "ij"]
    for _ in range(3):
        names = set()
        while len(names) < 14:
            names.add(" ".join(rnd.sample(words, rnd.choice([2, 3]))))
        rows = [(n, rnd.randint(1, 6), ["p"]) for n in sorted(names)]
        rows.sort(key=lambda r: -r[1])  # stable: count desc, then list order
        got = {r["name"]: r["cnt"] for r in merge_variants(_nodes(spark, rows)).collect()}
        assert got == greedy(rows)


# --- gates and score ------------------------------------------------------------
MERGED_DDL = "scope string, name string, cnt long, platforms array<string>, rk struct<c:long,f:long>"


def _filter(spark, name, cnt, platforms, texts, scope):
    merged = spark.createDataFrame([(scope, name, cnt, platforms, {"c": cnt, "f": 0})], MERGED_DDL)
    posts = make_posts(spark, texts, scope=scope)
    return filter_entities(merged, posts, EP).collect()


def test_filters_low_frequency(spark):
    assert _filter(spark, "John Smith", 1, ["twitter"], ["John Smith governor election"], "Lagos") == []


def test_keeps_high_frequency_with_context(spark):
    out = _filter(spark, "Yakubu Dogara", 5, ["nairaland", "twitter"],
                  ["Yakubu Dogara for Kano governor election candidate",
                   "Yakubu Dogara Kano governor campaign",
                   "Yakubu Dogara speaks at APC rally Kano governor"], "Kano")
    assert len(out) == 1


def test_rejects_name_without_scope_context(spark):
    assert _filter(spark, "John Doe", 5, ["nairaland"], ["John Doe for governor election candidate"],
                   "Lagos") == []


def test_cross_platform_bonus(spark):
    texts = ["Yakubu Dogara Kano governor election candidate", "Sani Danladi Kano governor election candidate"]
    multi = _filter(spark, "Yakubu Dogara", 3, ["nairaland", "twitter"], texts, "Kano")
    single = _filter(spark, "Sani Danladi", 3, ["twitter"], texts, "Kano")
    assert multi[0]["score"] > single[0]["score"]


def test_rejects_name_near_governor_but_wrong_scope(spark):
    texts = ["Yakubu Dogara governor election candidate in Bauchi state"] * 5
    assert _filter(spark, "Yakubu Dogara", 10, ["nairaland"], texts, "Lagos") == []


def test_accepts_name_with_correct_scope_and_role(spark):
    texts = ["Babajide Sanwo-Olu Lagos governorship candidate election"] * 3
    out = _filter(spark, "Babajide Sanwo-Olu", 5, ["nairaland"], texts, "Lagos")
    assert [r["name"] for r in out] == ["Babajide Sanwo-Olu"]


def test_rival_hits_reject(spark):
    texts = ["Bola Tinubu president Lagos governor"] * 3
    assert _filter(spark, "Bola Tinubu", 3, ["twitter"], texts, "Lagos") == []


def test_whole_discovery_inline(spark):
    texts = [("Babajide Sanwo-Olu Lagos governorship candidate election", "twitter")] * 2 + \
            [("Governor Babajide Sanwo-Olu of Lagos campaign", "nairaland")]
    d = discover(make_posts(spark, texts, scope="Lagos"), EP)
    got = [(r["name"], r["mention_count"], r["platforms"]) for r in d.entities.collect()]
    # "Babajide Sanwo-Olu Lagos" (2 matches) is a 3-word name of its own; it is
    # absorbed by "Babajide Sanwo-Olu" (3 posts after the recount): 3 + 2.
    assert got == [("Babajide Sanwo-Olu", 5, ["nairaland", "twitter"])]
    merged = {r["name"]: r["n_variants"] for r in d.merged.collect()}
    assert merged == {"Babajide Sanwo-Olu": 2}


def test_long_texts_are_walked_in_chunks(spark, monkeypatch):
    """Windows across chunk borders count once, where their occurrence starts."""
    from vocalis.operators import proximity as X
    filler = "plain words go on here and there "
    texts = [filler * k + "governor Ada Obi for governor " + filler * (k % 3) + "Ada Obi Ada Obi" for k in range(12)]
    posts = make_posts(spark, texts)
    names = spark.createDataFrame([("Lagos", "Ada Obi")], "scope string, name string")

    def run():
        rows = X.pair_stats_join(posts, names, 1, EP).collect()
        return sorted(tuple(sorted(r.asDict(recursive=True).items(), key=lambda kv: kv[0])) for r in rows)

    want = repr(run())
    for size in (7, 40, 100):
        monkeypatch.setattr(X, "CHUNK_CHARS", size)
        assert repr(run()) == want


def test_long_chain_of_variants_loses_no_name(spark):
    """A chain of names, each decided only after the one before it."""
    words = [chr(65 + i) + chr(97 + i) for i in range(12)]
    names = [f"{a} {b}" for a, b in zip(words, words[1:])]
    chain = []
    for i, (a, b) in enumerate(zip(names, names[1:])):
        chain += [(a, 100 - 2 * i), (a + " " + b.split()[1], 99 - 2 * i)]
    nodes = spark.createDataFrame([("s", n, c, ["p"], (c, i)) for i, (n, c) in enumerate(dict(chain).items())],
                                  "scope string, name string, cnt long, platforms array<string>, "
                                  "rk struct<c:long,f:long>")
    from vocalis.operators.variants import merge_variants
    got = merge_variants(nodes).collect()
    assert sum(r.cnt for r in got) == sum(dict(chain).values())
    assert sum(r.n_variants for r in got) == len(dict(chain))


def test_supplied_names_of_any_number(spark):
    from vocalis.operators.entities import role_detection
    posts = make_posts(spark, ["governor Zed here", "nothing"])
    many = spark.createDataFrame([("Lagos", f"name{i}") for i in range(1500)] + [("Lagos", "Zed")],
                                 "scope string, name string")
    got = role_detection(posts, many, EP).collect()
    assert [(r.name, r.verdict) for r in got] == [("Zed", "more role")]


def test_supplied_names_are_summed_where_a_text_is_read(spark, monkeypatch):
    """Hits of many names equal those of the fused join: overlaps, names that
    fold together, names of one scope and of all, words of one letter, keywords
    at the edges of a window and of a long text, null texts and scopes.  No text
    is shuffled, and no row leaves a task per post and name."""
    import random
    from test_plans import exchanged
    from vocalis.operators import containment as C
    from vocalis.operators.entities import role_detection
    rng = random.Random(11)
    p = EP.with_(scopes=(), role_keywords=("gov", "aa b"), rival_keywords=("zz",), role_window=5)
    texts = ["".join(rng.choices(["a", "b", " ", "A", "gov", "zz", "İ"], [6, 6, 4, 2, 1, 1, 1], k=rng.choice([5, 60, 400])))
             for _ in range(120)] + [None, "", "gov", "zz" + "ab " * 4000 + "gov", "x" * 9000 + "ab gov ab" + "y" * 9000]
    posts = make_posts(spark, [{"text": t, "scope": ["S", "T", None][i % 3]} for i, t in enumerate(texts)])
    names = [(None, "ab"), (None, "AB"), (None, "a"), (None, "aa"), (None, "b a"), (None, "gov"), ("S", "aa b"),
             ("T", "ba"), (None, "ba"), ("S", "gov zz"), (None, ""), (None, None), ("Q", "a"), (None, "i\u0307")]
    supplied = spark.createDataFrame(names, "scope string, name string")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(role_detection(posts, supplied, p))
    assert len(want) > 20
    many = role_detection(posts, supplied, p, broadcast_rows=0)
    assert rows(many) == want
    assert not any(c & {"text", "tl", "post_id"} for c in exchanged(many))
    monkeypatch.setattr(C, "BROADCAST_KEY_ROWS", 2)
    monkeypatch.setattr(C, "SUMMED_ROWS", 3)
    assert rows(role_detection(posts, supplied, p, broadcast_rows=0)) == want
    # posts that share an id meet all texts of it, beside the others
    twice = posts.unionByName(posts.filter("post_id IN (3, 4)"))
    single = rows(role_detection(posts.filter("post_id NOT IN (3, 4)"), supplied, p, broadcast_rows=0))
    both = {(r.scope, r.name): (r.role_hits, r.rival_hits) for r in
            role_detection(twice, supplied, p, broadcast_rows=0).collect()}
    once = {(r.scope, r.name): (r.role_hits, r.rival_hits) for r in role_detection(posts, supplied, p).collect()}
    left = {(r.scope, r.name): (r.role_hits, r.rival_hits) for r in
            role_detection(posts.filter("post_id NOT IN (3, 4)"), supplied, p).collect()}
    assert len(single) == len(left)
    assert both == {k: tuple(a + 3 * (a - b) for a, b in zip(v, left.get(k, (0, 0)))) for k, v in once.items()}


def test_election_binding_wants_stop_words():
    import pytest
    from vocalis.params import election_params
    with pytest.raises(ValueError):
        election_params()
    assert election_params(stop_words=()).stop_words == ()


def test_names_are_absorbed_without_waiting_for_other_neighbours(spark, monkeypatch):
    """A name next to a kept one is decided in the round the kept one is; the
    rounds do not read again what earlier rounds decided."""
    from vocalis.operators import variants
    names = [" ".join(f"W{c}" for c in "abcdefghijklmnop"[i // 2:i // 2 + 2 + i % 2]) for i in range(24)]
    calls = []
    cut = variants.cut_lineage
    monkeypatch.setattr(variants, "cut_lineage", lambda df: calls.append(1) or cut(df))
    got = {r["name"]: (r["cnt"], r["n_variants"]) for r in variants.merge_variants(
        _nodes(spark, [(n, 100 - i, ["t"]) for i, n in enumerate(names)])).collect()}
    assert got == {n: (100 - i + 99 - i, 2) for i, n in enumerate(names) if i % 2 == 0}
    assert len(calls) <= 2 + 2 * 12
