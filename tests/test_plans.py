"""Plan-shape guards for the scale properties (no text shuffle in the fused
join, window group limits for top-k, pruned and pushed-down scans)."""

import io
import os
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from vocalis.params import driver_params
from vocalis.sources.tables import posts_view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_fused_contains_join_has_no_shuffle(spark):
    from vocalis.operators import proximity as X
    p = driver_params()
    posts = posts_view(spark, SF).filter(F.col("scope").isin(list(p.scopes)))
    names = spark.createDataFrame([("en", "Apache License"), ("de", "Stteen Erachtz")], "scope string, name string")
    text = plan(X.pair_stats_join(posts, names, 2, p))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def exchanged(df) -> list[set[str]]:
    """The columns of every shuffle of a plan."""
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.initialPlan())
            continue
        out = node.output()
        if node.nodeName() == "Exchange":
            found.append({out.apply(i).name() for i in range(out.size())})
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return found


def test_no_text_is_shuffled_beyond_the_broadcast_limits(spark, monkeypatch):
    from vocalis.operators import containment as C
    from vocalis.operators import proximity as X
    monkeypatch.setattr(C, "BROADCAST_ANCHOR_ROWS", 1)
    monkeypatch.setattr(C, "BROADCAST_KEY_ROWS", 1)
    p = driver_params()
    posts = posts_view(spark, SF).filter(F.col("scope").isin(list(p.scopes)))
    names = spark.createDataFrame([("en", "Apache License"), ("de", "Stteen Erachtz")], "scope string, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = [exchanged(df) for df in (X.pair_stats_join(posts, names, None, p), C.contains_join(posts, names))]
        carrying = [c for c in exchanged(C.contains_join_small(posts, names.select("name"), broadcast_rows=0))
                    if c & {"text", "tl"}]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for columns in shuffles:
        assert any({"before", "after"} <= c for c in columns)
        assert not any(c & {"text", "tl", "pieces"} for c in columns)
    # the text meets the candidates in one join, without an explode before it
    assert len(carrying) <= 1 and not any("key" in c or "cands" in c for c in carrying)


def test_topk_windows_use_group_limit(spark):
    from vocalis.operators import profile as prof
    ep = spark.createDataFrame([("en", "A B", 1, "the words here")],
                               "scope string, entity string, post_id long, text string")
    text = plan(prof.key_themes(ep, driver_params()))
    assert "WindowGroupLimit" in text


def test_scan_is_pruned_and_filtered(spark):
    df = posts_view(spark, SF).filter(F.col("scope") == "en").select("post_id", "likes")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in text


def test_pairs_are_summed_once_without_sorting(spark):
    """Platforms of a name are bits of a number, so no task sorts its pairs, and
    what reads the sums per name does not read the pairs again."""
    from vocalis.operators import proximity as X
    from vocalis.operators.entities import discover
    from helpers import EP, make_posts
    rows = [("S", n, k, 1, 0, 2, 3, i) for i, (n, k) in enumerate(
        [("A B", "web"), ("A B", None), ("A B", "forum"), ("A B", "web"), ("C D", None)])]
    pairs = spark.createDataFrame(rows, "scope string, name string, platform string, role_hits int, rival_hits int, "
                                        "role_scope_hits int, context_score int, post_id long")
    kinds = X.platform_list(pairs)
    assert kinds == ["forum", "web"]
    summed = X.name_stats(pairs, kinds)
    assert sorted(map(repr, summed.collect())) == sorted(map(repr, X.name_stats(pairs).collect()))
    assert "ObjectHashAggregate" not in plan(summed) and "SortAggregate" not in plan(summed)
    assert X.platform_list(spark.range(80).select(F.col("id").cast("string").alias("platform"))) is None
    d = discover(make_posts(spark, ["Ada Obi governor of Lagos", "Ada Obi spoke"]), EP)
    assert "ci_posts" in d.nodes._jdf.queryExecution().analyzed().toString()
    assert "collect_set" not in plan(d.nodes) and "bit_or" not in plan(d.nodes)


def test_a_text_is_lower_cased_once_per_post(spark):
    """Not for each entity and keyword, in a filter before the rows are made or in them."""
    from vocalis.operators import profile as prof
    ep = spark.createDataFrame(
        [("A work of Ada Obi and IBN Zed", [("s", "Ada Obi"), ("s", "Ibn Zed"), ("s", "Not There")]), (None, [("s", "x y")])],
        "text string, ents array<struct<scope:string,entity:string>>")
    p = driver_params()
    for found, kind in ((prof.support_indicators(ep, p), "category"), (prof.regional_mentions(ep, p), "region")):
        assert plan(found).count("lower(text") == 1
        assert sorted((r["entity"], r[kind]) for r in found.collect()) == [
            (e, "b" if kind == "category" else "work") for e in ("Ada Obi", "Ibn Zed")]
