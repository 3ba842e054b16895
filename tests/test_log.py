"""Tables with a commit log: ids, interleaved writers, failures, batches."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from helpers import make_posts
from vocalis.sinks import log as LOG

ENT = "scope string, name string, n long"


def ents(spark, rows):
    return spark.createDataFrame(rows, ENT)


def stored(table):
    return sorted(((r.scope, r.name, r.n) for r in table.read().collect()), key=str)


def test_interleaved_appends_get_ids_of_their_own(spark, tmp_out):
    table = LOG.posts_log(spark, os.path.join(tmp_out, "posts"))
    a = spark.range(1000).select(F.lit("A").alias("scope"), F.col("id").alias("n")).repartition(7)
    first, second = table.stage(a), table.stage(a.withColumn("scope", F.lit("B")))
    assert first.seen.version == second.seen.version == -1 and table.read() is None
    assert table.commit(second).version == 0
    assert table.read().count() == 1000                  # nothing of the other writer yet
    assert table.commit(first).version == 1              # its version was taken: tried again
    ids = [r.post_id for r in table.read().collect()]
    assert len(ids) == 2000 == len(set(ids)) and max(ids) < table.state().next_id < 2 * 1000 * 2
    again = {(r.scope, r.n): r.post_id for r in table.read().collect()}
    assert {(r.scope, r.n): r.post_id for r in table.read().collect()} == again


def test_writers_in_threads(spark, tmp_out):
    path = os.path.join(tmp_out, "posts")
    posts = make_posts(spark, ["one post", "two posts", "three posts"])
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: LOG.append_posts(posts, path), range(5)))
    rows = LOG.posts_log(spark, path).read()
    assert rows.count() == 15 == rows.select("post_id").distinct().count()
    assert rows.select("native_id").distinct().count() == 3


def test_failed_write_leaves_the_table_as_it_was(spark, tmp_out):
    table = LOG.LoggedTable(spark, os.path.join(tmp_out, "e"))
    table.replace_scopes(ents(spark, [("A", "x", 1), ("B", "y", 2)]))
    bad = ents(spark, [("A", "x", 5), ("A", "z", 6)]).withColumn(
        "n", F.when(F.col("name") == "z", F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad)
    assert stored(table) == [("A", "x", 1), ("B", "y", 2)] and table.state().version == 0
    assert len(table.vacuum(0)) <= 1 and stored(table) == [("A", "x", 1), ("B", "y", 2)]


def test_upsert_is_computed_again_when_its_scope_changed(spark, tmp_out):
    table = LOG.LoggedTable(spark, os.path.join(tmp_out, "e"))
    table.upsert(ents(spark, [("A", "x", 1), ("A", None, 4), ("B", "y", 2), (None, "q", 3)]))
    base = table.state()
    mine = table.stage(ents(spark, [("A", "x", 9)]))
    table.upsert(ents(spark, [("A", "w", 7), ("A", None, 5), (None, "q", 8)]))
    with pytest.raises(LOG.Conflict):
        table.commit(mine, replaces=True, computed_from=base)
    table.upsert(ents(spark, [("A", "x", 9)]))
    assert stored(table) == sorted([("A", "x", 9), ("A", "w", 7), ("A", None, 5), ("B", "y", 2),
                                    (None, "q", 8)], key=str)
    assert sorted((r.name, r.n) for r in table.read(base).filter("scope = 'B'").collect()) == [("y", 2)]


def test_batches_are_committed_once(spark, tmp_out):
    path = os.path.join(tmp_out, "posts")
    posts = make_posts(spark, ["one post", "two posts"])
    for number in (0, 1, 1, 0):
        LOG.append_posts(posts, path, batch=("tweets", number))
    LOG.append_posts(posts, path, batch=("pages", 0))
    assert LOG.posts_log(spark, path).read().count() == 6


def test_columns_are_added_and_types_kept(spark, tmp_out):
    table = LOG.LoggedTable(spark, os.path.join(tmp_out, "e"))
    table.append(ents(spark, []))
    assert table.read().columns == ["scope", "name", "n"] and table.read().count() == 0
    table.append(ents(spark, [("A", "x", 1)]))
    table.append(ents(spark, [("A", "y", 2)]).withColumn("more", F.lit("m")))
    assert sorted((r.name, r.more) for r in table.read().collect()) == [("x", None), ("y", "m")]
    with pytest.raises(ValueError, match="column n"):
        table.append(spark.createDataFrame([("A", "x", "1")], "scope string, name string, n string"))
    with pytest.raises(ValueError, match="scope"):
        table.append(spark.createDataFrame([(1,)], "n long"))


def test_ids_need_no_shuffle_of_the_rows(spark, tmp_out):
    path = os.path.join(tmp_out, "posts")
    LOG.append_posts(make_posts(spark, ["one post", "two posts"]), path)
    plan = LOG.posts_log(spark, path).read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
