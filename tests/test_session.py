"""Checkpoint folder: the session's setting first, a temporary folder only locally."""

from vocalis.session import cut_lineage, ensure_checkpoint_dir


def test_checkpoint_dir_is_reused(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first      # never replaced once set


def test_cut_lineage_is_reliable_and_equal(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    cut = cut_lineage(df.groupBy("k").count())
    assert sorted(tuple(r) for r in cut.collect()) == sorted(tuple(r) for r in df.groupBy("k").count().collect())
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan                                  # lineage cut at the checkpoint
