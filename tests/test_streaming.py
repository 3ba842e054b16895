"""Streaming attribution over landed document files equals the batch fan-out."""

import os

import pytest
from pyspark.sql import functions as F

from vocalis.params import driver_params
from vocalis.sources.tables import posts_from_documents
from vocalis.streaming.ingest import read_landed, start_attribution

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_stream_matches_batch(spark, tmp_out):
    from vocalis.plans.catalog import analysis
    p = driver_params()
    docs_schema = spark.read.parquet(os.path.join(SF, "documents.parquet")).schema
    docs = read_landed(spark, SF, docs_schema, file_glob="documents.parquet")
    posts = posts_from_documents(docs)
    a = analysis(spark, SF)
    q = start_attribution(posts, a.entities, p, os.path.join(tmp_out, "out"), os.path.join(tmp_out, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(tmp_out, "out")).select("post_id", "entity", "label", "score")
    want = a.sentiment.select("post_id", "entity", "label", "score")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert F is not None


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_redelivered_posts_are_dropped(spark, tmp_out):
    import shutil
    from vocalis.plans.catalog import analysis
    p = driver_params()
    landing = os.path.join(tmp_out, "landing")
    os.makedirs(landing)
    src = os.path.join(SF, "documents.parquet")
    shutil.copyfile(src, os.path.join(landing, "part-a.parquet"))
    shutil.copyfile(src, os.path.join(landing, "part-b.parquet"))   # the same posts again
    schema = spark.read.parquet(src).schema
    posts = posts_from_documents(read_landed(spark, landing, schema, max_files_per_trigger=1))
    a = analysis(spark, SF)
    q = start_attribution(posts, a.entities, p, os.path.join(tmp_out, "out"), os.path.join(tmp_out, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(tmp_out, "out")).select("post_id", "entity", "label", "score")
    want = a.sentiment.select("post_id", "entity", "label", "score")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
