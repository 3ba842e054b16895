"""Readers for the landed tables and the normalized ``posts`` view.

``posts`` schema (one row per post):
    post_id long, platform string, scope string, text string, author string,
    ts timestamp_ntz, url string, likes long, shares long, keyword string

Only the columns an operator needs are selected, so Parquet column pruning
and filter pushdown reach the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import hours
from ..functions.text import clean_text

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")

POST_COLUMNS = ("post_id", "platform", "scope", "text", "author", "ts", "url",
                "likes", "shares", "keyword")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def posts_from_documents(documents: DataFrame) -> DataFrame:
    """The ``posts_v`` view: documents re-read as forum posts.

    platform = source, scope = lang, text cleaned (FN-1), a hashed author
    (FN-2 of 'user<doc_id % 50>'), one post per hour from 2024-01-01,
    a synthetic url and engagement numbers.
    """
    d = documents
    return d.select(
        F.col("doc_id").alias("post_id"),
        F.col("source").alias("platform"),
        F.col("lang").alias("scope"),
        clean_text("text").alias("text"),
        F.substring(F.sha2(F.concat(F.lit("user"), (F.col("doc_id") % 50).cast("string")), 256),
                    1, 12).alias("author"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + hours("doc_id")).alias("ts"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/post/"),
                 F.col("doc_id").cast("string")).alias("url"),
        (F.col("n_chars") % 97).alias("likes"),
        (F.col("doc_id") % 13).alias("shares"),
        F.concat(F.col("lang"), F.lit(" release")).alias("keyword"),
    )


def posts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_from_documents(read_table(spark, sf_dir, "documents"))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts stored by ``sinks.write_posts`` (Parquet partitioned by scope)."""
    return spark.read.parquet(path)
