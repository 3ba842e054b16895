"""Sinks (SNK-1 .. SNK-7) and the read-back of exports (SRC-10).

All writes are Spark writers into a directory (a shared filesystem or object
store on a cluster): Parquet partitioned by scope for the tables, JSON lines
and CSV for the exports.  Re-running a job overwrites the scopes it wrote
(dynamic partition overwrite, asked for by the writer, so no session setting
changes) instead of appending duplicates.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# The dialect of the csv module: quotes doubled, texts kept as they are.
CSV_OPTIONS = {"header": True, "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}
EMPTY = "\x00empty\x00"          # what the reader puts for "", before it is put right


def read_if_stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path``, None if nothing is stored there yet; any other
    failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _replace_scopes(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("scope").parquet(path))


# SNK-1
def assign_post_ids(posts: DataFrame, after: int = -1) -> DataFrame:
    """A new ``post_id`` per row, larger than ``after`` and unique in the
    result; the platform's own id stays as ``native_id``.  The ids settle when
    the rows are stored: read them back before joining on them."""
    return (posts.withColumnRenamed("post_id", "native_id")
            .withColumn("post_id", F.monotonically_increasing_id() + F.lit(after + 1)))


def write_posts(posts: DataFrame, path: str, mode: str = "append") -> None:
    """Store posts (defaults: likes/shares 0), partitioned by scope.

    Every stored row gets its own ``post_id``: copies of a post and equal ids
    of two platforms stay apart in all later joins.  An append goes on after
    the largest stored id (a footer statistic); one writer at a time."""
    spark = posts.sparkSession
    after = -1
    if mode == "append":
        old = read_if_stored(spark, path, "post_id long")
        after = -1 if old is None else old.agg(F.max("post_id")).first()[0]
        after = -1 if after is None else after
    out = (assign_post_ids(posts, after)
           .withColumn("likes", F.coalesce("likes", F.lit(0)).cast("long"))
           .withColumn("shares", F.coalesce("shares", F.lit(0)).cast("long")))
    out.write.mode(mode).options(**STORED_OPTIONS).partitionBy("scope").parquet(path)


# SNK-2
def write_entities(entities: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Entities per scope.  ``overwrite``: dynamic partition overwrite (a rerun
    replaces the scopes it computed).  ``upsert``: rows of earlier runs whose
    (scope, name) is not recomputed are kept, as the original's INSERT OR
    REPLACE does."""
    if mode == "upsert":
        old = read_if_stored(entities.sparkSession, path, entities.schema)
        if old is not None:
            # only the scopes of this run are read and rewritten
            touched = old.join(entities.select("scope").distinct(), "scope", "left_semi")
            kept = touched.join(entities.select("scope", "name"), ["scope", "name"], "left_anti")
            # materialised (in the checkpoint folder) before the files it reads are replaced
            entities = cut_lineage(kept.select(*entities.columns).unionByName(entities))
    _replace_scopes(entities, path)


# SNK-3
def write_sentiment(sentiment: DataFrame, path: str) -> None:
    """Sentiment rows; a rerun replaces the scope instead of duplicating rows."""
    _replace_scopes(sentiment, path)


# SNK-4
def export_posts_json(posts: DataFrame, path: str) -> None:
    """Posts as JSON lines (UTF-8, non-ASCII kept as is)."""
    posts.write.mode("overwrite").json(path)


# SNK-5
def export_posts_csv(posts: DataFrame, path: str) -> None:
    """Posts as CSV with a header -- also when there are no rows.  Quotes are
    doubled, line breaks and outer blanks stay, an empty text differs from null."""
    out = posts.coalesce(1) if posts.isEmpty() else posts
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


# SNK-6
#: groups (scope, entity) up to which the sentiment export has a folder for each
EXPORT_GROUPS = 2_000
#: rows of the sentiment export that one task sorts in memory and writes, about
EXPORT_ROWS = 20_000
#: the column the folders of the sentiment export are named by
EXPORT_GROUP = "export_group"
#: the text of a post is in each of its rows, so the export is compressed; beyond
#: level 4 the time doubles for each step of a few per cent
EXPORT_OPTIONS = {"compression": "gzip", "zlib.compress.level": "FOUR"}
#: stored posts are mostly text, which takes a third less than with the default codec
STORED_OPTIONS = {"compression": "zstd"}


def export_sentiment_json(sentiment: DataFrame, posts: DataFrame, path: str) -> None:
    """Sentiment rows joined with post columns, sorted by (scope, entity, score
    desc): gzipped JSON lines, a folder for each (scope, entity), numbered in
    their order; the files of a folder go on by name.

    A row holds its post's text, so a sort of the rows would move a text once
    per entity of its post.  The rows of an entity follow score and id alone:
    the posts are sorted by (scope, score desc, id) with their entities as an
    array, which moves a text once, and a task sets the rows of its stretch
    apart by entity.  A post whose rows differ in score moves once per score.
    Beyond ``EXPORT_GROUPS`` folders the rows are sorted as a whole."""
    out = sentiment_rows(sentiment, posts)
    write = out.write.mode("overwrite").options(**EXPORT_OPTIONS)
    if EXPORT_GROUP in out.columns:
        write = write.option("partitionOverwriteMode", "static").partitionBy(EXPORT_GROUP)
    write.json(path)


def sentiment_rows(sentiment: DataFrame, posts: DataFrame) -> DataFrame:
    """The rows of the sentiment export, each partition in the order of its
    folders, or all sorted and without ``EXPORT_GROUP``."""
    spark = sentiment.sparkSession
    cols = posts.select("post_id", "text", "platform", F.col("scope").alias("post_scope"), "ts", "url")
    keys = (sentiment.select("post_id", "entity").join(cols.select("post_id", "post_scope"), "post_id")
            .groupBy("post_scope", "entity").agg(F.count(F.lit(1)).alias("n")))
    found = keys.orderBy("post_scope", "entity").limit(EXPORT_GROUPS + 1).collect()
    if len(found) > EXPORT_GROUPS:
        return (sentiment.join(cols, "post_id")
                .orderBy(F.col("post_scope"), F.col("entity"), F.col("score").desc(), F.col("post_id")))
    number = spark.createDataFrame([(f"{i:05d}", r["post_scope"], r["entity"]) for i, r in enumerate(found)],
                                   f"{EXPORT_GROUP} string, _s string, _e string")
    rows = sum(r["n"] for r in found)
    cores = spark.sparkContext.defaultParallelism
    stretches = max(1, -(-rows // EXPORT_ROWS), min(cores, rows // 10_000))
    rest = [c for c in sentiment.columns if c != "post_id"]
    per_post = (sentiment.filter("post_id IS NOT NULL").groupBy("post_id", F.col("score").alias("_score"))
                .agg(F.collect_list(F.struct(*rest)).alias("_rows")).join(cols, "post_id"))
    order = [F.col("post_scope"), F.col("_score").desc(), F.col("post_id")]
    return (per_post.repartitionByRange(stretches, *order)
            .withColumn("_r", F.explode("_rows"))
            .select(*[F.col("_r")[c].alias(c) if c in rest else F.col(c) for c in sentiment.columns],
                    *[c for c in cols.columns if c != "post_id"])
            .join(F.broadcast(number), F.col("post_scope").eqNullSafe(F.col("_s"))
                  & F.col("entity").eqNullSafe(F.col("_e"))).drop("_s", "_e")
            .sortWithinPartitions(EXPORT_GROUP, F.col("score").desc(), "post_id"))


# SNK-7
def export_profiles_json(profiles: DataFrame, path: str) -> None:
    """Nested profiles as JSON lines, one folder per scope; an earlier export
    is replaced as a whole, so no scope of it survives."""
    (profiles.write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("scope").json(path))


# SRC-10
def read_json_export(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path).drop(EXPORT_GROUP)


def read_csv_export(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV export with all its texts, whatever line breaks they hold; an
    empty text ("" in the file) stays apart from null (nothing in the file)."""
    back = (spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", True)
            .option("emptyValue", EMPTY).csv(path))
    return back.withColumns({f.name: F.when(F.col(f.name) != EMPTY, F.col(f.name))
                             .when(F.col(f.name).isNotNull(), F.lit(""))
                             for f in back.schema.fields if f.dataType.simpleString() == "string"})


# SET-2
def dedupe_posts(posts: DataFrame, keys) -> DataFrame:
    """Optional de-duplication (the default keeps duplicates): one row per key,
    the smallest post id, chosen with a partial ``min_by`` aggregate."""
    keys = list(keys)
    rest = [c for c in posts.columns if c not in keys]
    agg = posts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("post_id")).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


# SNK-8
def export_all(posts: DataFrame, sentiment: DataFrame, profiles: DataFrame, out_dir: str,
               posts_json: bool = True, posts_csv: bool = True, sentiment_json: bool = True,
               profiles_json: bool = True) -> dict[str, str]:
    """The export step of the pipeline, each export behind its switch.
    Returns the written folders by export name."""
    import os
    done = {}
    if posts_json:
        done["posts_json"] = os.path.join(out_dir, "posts_json")
        export_posts_json(posts, done["posts_json"])
    if posts_csv:
        done["posts_csv"] = os.path.join(out_dir, "posts_csv")
        export_posts_csv(posts, done["posts_csv"])
    if sentiment_json:
        done["sentiment_json"] = os.path.join(out_dir, "sentiment_json")
        export_sentiment_json(sentiment, posts, done["sentiment_json"])
    if profiles_json:
        done["profiles_json"] = os.path.join(out_dir, "profiles_json")
        export_profiles_json(profiles, done["profiles_json"])
    return done
