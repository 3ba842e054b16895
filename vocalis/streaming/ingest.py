"""Incremental ingest and attribution with Structured Streaming.

The original re-runs its whole batch job to pick up new posts.  The
incremental form of the same work: landed files are read as a stream,
normalized to posts, de-duplicated within a watermark on
``(platform, url)``, and every micro-batch is scored once per post and
attributed to the stored entities (SEN-5 + JOIN-2 + SEN-8) in
``foreachBatch``.  Output is written per micro-batch id with a partition
overwrite, so a retried batch replaces its own output (exactly-once files);
the stream's progress lives in ``checkpointLocation`` on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.containment import contains_join
from ..operators.sentiment import attribute, lexicon_scores
from ..params import Params


def read_landed(spark: SparkSession, path: str, schema, file_glob: str | None = None,
                max_files_per_trigger: int = 100) -> DataFrame:
    """A stream over landed Parquet files (explicit schema, bounded batches)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    return r.parquet(path)


def dedupe_stream(posts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop re-delivered posts (same platform and url) within the watermark.
    Watermarks need an instant type, so the (UTC wall-clock) post time is
    cast to ``timestamp`` for the event-time column."""
    return (posts.withColumn("event_time", F.col("ts").cast("timestamp"))
            .withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark(["platform", "url"])
            .drop("event_time"))


def attribution_batch(entities: DataFrame, p: Params, out_path: str) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body: score, attribute, write the batch's partition."""
    ent = entities.select("scope", "name")

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch = batch.persist()                # scored, joined and counted below
        try:
            scored = lexicon_scores(batch, p)
            pairs = (contains_join(batch, ent, ent.count(), ())
                     .select("post_id", F.col("name").alias("entity")))
            out = attribute(scored, pairs).withColumn("batch_id", F.lit(batch_id))
            (out.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id").parquet(out_path))
        finally:
            batch.unpersist()
    return run


def start_attribution(posts: DataFrame, entities: DataFrame, p: Params, out_path: str,
                      checkpoint: str, available_now: bool = True,
                      watermark: str = "1 day") -> StreamingQuery:
    stream = dedupe_stream(posts.filter(F.col("scope").isin(list(p.scopes))) if p.scopes else posts,
                           watermark)
    w = (stream.writeStream.foreachBatch(attribution_batch(entities, p, out_path))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
