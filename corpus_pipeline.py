"""The corpus pipeline: STAGES applied to documents one after the other.

toxicity      documents scored toxic by the learned lexicon go
near_copies   of each group of near copies the smallest doc_id stays
pii           personal data in the texts is replaced by its kind
mixing        sources are repeated or cut to their target weights
tokens        texts become token ids, decoded again as a check

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm import bpe, jaccard_join, mixing, pii, toxicity
from vocalis.llm.common import documents, read_table, shared_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs, pii.fit(docs.select("doc_id", "text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    codec = bpe.Codec(spark, bpe.default_path())
    coded = codec.round_trip(docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)),
                             keep=("doc_id", "lang", "source", "digest"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [("toxicity", reject_toxic), ("near_copies", drop_near_copies), ("pii", redact_pii),
          ("mixing", mix_sources), ("tokens", to_tokens)]

#: fitted models, a set join and a tokenizer: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
