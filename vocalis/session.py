"""Spark session construction and lineage cutting.

Every operator in the package takes DataFrames and returns DataFrames; the
session is only needed to read tables and to cut long lineages (the variant
merge rounds).  Checkpoints go to the shared directory the cluster names in
``spark.checkpoint.dir``; a private temporary directory is created only when
that setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # pandas UDF batches carry whole documents / pages: keep them small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def get_spark(master: str | None = None, app: str = "vocalis",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ...);
    it is used as is, and its absence is an error.  Only in local mode (runs on
    one machine, tests) an unset directory is replaced by a fresh temporary
    folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...): "
                               "a machine-local folder does not survive on a cluster")
        configured = tempfile.mkdtemp(prefix="vocalis-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint directory.

    Reliable (not local) checkpoints survive the loss of an executor: the
    data lives in the shared checkpoint folder, not in executor block stores.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
