"""Session helpers: a configured SparkSession and a checkpoint directory."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every hourglass job relies on. The time zone is pinned so that
# any zoned timestamp arithmetic agrees with the NTZ data; AQE re-plans joins
# and coalesces shuffle partitions from runtime sizes, and splits skewed
# partitions of sort-merge joins.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "hourglass",
                  shuffle_partitions: int | None = None,
                  checkpoint_dir: str | None = None,
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a SparkSession with hourglass defaults.

    ``checkpoint_dir`` is only applied when the cluster does not already name
    one in ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if master and master.startswith("local"):
        # Local mode runs every task in the driver JVM; its default heap is 1g.
        conf["spark.driver.memory"] = "12g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir:
        ensure_checkpoint_dir(spark, default=checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """Make sure reliable checkpoints have a shared directory.

    Order: the directory already set on the SparkContext, then the cluster's
    ``spark.checkpoint.dir``, then ``default`` (tests). A ``local`` master is
    one machine, so a temporary folder of its own will do there; on a cluster
    a missing setting is an error, as executors share no local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    chosen = spark.conf.get("spark.checkpoint.dir", None) or default
    if not chosen:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        chosen = tempfile.mkdtemp(prefix="hourglass-checkpoints-")
    sc.setCheckpointDir(chosen)  # Spark creates the folder on the file system
    return sc.getCheckpointDir()


def reliable_checkpoint(df):
    """``df.checkpoint()`` to the shared checkpoint directory, computed once.

    An eager checkpoint of an unpersisted frame runs the plan twice (once
    for the action, once to write the files); caching it first makes the
    write read the cached blocks. The cache is dropped afterwards; the
    returned frame reads the checkpoint files (fault tolerant, no lineage).
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
