"""Session construction and cluster-shared locations.

Library code never invents a storage location: the checkpoint / scratch root is
read from ``spark.checkpoint.dir`` of the running session. Only test and bench
helpers set one, and only when the session has none.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; the values here suit local tests and are
# overridden by whatever the cluster submits.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # AQE turns a sort-merge join into a broadcast only when the *measured*
    # shuffle output of a side is below this; nothing is broadcast on a guess.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Parquet is compressed on disk: inflate file-size estimates so the static broadcast
    # threshold is compared with something closer to the in-memory size.
    "spark.sql.sources.fileCompressionFactor": "3.0",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "scanledger") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master.startswith("local"):
        # local mode: the driver JVM is the whole cluster; the 1 GB default heap thrashes the GC
        builder = builder.config("spark.driver.memory", os.environ.get("SCANLEDGER_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint root; set one only when the session has none and runs in one process (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="scanledger-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table under the shared checkpoint root and read it back: work behind it is done once.

    The files stay until whoever owns the checkpoint root clears it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
