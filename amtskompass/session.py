"""Session helpers: a local test session and reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "amtskompass") -> SparkSession:
    """Session for tests and local benches.  On a cluster, use the session the cluster gives you."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # test tables are files of one row group: deal their rows to all cores
        .config("spark.amtskompass.scan.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: the one the cluster names, else that of the checkpoints."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.getCheckpointDir() is None:
            reliable_checkpoint(spark.range(1))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only when no
    folder is configured (tests, local runs) is a temporary one used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="amtskompass-ckpt-"))
    return df.checkpoint(eager=True)
