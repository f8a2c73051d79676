"""Spark session helpers: configuration for local runs and the checkpoint folder."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "codemap") -> SparkSession:
    """Session for tests, the bench and local runs (Spark UI off)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CODEMAP_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage and is read from the session.
    Only a local-mode session without a configured folder gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder for iterative jobs on a cluster")
    local_dir = tempfile.mkdtemp(prefix="codemap-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete a scratch folder when it ends: until then a returned DataFrame may read it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def stage(df, name: str):
    """Write ``df`` as parquet under the session's checkpoint folder and read it back.

    Cuts the lineage (and the logical plan) at a pipeline stage: later steps plan against a
    scan instead of the whole upstream plan, a lost executor re-reads files instead of
    recomputing the stage, and the data lives in the shared folder the cluster names in
    ``spark.checkpoint.dir``. One job per stage.
    """
    import time
    import uuid
    spark = df.sparkSession
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/stage-{name}-{uuid.uuid4().hex}"
    t0 = time.time()
    df.write.mode("overwrite").parquet(path)
    if os.environ.get("CODEMAP_TIMING"):
        print(f"[stage] {name}: {time.time() - t0:.2f}s", flush=True)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
