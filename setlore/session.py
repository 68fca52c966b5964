"""Session defaults and the shared folder for materialised intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "setlore") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SETLORE_DRIVER_MEMORY", "8g"))
        .config(CHECKPOINT_DIR, _local_folder())
        .getOrCreate()
    )


def _local_folder() -> str:
    """A folder of this process, removed at its end; only for sessions whose executors live in it."""
    folder = tempfile.mkdtemp(prefix="setlore-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it.

    Where the setting is missing a local session gets a folder of its own. On a cluster that is an error:
    executors would write to their own disks and the table read back would lack parts.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = _local_folder()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors.

    Parquet rather than RDD checkpoints, so column pruning and statistics stay available. The table is
    deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/setlore-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
