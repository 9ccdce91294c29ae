"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job wants: AQE re-plans joins from runtime sizes (that is the
# size check behind every broadcast we do not hint), splits skewed shuffle
# partitions, and coalesces small ones.  The UI stays off.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "schemaweave", extra: dict | None = None) -> SparkSession:
    """A session with the settings above.  Without ``master`` the launcher's
    holds, or local mode where BENCH_CPUS asks for it or none is set; without
    ``shuffle_partitions`` Spark's own setting stays, which AQE coalesces."""
    builder = SparkSession.builder.appName(app_name)
    cpus = os.environ.get("BENCH_CPUS")
    if master or cpus:
        builder = builder.master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    ``spark.checkpoint.dir`` names a shared file system path and is used as is.
    Only a local session without it gets a temporary folder; on a cluster that
    would be one disk of one machine, so there it is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            root = current.rsplit("/", 1)[0]
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            root = tempfile.mkdtemp(prefix="schemaweave-ckpt-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for a written table; it is
    removed when the session's JVM ends."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(target)
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers (once), so that tasks
    can import it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_schemaweave_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="schemaweave-zip-"), "schemaweave"), "zip",
                               os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(path)
    sc._schemaweave_shipped = True
