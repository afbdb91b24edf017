"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "voltcast",
                  shuffle_partitions: int | None = None, driver_memory: str = "16g") -> SparkSession:
    """Session with the settings every plan here assumes.

    UTC session time zone, ANSI on (divisions use ``try_divide``), AQE with
    partition coalescing and skew-join splitting, no web UI.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.ansi.enabled", "true")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", driver_memory))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared file system; it is read
    from the session and never overridden. Where it is unset, a local master (one
    process, so one disk) gets a fresh temporary folder that goes with the
    session; any other master is an error, as its executors share no local disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="voltcast-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{os.getpid()}-{next(_counter)}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: writes to the shared folder and cuts lineage.

    Used where a plan reads the same intermediate twice and the two reads must
    see identical rows (non-deterministic row ids), and so that lost executors
    recompute from the checkpoint instead of from the source.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
