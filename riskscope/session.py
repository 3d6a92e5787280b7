"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_spark(master: str | None = None, app: str = "riskscope", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench: UI off, AQE (coalesce + skew join) on,
    UTC session time zone.  On a cluster ``getOrCreate`` returns the
    existing session and only the SQL settings below are applied."""
    master = master or os.environ.get("SPARK_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the cluster's shared ``spark.checkpoint.dir``.  Where it is
    unset a local session gets a scratch directory; on a cluster that is an
    error, as executors would each write to a disk of their own."""
    try:
        conf = spark.sparkContext.getConf()
    except Exception:  # no driver-side context: the server owns the directory
        return spark.conf.get("spark.checkpoint.dir", None)
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="riskscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


_sending = threading.Lock()


def ship_package() -> None:
    """Send this package to the Python workers, once per context: functions
    that refer to its modules load there without an installation or a
    PYTHONPATH.  Fits run side by side in threads, and a context refuses a
    second file of the same name: one thread sends, the others wait for it.
    Sessions without a context of their own (Spark Connect) need the package
    installed."""
    sc = SparkContext._active_spark_context
    if sc is None:
        return
    with _sending:
        if getattr(sc, "_riskscope_sent", False):
            return
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="riskscope-"), "riskscope.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for full in (os.path.join(folder, n) for n in sorted(names) if n.endswith(".py")):
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)  # copied from the driver to every executor
        sc._riskscope_sent = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint directory (survives
    executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """In a local session, round-robin repartition when the scan yields fewer
    partitions than ``factor`` x the cores (e.g. a single-row-group file):
    row-wise work (regexes over HTML and text) is CPU bound there.  On a
    cluster the scan stays as it is, whatever its splits."""
    try:
        if not re.match(r"local(\[|$)", df.sparkSession.sparkContext.master):
            return df
        target = df.sparkSession.sparkContext.defaultParallelism * factor
        current = df.rdd.getNumPartitions()
    except Exception:  # sessions without an RDD API: leave the plan as is
        return df
    return df.repartition(target) if current < target else df


def read_table(spark: SparkSession, sf_dir: str, name: str, *, spread_rows: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_rows else df
