"""Session helpers: table access, checkpoint folder, timeline splitting settings."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application; they needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, as Parquet."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession, fallback: str = "/tmp/tagloom-checkpoints") -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; the fallback is for sessions that name none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("a cluster needs a shared folder: set spark.checkpoint.dir")
    sc.setCheckpointDir(folder or fallback)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder of ``spark.checkpoint.dir``; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs a shared folder: set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4()}" if base else tempfile.mkdtemp(prefix=f"tagloom-{name}-")


SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table marked for broadcast if it has at most ``rows`` rows, counted up to there; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """The table over all cores where it has fewer parts than there are cores, as a small table in one file has.

    Costly Python steps follow; large tables have parts enough and aren't shuffled. Only plain scans are touched.
    """
    if not hasattr(df, "_jdf"):  # a remote session shows no plan
        return df
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < plan.toRdd().getNumPartitions() < cores else df
