"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike.  Partition counts are
#: left to adaptive execution; the cluster sizes the initial number itself.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites are for notebooks; capturing one per expression slows plan building
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(master: str | None = None, app: str = "storyloom", **extra: str) -> SparkSession:
    """Make (or reuse) a session carrying :data:`SETTINGS`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession, *packages: str) -> None:
    """Let Python workers import packages that lie beside this one, wherever the workers run; once a session."""
    sc = spark.sparkContext
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sent = sc.__dict__.setdefault("_storyloom_sent", set())
    for package in {"storyloom", *packages} - sent:
        sent.add(package)
        if os.path.isdir(os.path.join(here, package)):
            sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), package), "zip", here, package))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and tables that cut lineage.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    driver and executors share a disk, may fall back to a fresh temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="spark-storyloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made
