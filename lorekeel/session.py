"""Session helpers."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Only the workers' PYTHONPATH changes; a cluster without that folder gets the
    package by --py-files as usual.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(":")
    if ROOT not in known:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, known)])


def settled(frame: DataFrame) -> DataFrame:
    """A frame written to the checkpoint folder, so that rounds built on it are not computed again.

    The folder is ``spark.checkpoint.dir``; a session on one machine without one gets a
    temporary folder, a cluster must name a shared one.
    """
    sc = frame.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorekeel-"))
    return frame.checkpoint()
