"""Python workers must find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def share_code(spark: SparkSession) -> None:
    """Put the package's root on the workers' path; a cluster gets the package by --py-files as well."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share; a temporary one only in local mode, where none is named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="scorelake-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
