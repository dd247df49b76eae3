"""Where jobs write what driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, below a temporary folder, in local mode only: on a cluster machines don't share one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local_dir:
            folder = tempfile.mkdtemp(prefix="palimpsest-")
            atexit.register(shutil.rmtree, folder, True)
            _local_dir.append("file://" + folder)
        base = _local_dir[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few words each that may be broadcast.
MOST_BROADCAST = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, which are counted; else as it is, and joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
