"""New folders that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, which a local master alone can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all machines share")
        made = tempfile.mkdtemp(prefix="flatscan-")
        atexit.register(shutil.rmtree, made, True)
        found = "file://" + made
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, prefix: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
