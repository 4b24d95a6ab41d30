"""Stopping the Spark jobs of a scan by a tag."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Tagged:
    """Jobs started under a tag; ``cancel`` ends those that run and leaves others alone."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag

    def cancel(self) -> list[str]:
        return self.spark.interruptTag(self.tag)


@contextmanager
def tagged(spark: SparkSession, name: str = "flatscan") -> Iterator[Tagged]:
    """Jobs of this thread carry a tag of their own until the block ends."""
    tag = f"{name}-{uuid.uuid4().hex}"
    spark.addTag(tag)
    try:
        yield Tagged(spark, tag)
    finally:
        spark.removeTag(tag)
