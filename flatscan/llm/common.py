"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder, shared_folder

#: A word: a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt out anew only where it has fewer pieces than the cluster has cores.

    For scans alone: counting the pieces of a plan with a shuffle would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without that setting a temporary one for a local master, and an error for a cluster."""
    found = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; lost executors don't bring its lineage back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_dir(spark: SparkSession, prefix: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return new_folder(spark, prefix)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that the session knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, base: str) -> str:
    """base, or a longer name where df has a column of that name (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts; sizes partitions, so that each holds a bounded amount."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).head()[0] or 0


def pieces_for(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge in (a, b): root is the least node that it is connected to.

    Each round points a node at its least neighbour, links its other neighbours
    to that one, and follows one more pointer. Rounds grow with the logarithm of
    a component's diameter. Only distributed joins and aggregates; nothing is
    gathered but two numbers a round.
    """
    a, b = F.col("a"), F.col("b")
    now = checkpoint(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if seen == state:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = seen
        # written, so that a join can split the rows of one root
        least = checkpoint(now.groupBy("a").agg(F.min("b").alias("m")))
        star = now.join(least, "a")
        star = star.select("a", F.col("m").alias("b")).unionByName(star.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        star = checkpoint(star.distinct())
        ahead = checkpoint(star.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b"))
        now = checkpoint(star.join(ahead, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
    raise RuntimeError("components did not settle")
