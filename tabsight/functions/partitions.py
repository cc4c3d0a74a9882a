"""Partitioning and reuse of inputs."""

import re
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Deals out a scan that has fewer partitions than there are task slots (one small file); leaves any other alone.

    Meant for a plain scan: it asks for the number of partitions without running anything.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan


PART_BYTES = 16 * 2**20  # of the files read, per task that holds whole rows


def _plan_bytes(spark, plan) -> int:
    """Bytes of the files, kept tables and checkpoints that a plan reads, as far as they are known.

    A checkpoint, and a table that isn't kept yet, carry the optimizer's guess of the plan they came from, for a join the product of its sides. A checkpoint counts by
    its files instead, and a table not kept yet by what it is made of.
    """
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRDD":
            kept = leaf.rdd().getCheckpointFile()
            if kept.isDefined():
                path = spark._jvm.org.apache.hadoop.fs.Path(kept.get())
                total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        elif kind == "InMemoryRelation" and not leaf.cacheBuilder().isCachedColumnBuffersLoaded():
            total += _plan_bytes(spark, leaf.cacheBuilder().logicalPlan())
        else:
            size = int(str(leaf.stats().sizeInBytes()))
            total += size if size < 2**60 else 0
    return total


def known_bytes(df: DataFrame) -> int:
    return _plan_bytes(df.sparkSession, df._jdf.queryExecution().optimizedPlan())


def parts_for(df: DataFrame) -> int:
    """Tasks that the rows of a table need when each keeps its rows in memory: by the size of the files, kept tables and checkpoints it is made of, as far as they are known."""
    return known_bytes(df) // PART_BYTES + 1


def more_than_scan(df: DataFrame) -> bool:
    """Whether making the rows takes more than reading files or a kept table."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return bool(re.search(r"\b(Join|Aggregate|Window|Repartition|Generate|Sort)\b", plan)) and "InMemoryRelation" not in plan


@contextmanager
def held(df: DataFrame):
    """Keeps the input of a several-pass search while it runs, if making it takes more than a scan.

    A plain scan with pruned columns is read again instead, which at size is cheaper than a copy of it.
    """
    worth = more_than_scan(df)
    if worth:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        if worth:
            df.unpersist()
