"""Cutting lineage on storage every executor can reach."""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from .partitions import held, known_bytes, more_than_scan
from .text import quoted


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session without one gets a temporary folder, removed when Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tabsight-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """A table written to the shared folder and read back: for large results that many steps read a few columns of."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def made_once(df: DataFrame, name: str = "rows") -> DataFrame:
    """``written`` if making the rows takes more than a scan: for searches of several passes, whose last ones run when the result is used."""
    return written(df, name) if more_than_scan(df) else df


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UNWRITTEN = ("void", "interval", "variant")  # types that Parquet does not hold, or not in every release
SLICE_BYTES = 2**30  # of the tables joined, for rows that are made at once


@contextmanager
def held_on_disk(df: DataFrame, join_key: str | None = None):
    """Keeps the input of many passes while they run, if making it takes more than a scan: as Parquet, which takes less room than kept rows and their shuffles, and is removed after them.

    Shuffle files go at the end of the query that wrote them; Spark alone leaves them until the driver's garbage collector finds their plan. Rows joined on ``join_key`` are made in
    slices of its hash, which filter both sides before they move: only the shuffles of one slice lie on disk. The rows must be the same each time they are made.
    """
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    path = None
    try:
        if not more_than_scan(df):
            yield df
        elif not df.columns or any(t in kind for _, kind in df.dtypes for t in UNWRITTEN):
            with held(df):
                yield df
        else:
            path = scratch_path(spark, "held")
            slices = known_bytes(df) // SLICE_BYTES + 1 if join_key else 1
            for i in range(slices):
                rows = df.where(F.pmod(F.xxhash64(quoted(join_key)), F.lit(slices)) == i) if slices > 1 else df
                rows.write.mode("append").option("compression", "zstd").parquet(path)
            yield spark.read.schema(df.schema).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
