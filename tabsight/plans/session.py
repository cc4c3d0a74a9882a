"""A local session for tests and timing. On a cluster the session comes with its own settings."""

import os

from pyspark.sql import SparkSession


def local_session(cpus: str | None = None) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]").appName("tabsight")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
