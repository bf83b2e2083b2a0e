"""Session for local work; on a cluster the submitted session is used as it is."""
from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "8", name: str = "noticeflow") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
