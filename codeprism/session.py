"""A local session with the settings that tests and benches share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("codeprism")
    base = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="codeprism-"),
    }
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
