"""A session with the settings that results and plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("rankloom")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"}
    return b.config(map=base | conf).getOrCreate()
