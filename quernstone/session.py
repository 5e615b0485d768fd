"""Session defaults and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session with the engine's defaults; ``more`` overrides single settings."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | more
    spark = SparkSession.builder.master(master).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
