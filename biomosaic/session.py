"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Joins with a fixed-size fan-out leave hot keys to Spark, which cuts oversized
# shuffle partitions while the query runs. By default it does not do so when
# another join or aggregation on the same key follows without a shuffle; the
# last setting accepts an extra shuffle there rather than one huge task.
HOT_KEY_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Codes compress tenfold in a shuffle: what Spark merges into one task by its size
    # there takes far more memory. At its default of 64 MB tasks took up to 1.7 GB.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Rows that lie by some of a join's keys are not shuffled again by all of them.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A table is broadcast by the size of its files, in which codes and names take a tenth
    # of their memory: sides of up to 277 MB went through the driver by a threshold of 10 MB.
    "spark.sql.sources.fileCompressionFactor": "10",
}


def split_hot_keys(spark: SparkSession) -> None:
    for name, value in HOT_KEY_SETTINGS.items():
        spark.conf.set(name, value)
