"""Session settings, shared storage and small DataFrame helpers of the operators."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Settings that the operators rely on.

    Arrow batches hold whole texts, so their rows and bytes are few. Python workers
    import this package: on a cluster it is installed there, else it is found at ROOT.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a temporary one is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="biomosaic-checkpoint-"))
    return context.getCheckpointDir()


def settle(frame: DataFrame) -> DataFrame:
    """Written to the shared folder: computed once, safe from lost executors."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Rows of a few numbers that are broadcast at most, some tens of MB.
BROADCAST_ROWS = 1_000_000


def checked(settled: DataFrame) -> DataFrame:
    """A settled frame of a few numeric columns as the side of a join: broadcast if it has
    no more rows than BROADCAST_ROWS, else left to a shuffle join."""
    return F.broadcast(settled) if settled.count() <= BROADCAST_ROWS else settled


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shards(spark: SparkSession) -> int:
    """Partitions of a shuffle, the measure for salts: it follows the size of the job."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(0))


def bounded_sample(rows: DataFrame, per: str, bound: int, *order: str) -> DataFrame:
    """At most ``bound`` rows for each value of ``per`` (none for null), by a hash of ``order``.

    Rows are counted by 65,536 even parts of the hash range. Only those up to the part in
    which the bound is reached are ranked: the bound and one part more, whatever the number
    of rows and partitions, but for rows that repeat.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*order)).withColumn("_part", F.shiftright("_hash", 48))
    before = Window.partitionBy(per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy(per, "_part").agg(F.count(F.lit(1)).alias("_n"))
    reached = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < bound)
    cuts = settle(reached.groupBy(per).agg(F.max("_part").alias("_last")))
    near = hashed.join(checked(cuts), per).filter(F.col("_part") <= F.col("_last"))
    first = Window.partitionBy(per).orderBy("_hash", *order)
    return near.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= bound).select(*rows.columns)
