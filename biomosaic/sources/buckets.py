"""Tables kept in buckets of a key: joins on it move no rows, one value is one bucket.

Spark knows the buckets of a folder through the session's catalog only, so a stored table
is registered there under a name made from its folder; files stay where they are when the
name goes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Buckets:
    """A table at ``path``: its columns, the bucket key, and directories by ``parted``."""

    path: str
    columns: str
    key: str
    buckets: int
    parted: str | None = None

    @property
    def name(self) -> str:
        described = f"{self.path} {self.columns} {self.key} {self.buckets} {self.parted}"
        return f"biomosaic_{hashlib.sha256(described.encode()).hexdigest()[:16]}"

    def open(self, spark: SparkSession) -> DataFrame:
        """The table in this session, empty where nothing has been written."""
        if not spark.catalog.tableExists(self.name):
            parted = (
                f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({self.parted})" if self.parted else ""
            )
            spark.sql(
                f"CREATE TABLE {self.name} ({self.columns}) USING parquet {parted} "
                f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
        if self.parted and self._written(spark):  # directories of other sessions
            spark.sql(f"MSCK REPAIR TABLE {self.name}")
        spark.catalog.refreshTable(self.name)
        return spark.table(self.name)

    def _written(self, spark: SparkSession) -> bool:
        try:
            return bool(spark.read.format("binaryFile").load(self.path).schema)
        except AnalysisException:  # no such folder
            return False

    def write(self, frame: DataFrame) -> DataFrame:
        """Replaces the table, or of a table in directories those that ``frame`` has rows for.

        Rows are dealt by the key first, so that a bucket is one file of a directory.
        """
        spark = frame.sparkSession
        columns = self.open(spark).columns
        dealt = frame.select(*columns).repartition(self.buckets, self.key)
        dealt.write.insertInto(self.name, overwrite=True)
        return self.open(spark)
