"""Written tables that are deleted once their readers have run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketpulse.session import scratch_path


class Scratch:
    """Tables below the shared folder that live as long as a ``with`` block.

    What is read from them must be written or collected inside the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows and read them back."""
        self.paths.append(scratch_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in self.paths:
            at = hadoop.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
